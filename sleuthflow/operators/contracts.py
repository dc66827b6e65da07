"""Data contracts: normalised events, and a reason column in place of exceptions.

Every check gives one `reason` per row, NULL for a good row, so a caller splits the input in two:
`reason IS NULL` goes on, the rest is the quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sleuthflow import catalog
from sleuthflow.functions.columns import clip, first_failure, number_text, outside, require_columns, strip

UPPER = ["currency", "jurisdiction"]
LOWER = ["sender_type", "receiver_type", "channel", "asset_type"]
PLAIN = ["event_id", "sender_id", "receiver_id"]


def normalize_events(events: DataFrame) -> DataFrame:
    """Trim text, fold case, parse time and amount. Other columns pass through."""
    require_columns(events, catalog.EVENT_FIELDS, "events")
    cleaned = {c: F.upper(strip(F.col(c).cast("string"))) for c in UPPER}
    cleaned |= {c: F.lower(strip(F.col(c).cast("string"))) for c in LOWER}
    cleaned |= {c: strip(F.col(c).cast("string")) for c in PLAIN}
    cleaned |= {c: strip(F.col(c).cast("string")) for c in ("tx_hash", "case_id") if c in events.columns}
    types = dict(events.dtypes)
    if types["ts"] == "string":
        cleaned["ts"] = strip("ts").try_cast("timestamp")
    elif types["ts"] != "timestamp":
        cleaned["ts"] = F.col("ts").cast("timestamp")
    if types["amount"] == "string":
        cleaned["amount"] = strip("amount").try_cast("double")
    return events.withColumns(cleaned)


def _missing(missing: dict[str, Column], message: str) -> tuple[Column, Column]:
    """Rule: some fields are missing; its message lists them."""
    absent = F.array_compact(F.array(*[F.when(gone, F.lit(c)) for c, gone in missing.items()]))
    return F.size(absent) > 0, F.concat(F.lit(message + ": ['"), F.concat_ws("', '", absent), F.lit("']"))


def event_reason(given: dict[str, Column] | None = None) -> Column:
    """First broken rule of a normalised event, in the fixed order of the contract.

    `given` has the raw time and amount as text, so that a value that could not be read is told from a
    missing one. The texts of all reasons are fixed values.
    """
    given = given or {}
    unread = {c: raw.isNotNull() & F.col(c).isNull() for c, raw in given.items()}
    absent = {c: given.get(c, F.col(c)).isNull() for c in sorted(catalog.EVENT_FIELDS)}
    unreadable = [
        (unread[c], F.concat(F.lit(text), given[c], F.lit("'")))
        for c, text in (("ts", "Invalid isoformat string: '"), ("amount", "could not convert string to float: '"))
        if c in given
    ]
    empty = {c: (F.col(c) == "") for c in catalog.EVENT_FIELDS if c not in ("ts", "amount")}
    return first_failure(
        [
            _missing(absent, "Missing event fields"),
            *unreadable,
            (empty["event_id"], "event_id must be non-empty."),
            (F.isnan(F.col("amount").cast("double")) | (F.col("amount") <= 0), "amount must be > 0."),
            (empty["sender_id"] | empty["receiver_id"], "sender_id and receiver_id must be non-empty."),
            (F.col("sender_id") == F.col("receiver_id"), "sender_id and receiver_id must be different."),
            (~F.col("channel").isin(catalog.CHANNELS), f"channel must be one of {catalog.CHANNELS}."),
            (empty["currency"], "currency must be non-empty."),
            (empty["jurisdiction"], "jurisdiction must be non-empty."),
            (empty["asset_type"], "asset_type must be non-empty."),
        ]
    )


def check_events(events: DataFrame) -> DataFrame:
    """Normalised events with their `reason`."""
    require_columns(events, catalog.EVENT_FIELDS, "events")
    raw = {c: f"_raw_{c}" for c in ("ts", "amount")}
    kept = events.withColumns({name: F.col(c).cast("string") for c, name in raw.items()})
    reason = event_reason({c: F.col(name) for c, name in raw.items()})
    return normalize_events(kept).withColumn("reason", reason).drop(*raw.values())


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine)."""
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def _range_rules(bounds: dict[str, tuple[float, float]], noun: str) -> list[tuple[Column, str | Column]]:
    return [
        (
            outside(F.col(name), low, high),
            F.concat(F.lit(f"{noun} '{name}' out of range [{low}, {high}]: "), number_text(F.col(name))),
        )
        for name, (low, high) in bounds.items()
    ]


def ops_reason() -> Column:
    rules = [_missing({c: F.col(c).isNull() for c in catalog.OPERATIONAL}, "Missing operational fields")]
    rules += _range_rules(catalog.OPERATIONAL_BOUNDS, "Operational field")
    rules += [
        (
            F.col("referred_clients_current") > F.col("new_clients_current"),
            "referred_clients_current cannot exceed new_clients_current.",
        ),
        (
            F.col("top1_wallet_share") > F.col("top10_wallet_share"),
            "top1_wallet_share cannot exceed top10_wallet_share.",
        ),
    ]
    return first_failure(rules)


def check_ops(ops: DataFrame) -> DataFrame:
    """Reject policy: facts out of range get a reason."""
    require_columns(ops, catalog.OPERATIONAL, "operational facts")
    return ops.withColumn("reason", ops_reason())


def clamp_ops(ops: DataFrame) -> DataFrame:
    """Clamp policy: facts out of range are pulled to the nearest bound."""
    return ops.withColumns({c: clip(F.col(c), low, high) for c, (low, high) in catalog.OPERATIONAL_BOUNDS.items()})


def check_features(features: DataFrame) -> DataFrame:
    require_columns(features, catalog.FEATURES, "features")
    rules = [_missing({c: F.col(c).isNull() for c in catalog.FEATURES}, "Missing features"), *_range_rules(catalog.FEATURE_BOUNDS, "Feature")]
    return features.withColumn("reason", first_failure(rules))
