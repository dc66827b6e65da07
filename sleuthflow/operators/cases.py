"""Trailing case windows and the per-case facts drawn from them.

Windowed events are kept once as narrow rows (`case_rollup`). Edges, minutes and amounts are aggregated from
those, and everything else about a case from these aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sleuthflow import catalog
from sleuthflow.functions.columns import at_least, clip, clip01, require_columns, strip
from sleuthflow.functions.money import minor_units
from sleuthflow.functions.ranking import top_k
from sleuthflow.functions.skew import ROWS_PER_SLICE, attach
from sleuthflow.operators.contracts import clamp_ops
from sleuthflow.session import materialize

GAP_SECONDS = 90
MINUTE_US = 60_000_000
SMALL_PART = 0.35


def case_bounds(
    events: DataFrame,
    window_hours: int = 24,
    cases: DataFrame | None = None,
    key: str = "case_id",
    error_order: str | None = None,
) -> DataFrame:
    """End of each case (its latest event), its row count and its window length.

    `cases` may give `window_hours` per case; the argument covers cases it does not name. With
    `error_order` the first `reason` of the case in that order is kept as `error`. The table has one
    row per case and is written once, as the hot-key list, the join and the failures all read it.
    """
    if window_hours <= 0:
        raise ValueError("window_hours must be > 0.")
    aggregates = [F.max("ts").alias("end_ts"), F.count("*").alias("n_rows")]
    if error_order:
        broken = F.when(F.col("reason").isNotNull(), F.struct(error_order, "reason"))
        aggregates.append(F.min(broken)["reason"].alias("error"))
    bounds = events.groupBy(key).agg(*aggregates).withColumn("window_hours", F.lit(window_hours))
    if cases is not None and "window_hours" in cases.columns:
        own = cases.select(key, F.col("window_hours").alias("_own")).dropDuplicates([key])
        bounds = (
            bounds.join(own, key, "left")
            .withColumn("window_hours", F.coalesce("_own", "window_hours"))
            .drop("_own")
        )
    return materialize(bounds, "case-bounds")


def window_events(
    events: DataFrame,
    window_hours: int = 24,
    cases: DataFrame | None = None,
    key: str = "case_id",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Events no older than `window_hours` before the end of their case (border included)."""
    require_columns(events, [key, "event_id", "ts"], "events")
    return within(events, case_bounds(events, window_hours, cases, key), key, rows_per_slice)


def within(
    events: DataFrame, bounds: DataFrame, key: str = "case_id", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Events inside the window of their case; cases without bounds drop out."""
    joined = attach(events, bounds, key, ["event_id"], rows_per_slice=rows_per_slice)
    start = F.col("end_ts") - F.make_dt_interval(F.lit(0), F.col("window_hours"))
    return joined.where(F.col("ts") >= start).drop("n_rows")


def case_windows(windowed: DataFrame, key: str = "case_id", event_case_id: str | None = None) -> DataFrame:
    """One row per window: its borders and its size.

    With `event_case_id` the id is resolved too: the given key, else the first non-empty id an event
    carries in time order, else a name made from the end of the window.
    """
    aggregates = [
        F.count("*").alias("n_events"),
        F.min("ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        F.max("window_hours").alias("window_hours"),
    ]
    if event_case_id is None:
        return windowed.groupBy(key).agg(*aggregates)
    own = strip(F.col(event_case_id))
    named = F.when(own != "", F.struct("ts", "event_id", own.alias("id")))
    made = F.concat(F.lit("case-"), F.date_format("end_ts", "yyyyMMddHHmmss"))
    return (
        windowed.groupBy(key)
        .agg(*aggregates, F.min(named)["id"].alias("_own"))
        .withColumn("resolved_case_id", F.coalesce("_own", made))
        .drop("_own")
    )


def case_rollup(windowed: DataFrame) -> DataFrame:
    """What the measures of a case read of its windowed events: one narrow row per event, nothing multiplied.

    It needs no shuffle of its own. Edges, minutes and amounts are aggregated from it with a map-side combine,
    each from its own columns. Amounts are in minor units, `per_one` of them to 1.
    """
    units, per_one = minor_units(windowed, "amount")
    return windowed.select(
        "case_id",
        "sender_id",
        "receiver_id",
        units.alias("units"),
        F.when(F.col("sender_type").isin(catalog.PAYER_TYPES), units).otherwise(F.lit(0)).alias("payout"),
        (F.col("channel") == "crypto").cast("int").alias("is_crypto"),
        F.unix_micros("ts").alias("us"),
        "window_hours",
        F.lit(per_one).alias("per_one"),
    )


def edges_of(rollup: DataFrame) -> DataFrame:
    """Distinct directed edges of each case with what they carried."""
    return rollup.groupBy("case_id", "sender_id", "receiver_id").agg(
        F.count("*").alias("n"),
        F.sum("units").alias("total"),
        F.sum("payout").alias("payouts"),
        F.sum("is_crypto").alias("n_crypto"),
        F.max("per_one").alias("per_one"),
    )


def event_gaps(rollup: DataFrame) -> DataFrame:
    """Count, density and mean of the gaps between consecutive events of a case.

    Minutes are shorter than the gap limit, so every gap inside one counts without looking at its events;
    only the step from one active minute to the next needs an order. A case has at most
    720 hours * 60 + 1 minutes, which bounds the window. The mean gap is the span over the gap count.
    """
    minutes = rollup.groupBy("case_id", F.floor(F.col("us") / F.lit(MINUTE_US)).alias("minute")).agg(
        F.count("*").alias("n"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.max("window_hours").alias("window_hours"),
    )
    order = Window.partitionBy("case_id").orderBy("minute")
    step = F.col("first_us") - F.lag("last_us").over(order)
    near = F.col("n") - 1 + F.when(step <= GAP_SECONDS * 1_000_000, 1).otherwise(0)
    per_case = (
        minutes.withColumn("near", near)
        .groupBy("case_id")
        .agg(
            F.sum("n").alias("n_events"),
            F.sum("near").alias("short_gaps"),
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.max("window_hours").alias("window_hours"),
        )
    )
    gaps = F.greatest(F.col("n_events") - 1, F.lit(1)).cast("double")
    span = (F.col("last_us") - F.col("first_us")).cast("double")
    return per_case.select(
        "case_id",
        "n_events",
        "short_gaps",
        (F.col("short_gaps").cast("double") / gaps).alias("gap_density"),
        (span / F.lit(60e6) / gaps).alias("avg_delta_minutes"),
        F.greatest(span / F.lit(3600e6), F.lit(1.0)).alias("span_hours"),
        "window_hours",
    )


def small_parts(rollup: DataFrame) -> DataFrame:
    """Events below 0.35 of the mean amount of their case, counted over distinct amounts."""
    amounts = rollup.groupBy("case_id", F.col("units").alias("amount_key")).agg(
        F.count("*").alias("n"), F.sum("units").alias("total")
    )
    means = amounts.groupBy("case_id").agg(
        F.count("*").alias("n_rows"),
        (F.sum("total").cast("double") / F.sum("n").cast("double")).alias("mean_amount"),
    )
    joined = attach(amounts, means, "case_id", ["amount_key"])
    small = F.col("amount_key").cast("double") < F.col("mean_amount") * F.lit(SMALL_PART)
    return joined.groupBy("case_id").agg(F.sum(F.when(small, F.col("n")).otherwise(0)).alias("small_parts"))


def parties_of(edges: DataFrame) -> DataFrame:
    """One row per (case, party): what it sent and whom it touches. Totals are booked on the sender."""
    zero = F.lit(0)
    money = edges.schema["total"].dataType
    none = zero.cast(money)
    sender = F.struct(
        F.col("sender_id").alias("node"),
        F.col("n").alias("n_sent"),
        F.col("total").alias("sent"),
        F.col("payouts").alias("payouts"),
        F.col("n_crypto").alias("crypto_sent"),
        F.lit(1).alias("out_degree"),
        zero.alias("in_degree"),
        zero.cast("bigint").alias("crypto_received"),
        "per_one",
    )
    receiver = F.struct(
        F.col("receiver_id").alias("node"),
        zero.cast("bigint").alias("n_sent"),
        none.alias("sent"),
        none.alias("payouts"),
        zero.cast("bigint").alias("crypto_sent"),
        zero.alias("out_degree"),
        F.lit(1).alias("in_degree"),
        F.col("n_crypto").alias("crypto_received"),
        "per_one",
    )
    values = ["n_sent", "sent", "payouts", "crypto_sent", "out_degree", "in_degree", "crypto_received"]
    return (
        edges.select("case_id", F.inline(F.array(sender, receiver)))
        .groupBy("case_id", "node")
        .agg(*[F.sum(v).alias(v) for v in values], F.max("per_one").alias("per_one"))
    )


def case_totals(parties: DataFrame) -> DataFrame:
    """Everything about a case that sums over its parties."""
    return parties.groupBy("case_id").agg(
        F.sum("n_sent").alias("events"),
        (F.sum("sent").cast("double") / F.max("per_one")).alias("amount_total"),
        (F.sum("payouts").cast("double") / F.max("per_one")).alias("amount_paid"),
        F.sum("crypto_sent").alias("crypto_events"),
        F.count("*").alias("nodes"),
        F.count_if(F.col("out_degree") > 0).alias("senders"),
        F.count_if(F.col("in_degree") > 0).alias("receivers"),
        F.count_if(F.col("crypto_received") > 0).alias("crypto_receivers"),
        F.sum("in_degree").alias("edges"),
        F.max("in_degree").alias("max_in_degree"),
    )


def top_senders(parties: DataFrame) -> DataFrame:
    sending = parties.where(F.col("out_degree") > 0)
    ranked = top_k(sending, ["case_id"], [F.desc("sent"), F.asc("node")], 10)
    return ranked.groupBy("case_id").agg(
        (F.max("sent").cast("double") / F.max("per_one")).alias("top1"),
        (F.sum("sent").cast("double") / F.max("per_one")).alias("top10"),
    )


def _operational_columns() -> dict[str, Column]:
    c = F.col
    senders = c("senders").cast("double")
    clients = F.greatest(F.lit(1.0), senders)
    whole = at_least(c("amount_total"), 1.0)
    top1 = clip01(c("top1") / whole)
    return {
        "tx_count_total": c("events").cast("double"),
        "unique_counterparties": at_least(c("nodes"), 2.0),
        "new_clients_current": clients,
        "new_clients_previous": F.greatest(F.lit(1.0), F.floor(clients * F.lit(0.82)).cast("double")),
        "referred_clients_current": F.least(F.floor(clients * F.lit(0.31)).cast("double"), clients),
        "incoming_funds": whole,
        "payouts_total": at_least(c("amount_paid"), 0.0),
        "top1_wallet_share": top1,
        "top10_wallet_share": F.greatest(clip01(c("top10") / whole), top1),
        "avg_holding_days": clip(c("span_hours") / F.lit(24.0) * F.lit(2.5), 1.0, 365.0),
        "repeat_investor_share": clip01(senders / at_least(c("events"), 1.0)),
        "max_referral_depth": clip(F.log2(at_least(c("nodes"), 2.0)) + F.lit(1.0), 1.0, 30.0),
    }


def with_operational(facts: DataFrame) -> DataFrame:
    """Per-case facts plus the 12 operational facts, clamped to their bounds."""
    return clamp_ops(facts.withColumns(_operational_columns()))


def case_operational(facts: DataFrame) -> DataFrame:
    return with_operational(facts).select("case_id", *catalog.OPERATIONAL)


def case_facts(rollup: DataFrame) -> DataFrame:
    """Totals, top senders and gaps of every case, one row each."""
    parties = parties_of(edges_of(rollup))
    return (
        case_totals(parties)
        .join(top_senders(parties), "case_id")
        .join(event_gaps(rollup), "case_id")
    )
