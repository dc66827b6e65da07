"""Operational facts and model features for every entity of a transfer log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sleuthflow import catalog
from sleuthflow.functions.columns import at_least, clip, require_columns, share
from sleuthflow.functions.money import minor_units
from sleuthflow.functions.ranking import top_k
from sleuthflow.session import materialize

TX_COLUMNS = ["sender_id", "receiver_id", "amount", "timestamp"]
NO_INFLOW_CLIENTS = 10


def counterparty_totals(tx: DataFrame) -> DataFrame:
    """One row per (entity, counterparty). Every transfer is read once and gives a leg to each end.

    Both directions of a pair are summed in one row first, so that a transfer is shuffled once, not once an end.
    A self-transfer is money in and money out but one transfer, so only its inflow leg is counted.
    Flows are in minor units, `per_one` of them to 1.
    """
    require_columns(tx, TX_COLUMNS, "transaction log")
    units, per_one = minor_units(tx, "amount")
    sender, receiver = F.col("sender_id"), F.col("receiver_id")
    # A missing end comes first.
    swapped = F.coalesce(sender > receiver, receiver.isNull())
    prepared = tx.select(
        F.when(swapped, receiver).otherwise(sender).alias("first"),
        F.when(swapped, sender).otherwise(receiver).alias("second"),
        swapped.alias("back"),
        F.coalesce(units, F.lit(0)).alias("units"),
    )
    zero = F.lit(0).cast(prepared.schema["units"].dataType)
    pairs = prepared.groupBy("first", "second").agg(
        F.sum(F.when(F.col("back"), zero).otherwise(F.col("units"))).alias("forth"),
        F.sum(F.when(F.col("back"), F.col("units")).otherwise(zero)).alias("back"),
        F.count_if(~F.col("back")).alias("n_forth"),
        F.count_if(F.col("back")).alias("n_back"),
    )

    def leg(entity: str, other: str, inward: str, outward: str, n_tx: Column) -> Column:
        return F.struct(
            F.col(entity).alias("entity_id"),
            F.col(other).alias("counterparty_id"),
            F.col(inward).alias("inflow"),
            F.col(outward).alias("outflow"),
            n_tx.alias("n_tx"),
            F.col(f"n_{inward}").alias("n_in"),
            F.lit(per_one).alias("per_one"),
        )

    own = leg("first", "first", "forth", "forth", F.col("n_forth"))
    both = F.col("n_forth") + F.col("n_back")
    ends = F.array(leg("first", "second", "back", "forth", both), leg("second", "first", "forth", "back", both))
    legs = F.when(F.col("first") == F.col("second"), F.array(own)).otherwise(ends)
    return pairs.select(F.inline(legs)).where(F.col("entity_id").isNotNull())


def sender_concentration(totals: DataFrame) -> DataFrame:
    """Share of the largest and of the ten largest senders in an entity's inflow."""
    senders = totals.where(F.col("n_in") > 0)
    incoming = senders.groupBy("entity_id").agg(F.sum("inflow").alias("incoming"), F.max("per_one").alias("per_one"))
    named = senders.where(F.col("counterparty_id").isNotNull())
    ranked = top_k(named, ["entity_id"], [F.desc("inflow"), F.asc("counterparty_id")], 10)
    tops = ranked.groupBy("entity_id").agg(F.max("inflow").alias("top1"), F.sum("inflow").alias("top10"))
    return incoming.join(tops, "entity_id", "left").select(
        "entity_id",
        (F.col("incoming").cast("double") / F.col("per_one")).alias("incoming_funds"),
        F.coalesce(share(F.col("top1"), F.col("incoming")), F.lit(0.0)).alias("top1_wallet_share"),
        F.coalesce(share(F.col("top10"), F.col("incoming")), F.lit(0.0)).alias("top10_wallet_share"),
    )


def _client_facts(clients: Column) -> dict[str, Column]:
    """Facts a plain transfer log cannot tell, estimated from the client count or set to constants."""
    n = clients.cast("double")
    return {
        "new_clients_current": n,
        "new_clients_previous": F.greatest(F.lit(1.0), F.floor(n * F.lit(0.8)).cast("double")),
        "referred_clients_current": F.floor(n * F.lit(0.3)).cast("double"),
        "avg_holding_days": F.lit(30.0),
        "repeat_investor_share": F.lit(0.2),
        "max_referral_depth": F.lit(3.0),
    }


def entity_operational(tx: DataFrame) -> DataFrame:
    """The 12 operational facts of every entity that sends or receives."""
    totals = materialize(counterparty_totals(tx), "counterparty-totals")
    other = ~F.col("counterparty_id").eqNullSafe(F.col("entity_id"))
    facts = totals.groupBy("entity_id").agg(
        F.sum("n_tx").cast("double").alias("tx_count_total"),
        (F.count_if(other) + 1).cast("double").alias("unique_counterparties"),
        F.count_if(F.col("n_in") > 0).alias("_senders"),
        (F.sum("outflow").cast("double") / F.max("per_one")).alias("payouts_total"),
    )
    clients = F.when(F.col("_senders") > 0, F.col("_senders")).otherwise(NO_INFLOW_CLIENTS)
    return (
        facts.join(sender_concentration(totals), "entity_id", "left")
        .na.fill(0.0, ["incoming_funds", "top1_wallet_share", "top10_wallet_share"])
        .withColumns(_client_facts(clients))
        .select("entity_id", *catalog.OPERATIONAL)
    )


def log_operational(tx: DataFrame) -> DataFrame:
    """The same facts for the whole log taken as one organisation: every row is inflow, nothing is paid out."""
    require_columns(tx, TX_COLUMNS, "transaction log")
    zero = F.lit(0).cast(tx.schema["amount"].dataType)
    sent = F.struct(F.col("sender_id").alias("party"), F.col("amount").alias("volume"), F.lit(1).alias("n"))
    received = F.struct(F.col("receiver_id").alias("party"), zero.alias("volume"), F.lit(0).alias("n"))
    parties = (
        tx.select(F.inline(F.array(sent, received)))
        .groupBy("party")
        .agg(F.sum("volume").alias("volume"), F.sum("n").alias("n"))
    )
    whole = parties.agg(
        F.sum("n").alias("n_tx"),
        F.count("*").alias("n_parties"),
        F.count_if(F.col("n") > 0).alias("n_senders"),
        F.sum("volume").cast("double").alias("incoming"),
    )
    top = (
        parties.where((F.col("n") > 0) & F.col("party").isNotNull())
        .orderBy(F.desc("volume"), F.asc("party"))
        .limit(10)
        .select(F.col("volume").cast("double").alias("top"))
    )
    merged = whole.unionByName(top, allowMissingColumns=True).agg(
        F.max("n_tx").cast("double").alias("tx_count_total"),
        F.max("n_parties").cast("double").alias("unique_counterparties"),
        F.max("n_senders").alias("_senders"),
        F.coalesce(F.max("incoming"), F.lit(0.0)).alias("incoming_funds"),
        F.max("top").alias("_top1"),
        F.sum("top").alias("_top10"),
    )
    return (
        merged.withColumns(_client_facts(F.col("_senders")))
        .withColumn("payouts_total", F.lit(0.0))
        .withColumn("top1_wallet_share", share(F.col("_top1"), F.col("incoming_funds")))
        .withColumn("top10_wallet_share", share(F.col("_top10"), F.col("incoming_funds")))
        .where(F.col("tx_count_total") > 0)
        .select(*catalog.OPERATIONAL)
    )


def feature_columns() -> dict[str, Column]:
    """The nine model features as expressions over the operational facts, clipped to their bounds."""
    c = F.col
    top1 = c("top1_wallet_share")
    busiest = F.greatest(c("tx_count_total"), c("unique_counterparties") + F.lit(1.0))
    diversity = F.log1p(c("unique_counterparties")) / F.log1p(busiest)
    raw = {
        "growth_rate": (c("new_clients_current") - c("new_clients_previous"))
        / at_least(c("new_clients_previous"), 1.0),
        "referral_ratio": c("referred_clients_current") / at_least(c("new_clients_current"), 1.0),
        "payout_dependency": c("payouts_total") / at_least(c("incoming_funds"), 1.0),
        "centralization_index": top1,
        "avg_holding_time": c("avg_holding_days"),
        "reinvestment_rate": c("repeat_investor_share"),
        "gini_coefficient": F.lit(0.12) + F.lit(0.72) * c("top10_wallet_share") + F.lit(0.22) * top1,
        "transaction_entropy": F.lit(0.3) + F.lit(4.7) * diversity * (F.lit(1.0) - F.lit(0.55) * top1),
        "structural_depth": c("max_referral_depth"),
    }
    return {name: clip(raw[name].cast("double"), *catalog.FEATURE_BOUNDS[name]) for name in catalog.FEATURES}


def operational_to_features(ops: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns plus the nine features; the facts must be valid or clamped already."""
    features = [column.alias(name) for name, column in feature_columns().items()]
    return ops.select(*keep, *features)
