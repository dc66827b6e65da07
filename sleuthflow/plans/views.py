"""Inputs of the registered queries, derived by Spark from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sleuthflow import catalog
from sleuthflow.operators.contracts import check_ops
from sleuthflow.operators.entity import entity_operational, operational_to_features
from sleuthflow.operators.scoring import tabular_proxy
from sleuthflow.session import materialize
from sleuthflow.sources.readers import spread_if_narrow

MONEY = "decimal(18,2)"
WINDOW_HOURS = 12
# Width of the borderline strip around the label cut, as a distance of planted scores.
BORDERLINE_STRIP = 0.027


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as transfers from customer to supplier; refunds go the other way."""
    lines = spread_if_narrow(table(spark, sf_dir, "lineitem"), "l_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    supplier = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    refund = F.col("l_returnflag") == "R"
    return lines.join(orders, "l_orderkey").select(
        F.when(refund, supplier).otherwise(customer).alias("sender_id"),
        F.when(refund, customer).otherwise(supplier).alias("receiver_id"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier ledgers: nations are the counterparties, market segments their types."""
    lines = spread_if_narrow(table(spark, sf_dir, "lineitem"), "l_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    flag, segment = F.col("l_returnflag"), F.col("c_mktsegment")
    paid_out = (flag == "R") | ((flag == "A") & (F.col("l_suppkey") % 3 == 0))
    kind = (
        F.when(segment.isin("HOUSEHOLD", "BUILDING"), "physical")
        .when(segment == "MACHINERY", "exchange")
        .otherwise("legal")
    )
    named = customers.join(nations, customers.c_nationkey == nations.n_nationkey)
    return (
        lines.join(orders, "l_orderkey")
        .join(named, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("l_suppkey").alias("company_id"),
            F.col("l_shipdate").cast("timestamp").alias("timestamp"),
            F.col("l_extendedprice").cast(MONEY).alias("amount"),
            F.when(paid_out, "out").otherwise("in").alias("direction"),
            kind.alias("counterparty_type"),
            F.col("n_name").alias("counterparty_name"),
        )
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as case events; some are self-transfers."""
    return as_case_events(spread_if_narrow(table(spark, sf_dir, "events"), "event_id"))


def as_case_events(events: DataFrame) -> DataFrame:
    group = F.floor(F.col("user_id") / F.lit(5)).cast("bigint")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    crypto = kind.isin("purchase", "signup")
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_id").alias("pos"),
        ts.alias("ts"),
        F.col("value").cast(MONEY).alias("amount"),
        F.lit("USD").alias("currency"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("sender_id"),
        F.concat(F.lit("U"), (group * 5 + k % 8).cast("string")).alias("receiver_id"),
        F.when(kind.isin("purchase", "click"), "company").otherwise("wallet").alias("sender_type"),
        F.lit("wallet").alias("receiver_type"),
        F.when(crypto, "crypto").otherwise("legal").alias("channel"),
        F.lit("KZ").alias("jurisdiction"),
        F.when(crypto, "token").otherwise("fiat").alias("asset_type"),
        F.concat(F.lit("c"), group.cast("string"), F.lit("-"), F.date_format(ts, "yyyyMMdd")).alias("case_id"),
        kind.alias("event_type"),
    )


def good_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).where(F.col("sender_id") != F.col("receiver_id"))


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with stray blanks and case, unreadable and missing fields, empty ids, wrong channels and amounts."""
    number = F.col("pos")
    amount = F.when(number % 97 == 0, -F.col("amount")).otherwise(F.col("amount")).cast("string")
    ts = F.concat(F.lit("\t"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("\n"))
    return raw_events(spark, sf_dir).withColumns(
        {
            "ts": F.when(number % 83 == 0, F.lit(None)).when(number % 89 == 0, "not-a-time").otherwise(ts),
            "event_id": F.when(number % 103 == 0, " \t").otherwise(F.col("event_id")),
            "sender_id": F.when(number % 107 == 0, "").otherwise(F.concat(F.col("sender_id"), F.lit("\u00a0"))),
            "jurisdiction": F.when(number % 109 == 0, "\n").otherwise(F.lit("kz\r\n")),
            "asset_type": F.when(number % 113 == 0, "\t").otherwise(F.col("asset_type")),
            "channel": F.when(F.col("event_type") == "error", " Wire ").otherwise(F.col("channel")),
            "currency": F.when(number % 101 == 0, "  ").when(number % 7 == 0, "\tusd ").otherwise(F.col("currency")),
            "amount": F.when(number % 127 == 0, F.lit(None)).when(number % 79 == 0, "12x").otherwise(amount),
            "sender_type": F.when(F.col("sender_type") == "company", " Company ").otherwise(F.col("sender_type")),
        }
    )


def case_requests(spark: SparkSession, sf_dir: str, chunk: int = 64) -> DataFrame:
    """Nested requests: the events of a case come in documents of at most `chunk` events."""
    fields = [c for c in catalog.EVENT_FIELDS if c not in ("ts", "amount")]
    event = F.struct(
        *fields, F.col("ts").cast("string").alias("ts"), F.col("amount").cast("double").alias("amount"), "pos"
    )
    return (
        raw_events(spark, sf_dir)
        .groupBy("case_id", F.floor(F.col("pos") / F.lit(chunk)).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", event.alias("event")))).alias("items"))
        .select("case_id", "part", F.transform("items", lambda i: i["event"]).alias("events"))
    )


def request_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of their own case each: every third with supplied features, every fifth with a window of no length."""
    part = F.col("part")
    share = {"growth_rate": 5, "payout_dependency": 7, "centralization_index": 4}
    values = {
        n: (part % share[n] / F.lit(float(share[n])) if n in share else F.lit((low + high) / 2))
        for n, (low, high) in catalog.FEATURE_BOUNDS.items()
    }
    supplied = F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v.cast("double"))])
    return case_requests(spark, sf_dir).select(
        F.concat("case_id", F.lit("#"), part.cast("string")).alias("case_id"),
        "events",
        F.when(part % 5 == 4, 0).otherwise(WINDOW_HOURS).alias("window_hours"),
        F.when(part % 3 == 1, supplied).alias("tabular_features"),
    )


def operational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operational facts that pass the contract."""
    return _passed(entity_operational(transfers(spark, sf_dir)))


def _passed(facts: DataFrame) -> DataFrame:
    return check_ops(facts).where(F.col("reason").isNull()).drop("reason")


def features_of(facts: DataFrame) -> DataFrame:
    """Features of the entities whose facts pass the contract."""
    return operational_to_features(_passed(facts), keep=["entity_id"])


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features_of(entity_operational(transfers(spark, sf_dir)))


def planted(rows: DataFrame) -> DataFrame:
    """Label from proxy score plus a hash noise, cut at the mean; a strip around the cut is borderline."""
    noise = F.conv(F.substring(F.md5(F.col("entity_id").cast("binary")), 1, 6), 16, 10).cast("double")
    score = F.round(tabular_proxy() + F.lit(0.3) * noise / F.lit(16777216.0), 6).cast("decimal(12,6)")
    planted = materialize(rows.withColumn("planted", score), "planted-labels")
    mean = planted.agg(F.round(F.sum("planted").cast("double") / F.count("*"), 7).alias("mean")).first()["mean"]
    gap = F.col("planted").cast("double") - F.lit(mean)
    return planted.withColumns(
        {"label": (gap >= 0).cast("int"), "is_borderline": F.abs(gap) <= F.lit(BORDERLINE_STRIP)}
    ).drop("planted")


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(features(spark, sf_dir))


def labeled_operational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operational facts with the label of their features."""
    facts = operational(spark, sf_dir)
    wide = operational_to_features(facts, keep=["entity_id", *catalog.OPERATIONAL])
    return planted(wide).select(F.col("entity_id").alias("id"), *catalog.OPERATIONAL, "label")
