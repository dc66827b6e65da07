"""Company ledger metrics, risk score and findings, for every company at once.

The ledger is read once: `ledger_rollup` aggregates it by (company, day) and by (company, counterparty)
in the same pass, and every metric below works on those small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sleuthflow import catalog
from sleuthflow.functions.columns import at_least, band, clip01, printed, require_columns, share
from sleuthflow.functions.money import in_money, minor_units
from sleuthflow.functions.ranking import top_k
from sleuthflow.session import materialize

LEDGER_COLUMNS = ["company_id", "timestamp", "amount", "direction", "counterparty_type", "counterparty_name"]
NO_HOLDING_DAYS = 90.0

METRICS = [
    "total_inflow",
    "total_outflow",
    "crypto_inflow",
    "crypto_outflow",
    "physical_inflow_ratio",
    "crypto_exposure_ratio",
    "dependency_ratio",
    "avg_holding_time",
    "concentration_index",
    "entropy_of_flows",
    "legal_inflow_ratio",
    "exchange_inflow_ratio",
    "total_transactions",
    "inflow_count",
    "outflow_count",
    "unique_counterparties",
    "total_volume",
]


def _flow(direction: str, kind: str | None = None) -> Column:
    wanted = F.col("direction") == direction
    if kind:
        wanted = wanted & (F.col("counterparty_type") == kind)
    return F.sum(F.when(wanted, F.col("units")).otherwise(F.lit(0)))


def _in_units(ledger: DataFrame) -> tuple[DataFrame, float]:
    require_columns(ledger, LEDGER_COLUMNS, "company ledger")
    units, per_one = minor_units(ledger, "amount")
    return ledger.withColumns({"units": F.coalesce(units, F.lit(0)), "day": F.to_date("timestamp")}), per_one


def ledger_rollup(ledger: DataFrame) -> DataFrame:
    """Grouping sets (company, day) and (company, counterparty); `by_day` tells which one a row is.

    Amounts are summed in minor units; `per_one` says how many of them make 1.
    """
    prepared, per_one = _in_units(ledger)
    return prepared.groupingSets(
        [["company_id", "day"], ["company_id", "counterparty_name"]], "company_id", "day", "counterparty_name"
    ).agg(
        (F.grouping("counterparty_name") == 1).alias("by_day"),
        _flow("in").alias("inflow"),
        _flow("out").alias("outflow"),
        F.sum("units").alias("volume"),
        _flow("in", "exchange").alias("crypto_in"),
        _flow("out", "exchange").alias("crypto_out"),
        _flow("in", "physical").alias("physical_in"),
        _flow("in", "legal").alias("legal_in"),
        F.count("*").alias("n"),
        F.count_if(F.col("direction") == "in").alias("n_in"),
        F.count_if(F.col("direction") == "out").alias("n_out"),
        F.lit(per_one).alias("per_one"),
    )


def days_of(rollup: DataFrame) -> DataFrame:
    return rollup.where(F.col("by_day")).select("company_id", "day", "inflow", "outflow", "volume")


def counterparties_of(rollup: DataFrame) -> DataFrame:
    return rollup.where(~F.col("by_day")).drop("by_day", "day")


def ledger_days(ledger: DataFrame) -> DataFrame:
    """In, out and volume per company and day in minor units, for measures that need ratios only."""
    prepared, _ = _in_units(ledger)
    return prepared.groupBy("company_id", "day").agg(
        _flow("in").alias("inflow"), _flow("out").alias("outflow"), F.sum("units").alias("volume")
    )


def daily_flow(ledger: DataFrame) -> DataFrame:
    """In and out per company and day; a direction without rows is 0."""
    prepared, per_one = _in_units(ledger)
    flows = prepared.groupBy("company_id", "day").agg(_flow("in").alias("inflow"), _flow("out").alias("outflow"))
    return flows.select("company_id", "day", *[in_money(F.col(c), per_one).alias(c) for c in ("inflow", "outflow")])


def fifo_holding_time(days: DataFrame) -> DataFrame:
    """Average age of money paid out, first in first out, in active days of each company.

    Running balances replace the queue. `held` is the balance with unmatched outflow dropped, so the
    matched outflow of a day is what leaves it. Matched outflow and inflow are then laid end to end on
    the same money axis: between two neighbouring boundaries one inflow day feeds one outflow day.
    Rows per company are bounded by its active days.
    """
    by_day = Window.partitionBy("company_id").orderBy("day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, 0)
    balances = (
        days.select("company_id", "day", "inflow", "outflow")
        .withColumn("day_no", F.row_number().over(by_day))
        .withColumn("balance", F.sum(F.col("inflow") - F.col("outflow")).over(so_far))
        .withColumn("held", F.col("balance") - F.least(F.lit(0), F.min("balance").over(so_far)))
        .withColumn("matched", F.col("inflow") + F.coalesce(F.lag("held").over(by_day), F.lit(0)) - F.col("held"))
        .withColumn("in_end", F.sum("inflow").over(so_far))
        .withColumn("out_end", F.sum("matched").over(so_far))
    )
    no_day = F.lit(None).cast("int")
    in_point = F.struct(F.col("in_end").alias("pos"), F.col("day_no").alias("in_day"), no_day.alias("out_day"))
    out_point = F.struct(F.col("out_end").alias("pos"), no_day.alias("in_day"), F.col("day_no").alias("out_day"))
    both = F.array(F.when(F.col("inflow") > 0, in_point), F.when(F.col("matched") > 0, out_point))
    points = balances.select("company_id", F.inline_outer(F.array_compact(both)))
    # From the far end of the axis, so that the frames grow and each row is added once.
    backward = Window.partitionBy("company_id").orderBy(F.desc("pos"))
    ahead = backward.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = (
        points.withColumn("length", (F.col("pos") - F.coalesce(F.lead("pos").over(backward), F.lit(0))).cast("double"))
        .withColumn("fed_by", F.min("in_day").over(ahead))
        .withColumn("paid_on", F.min("out_day").over(ahead))
    )
    used = F.when(F.col("paid_on").isNotNull() & (F.col("length") > 0), F.col("length"))
    age = F.greatest(F.lit(1), F.col("paid_on") - F.col("fed_by"))
    average_age = F.sum(used * age) / F.sum(used)
    return pieces.groupBy("company_id").agg(average_age.alias("age")).select(
        "company_id",
        F.when(F.col("age").isNull(), F.lit(NO_HOLDING_DAYS))
        .otherwise(F.round(F.greatest("age", F.lit(1.0)), 1))
        .alias("avg_holding_time"),
    )


def concentration(counterparties: DataFrame, k: int = 5) -> DataFrame:
    """Share of a company's whole volume that its k largest named counterparties carry."""
    whole = counterparties.groupBy("company_id").agg(F.sum("volume").alias("volume_all"))
    named = counterparties.where(F.col("counterparty_name").isNotNull())
    ranked = top_k(named, ["company_id"], [F.desc("volume"), F.asc("counterparty_name")], k)
    top = ranked.groupBy("company_id").agg(F.sum("volume").alias("volume_top"))
    return whole.join(top, "company_id", "left").select(
        "company_id",
        F.coalesce(share(F.col("volume_top"), F.col("volume_all")), F.lit(0.0)).alias("concentration_index"),
    )


def flow_entropy(days: DataFrame) -> DataFrame:
    """Entropy of the daily volume shares over its maximum: log2(T) - sum(a log2 a) / T, in one pass."""
    amount = F.col("volume").cast("double")
    positive = F.when(amount > 0, amount)
    total = F.sum(positive)
    entropy = F.log2(total) - F.sum(positive * F.log2(positive)) / total
    most = F.log2(F.greatest(F.count(positive), F.lit(2)).cast("double"))
    return days.groupBy("company_id").agg(
        F.coalesce(F.round(F.greatest(entropy / most, F.lit(0.0)), 4), F.lit(0.0)).alias("entropy_of_flows")
    )


def core_metrics(counterparties: DataFrame) -> DataFrame:
    money = ("inflow", "outflow", "crypto_in", "crypto_out", "physical_in", "legal_in")
    per_one = F.max("per_one")
    totals = counterparties.groupBy("company_id").agg(
        *[(F.sum(c).cast("double") / per_one).alias(c) for c in money],
        *[F.sum(c).cast("double").alias(c) for c in ("n", "n_in", "n_out")],
        F.count("counterparty_name").cast("double").alias("unique_counterparties"),
    )
    c = F.col
    received = at_least(c("inflow"), 1.0)
    volume = c("inflow") + c("outflow")
    return totals.select(
        "company_id",
        c("inflow").alias("total_inflow"),
        c("outflow").alias("total_outflow"),
        c("crypto_in").alias("crypto_inflow"),
        c("crypto_out").alias("crypto_outflow"),
        (c("physical_in") / received).alias("physical_inflow_ratio"),
        ((c("crypto_in") + c("crypto_out")) / at_least(volume, 1.0)).alias("crypto_exposure_ratio"),
        (c("outflow") / received).alias("dependency_ratio"),
        (c("legal_in") / received).alias("legal_inflow_ratio"),
        (c("crypto_in") / received).alias("exchange_inflow_ratio"),
        c("n").alias("total_transactions"),
        c("n_in").alias("inflow_count"),
        c("n_out").alias("outflow_count"),
        "unique_counterparties",
        volume.alias("total_volume"),
    )


def company_metrics(ledger: DataFrame) -> DataFrame:
    """All 17 metrics, one row per company."""
    rollup = materialize(ledger_rollup(ledger), "ledger-rollup")
    days, names = days_of(rollup), counterparties_of(rollup)
    return (
        core_metrics(names)
        .join(fifo_holding_time(days), "company_id")
        .join(concentration(names), "company_id")
        .join(flow_entropy(days), "company_id")
        .select("company_id", *METRICS)
    )


def inflow_structure(metrics: DataFrame) -> DataFrame:
    """Physical, legal and exchange shares of inflow, scaled to sum to 1 where there is any."""
    kinds = ["physical", "legal", "exchange"]
    total = sum((F.col(f"{k}_inflow_ratio") for k in kinds), F.lit(0.0))
    shares = [
        F.when(total > 0, F.col(f"{k}_inflow_ratio") / total).otherwise(F.col(f"{k}_inflow_ratio")).alias(f"{k}_share")
        for k in kinds
    ]
    return metrics.select("company_id", *shares)


def counterparty_network(ledger: DataFrame, k: int = 12, merge_types: bool = False) -> DataFrame:
    """Edges between a company and its k largest counterparties, with a drawing width.

    A counterparty seen under several types keeps one edge per type; with `merge_types` only the edge of
    its last type (by name) is kept.
    """
    prepared, per_one = _in_units(ledger)
    flows = materialize(
        prepared.where(F.col("counterparty_name").isNotNull())
        .groupBy("company_id", "counterparty_name", "counterparty_type", "direction")
        .agg(F.sum("units").alias("volume"), F.count("amount").alias("tx_count")),
        "counterparty-flows",
    )
    totals = flows.groupBy("company_id", "counterparty_name").agg(F.sum("volume").alias("total"))
    kept = top_k(totals, ["company_id"], [F.desc("total"), F.asc("counterparty_name")], k)
    edges = flows.join(kept.select("company_id", "counterparty_name"), ["company_id", "counterparty_name"])
    if merge_types:
        edges = edges.groupBy("company_id", "counterparty_name", "direction").agg(
            F.max_by(F.struct("counterparty_type", "volume", "tx_count"), "counterparty_type").alias("last")
        ).select("company_id", "counterparty_name", "direction", "last.*")
    inward = F.col("direction") == "in"
    widest = F.max("volume").over(Window.partitionBy("company_id")).cast("double")
    return edges.select(
        "company_id",
        "counterparty_name",
        "counterparty_type",
        F.when(inward, F.col("counterparty_name")).otherwise(F.col("company_id").cast("string")).alias("src"),
        F.when(inward, F.col("company_id").cast("string")).otherwise(F.col("counterparty_name")).alias("dst"),
        in_money(F.col("volume"), per_one).alias("volume"),
        "tx_count",
        (F.lit(0.5) + F.lit(3.0) * F.col("volume").cast("double") / widest).alias("width"),
    )


def metrics_long(metrics: DataFrame) -> DataFrame:
    """Metrics as (company, metric, value, display text)."""
    long = metrics.unpivot("company_id", METRICS, "metric", "value")
    percent = F.col("metric").endswith("_ratio") & (F.col("metric") != "dependency_ratio")
    money = F.col("metric").isin("total_inflow", "total_outflow", "crypto_inflow", "crypto_outflow", "total_volume")
    thousandth = F.col("metric").isin("dependency_ratio", "concentration_index")
    text = (
        F.when(percent, printed("%.1f%%", F.col("value") * 100))
        .when(thousandth, printed("%.3f", F.col("value")))
        .when(F.col("metric") == "avg_holding_time", printed("%.1f", F.col("value")))
        .when(F.col("metric") == "entropy_of_flows", printed("%.4f", F.col("value")))
        .when(money, F.format_number("value", 0))
        .otherwise(printed("%.0f", F.col("value")))
    )
    return long.withColumn("display", text)


def company_risk(metrics: DataFrame) -> DataFrame:
    """Weighted risk score with its contributions, normalised factors and level."""

    def scaled(name: str) -> Column:
        low, high = catalog.COMPANY_NORM_BOUNDS[name]
        value = F.coalesce(F.col(name), F.lit(catalog.COMPANY_METRIC_DEFAULTS[name])) if name in metrics.columns else (
            F.lit(catalog.COMPANY_METRIC_DEFAULTS[name])
        )
        return clip01((value - F.lit(low)) / F.lit(high - low))

    factors = {
        "dependency_ratio": scaled("dependency_ratio"),
        "crypto_exposure_ratio": scaled("crypto_exposure_ratio"),
        "concentration_index": scaled("concentration_index"),
        "inverse_holding_time": F.lit(1.0) - scaled("avg_holding_time"),
        "inverse_entropy": F.lit(1.0) - scaled("entropy_of_flows"),
    }
    parts = {name: F.lit(weight) * factors[name] for name, weight in catalog.COMPANY_WEIGHTS.items()}
    score = clip01(sum(parts.values(), F.lit(0.0)))
    level = band(score, catalog.COMPANY_BANDS, "Low")
    return metrics.select(
        "company_id",
        F.round(score, 4).alias("probability"),
        level.alias("risk_level"),
        *[column.alias(f"contribution_{name}") for name, column in parts.items()],
        *[F.round(column, 4).alias(f"normalized_{name}") for name, column in factors.items()],
    )


def with_level_labels(risk: DataFrame) -> DataFrame:
    """Localised label and sign of each level, looked up in the four-row level table."""
    labels = risk.sparkSession.createDataFrame(
        catalog.COMPANY_LEVEL_LABELS, "risk_level string, risk_label string, risk_sign string"
    )
    return risk.join(F.broadcast(labels), "risk_level", "left")


def factor_contributions(risk: DataFrame) -> DataFrame:
    """Contributions as rows with a severity colour."""
    stacked = risk.select(
        "company_id", *[F.col(f"contribution_{name}").alias(name) for name in catalog.COMPANY_WEIGHTS]
    )
    long = stacked.unpivot("company_id", list(catalog.COMPANY_WEIGHTS), "factor", "contribution")
    return long.withColumn("severity", band(F.col("contribution"), catalog.CONTRIBUTION_SEVERITY, "green"))
