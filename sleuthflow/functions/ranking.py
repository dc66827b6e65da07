"""Top-k inside groups and exact order statistics without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sleuthflow.session import materialize


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """First k rows per group. The rank filter prunes to k rows per map task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], bins: int = 4096, most_ordered: int = 100_000
) -> DataFrame:
    """Quantiles with linear interpolation, one row per (keys, p).

    Distinct values are counted first, so ties cost nothing. While a span that holds a wanted rank has more than
    `most_ordered` of them, each round cuts it into `bins` equal cells between its own smallest and largest value and
    keeps the one cell the rank falls in; crowded cells take more rounds. Only the distinct values left are ordered.
    """
    counted = materialize(df.groupBy(*keys, value).agg(F.count("*").alias("_n")), "distinct-values")
    spans = counted.groupBy(*keys).agg(
        F.sum("_n").alias("_total"), F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("_distinct")
    )
    targets = (
        spans.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_pos", F.col("p") * (F.col("_total") - 1))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
        .withColumn("_before", F.lit(0).cast("bigint"))
        .drop("_total")
    )
    targets = materialize(targets, "rank-spans")
    left, before = targets.agg(F.max("_distinct")).first()[0] or 0, None
    # Values that no cell can part, below the smallest step of a double, are ordered as they are.
    while left > most_ordered and left != before:
        targets = materialize(_narrowed(counted, targets, keys, value, bins), "rank-spans")
        left, before = targets.agg(F.max("_distinct")).first()[0], left
    targets = targets.drop("_distinct")
    inside = Window.partitionBy(*keys, "_low").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ordered = (
        _within(counted, targets, keys, value)
        .withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .drop("_before", "_high")
    )
    picked = targets.join(ordered, [*keys, "_low"]).where(
        (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end"))
    )
    low, high = F.min(value), F.max(value)
    fraction = F.col("_pos") - F.floor("_pos")
    return picked.groupBy(*keys, "p", "_pos").agg((low + (high - low) * fraction).alias("q")).drop("_pos")


def _within(counted: DataFrame, targets: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values inside the spans of the targets; a key has at most two spans per probability."""
    spans = targets.select(*keys, "_low", "_high", "_before").distinct()
    return counted.join(spans, keys).where(F.col(value).between(F.col("_low"), F.col("_high")))


def _narrowed(counted: DataFrame, targets: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Targets with their span cut down to the cell that holds their rank."""
    width = (F.col("_high") - F.col("_low")) / F.lit(float(bins))
    cell = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_low")) / width), F.lit(bins - 1))).otherwise(0)
    running = Window.partitionBy(*keys, "_low").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = (
        _within(counted, targets, keys, value)
        .groupBy(*keys, "_low", "_before", cell.alias("_cell"))
        .agg(
            F.sum("_n").alias("_cell_n"), F.min(value).alias("_cell_low"), F.max(value).alias("_cell_high"), F.count("*").alias("_cell_distinct")
        )
        .withColumn("_upto", F.col("_before") + F.sum("_cell_n").over(running))
        .drop("_before", "_cell")
    )
    found = targets.drop("_high", "_before", "_distinct").join(cells, [*keys, "_low"]).where(
        (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_cell_n"))
    )
    return found.select(
        *keys,
        "p",
        "_pos",
        "_rank",
        F.col("_cell_low").alias("_low"),
        F.col("_cell_high").alias("_high"),
        (F.col("_upto") - F.col("_cell_n")).alias("_before"),
        F.col("_cell_distinct").alias("_distinct"),
    )
