"""Change of features or scores between two populations: stability index and two-sample Kolmogorov-Smirnov distance.

Both come from one count of distinct values per feature, which merges over days or files by addition. Running sums
are taken inside ranges of values and over the totals of the ranges, so no task orders a whole feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sleuthflow.session import materialize

#: Least share of a cell in the stability index, so that an empty one counts without an infinite logarithm.
LEAST_SHARE = 1e-4


def value_counts(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, n_reference, n_current) of every distinct value; null and NaN values are left out."""
    parts = []
    for rows, flag in ((reference, 0), (current, 1)):
        entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
        parts.append(rows.select(F.inline(entries), F.lit(flag).alias("is_current")))
    long = parts[0].unionByName(parts[1]).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy("feature", "value").agg(
        F.count_if(F.col("is_current") == 0).alias("n_reference"), F.count_if(F.col("is_current") == 1).alias("n_current")
    )


def _cumulated(counts: DataFrame) -> DataFrame:
    """Counts with the counts up to each value, per feature."""
    # Stored first: the range split reads its input twice, once for a sample.
    ranged = materialize(counts, "distinct-values").repartitionByRange("feature", "value").withColumn("part", F.spark_partition_id())
    stored = materialize(ranged, "value-counts")
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored.groupBy("feature", "part").agg(F.sum("n_reference").alias("_r"), F.sum("n_current").alias("_c"))
    offsets = offsets.select(
        "feature", "part", F.coalesce(F.sum("_r").over(before), F.lit(0)).alias("_before_r"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before_c")
    )
    inside = Window.partitionBy("feature", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    # One offset row per feature and shuffle partition.
    return stored.join(F.broadcast(offsets), ["feature", "part"]).select(
        "feature", "value", "n_reference", "n_current",
        (F.col("_before_r") + F.sum("n_reference").over(inside)).alias("upto_reference"),
        (F.col("_before_c") + F.sum("n_current").over(inside)).alias("upto_current"),
    )


def _quantiles(cumulated: DataFrame, totals: DataFrame, probs: list[float]) -> DataFrame:
    """(feature, p, q): quantiles of the reference with linear interpolation, looked up in its cumulated counts."""
    position = F.col("p") * (F.col("n_reference") - 1)
    targets = (
        totals.where(F.col("n_reference") > 0)
        .select("feature", "n_reference", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
        .select("feature", "p", position.alias("_pos"))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
    )
    ranked = cumulated.where(F.col("n_reference") > 0).select(
        "feature", "value", "upto_reference", (F.col("upto_reference") - F.col("n_reference")).alias("_start")
    )
    # Two rows per feature and probability.
    picked = ranked.join(F.broadcast(targets), "feature").where((F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("upto_reference")))
    low, high = F.min("value"), F.max("value")
    return picked.groupBy("feature", "p", "_pos").agg((low + (high - low) * (F.col("_pos") - F.floor("_pos"))).alias("q")).drop("_pos")


def drift(reference: DataFrame, current: DataFrame, features: list[str], cells: int = 10) -> DataFrame:
    """(feature, n_reference, n_current, stability_index, ks): how far each feature has moved.

    The stability index compares shares over cells between the quantiles of the reference, an edge belonging to
    the cell below it; `ks` is the largest gap of the two distribution functions. A feature that one population
    lacks has nulls; one that both lack has no row.
    """
    counts = materialize(_cumulated(value_counts(reference, current, features)), "drift-counts")
    totals = counts.groupBy("feature").agg(F.sum("n_reference").alias("n_reference"), F.sum("n_current").alias("n_current"))
    edges = _quantiles(counts, totals, [k / cells for k in range(1, cells)])
    # As long as the list of features.
    lists = edges.groupBy("feature").agg(F.collect_list("q").alias("_edges"))
    sized = counts.join(F.broadcast(totals.withColumnsRenamed({"n_reference": "_all_r", "n_current": "_all_c"})), "feature")
    celled = sized.join(F.broadcast(lists), "feature", "left").withColumn("_cell", F.size(F.filter("_edges", lambda e: e < F.col("value"))))
    gap = F.abs(F.try_divide("upto_reference", "_all_r") - F.try_divide("upto_current", "_all_c"))
    by_cell = celled.groupBy("feature", "_cell").agg(
        F.sum("n_reference").alias("r"), F.sum("n_current").alias("c"), F.max("_all_r").alias("all_r"), F.max("_all_c").alias("all_c"), F.max(gap).alias("gap")
    )
    share = [F.greatest(F.try_divide(n, total), F.lit(LEAST_SHARE)) for n, total in ((F.col("r"), F.col("all_r")), (F.col("c"), F.col("all_c")))]
    moved = (share[1] - share[0]) * F.log(share[1] / share[0])
    both = (F.col("n_reference") > 0) & (F.col("n_current") > 0)
    return (
        by_cell.groupBy("feature").agg(F.max("all_r").alias("n_reference"), F.max("all_c").alias("n_current"), F.sum(moved).alias("_psi"), F.max("gap").alias("_ks"))
        .select("feature", "n_reference", "n_current", F.when(both, F.col("_psi")).alias("stability_index"), F.when(both, F.col("_ks")).alias("ks"))
    )
