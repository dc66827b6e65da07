"""Poisson bootstrap of classifier metrics in one aggregate, without storing a resampled table.

Every unit (rows of one key) is drawn a Poisson(1) number of times in each replicate. The draw is read from
md5(key:seed:chunk), four hex digits a replicate, so it depends neither on partitioning nor on the engine, and two
scores of the same rows meet the same draws.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from sleuthflow.session import materialize

#: Replicates that one digest serves: 32 hex digits, four each.
PER_DIGEST = 8
METRICS = ["roc_auc", "accuracy", "recall", "precision"]


def poisson_cuts(steps: int = 1 << 16) -> list[int]:
    """Where a draw from 0 to steps - 1 reaches the next number of times, of mean 1."""
    cuts, mass, total = [], math.exp(-1), 0.0
    for k in range(1, steps):
        total += mass
        cut = round(steps * total)
        if cut >= steps:
            break
        cuts.append(cut)
        mass /= k
    return cuts


def _times(place: int) -> Column:
    """How often a row is drawn in the replicate at this place of its chunk; replicate 0 is the sample itself."""
    digits = F.substring("_digest", 4 * place + 1, 4)
    cuts = poisson_cuts()
    drawn = F.when(F.col("_chunk") == 0, F.lit(1)) if place == 0 else F
    for times, cut in enumerate(cuts):
        drawn = drawn.when(digits < F.lit(f"{cut:04x}"), F.lit(times))
    return drawn.otherwise(F.lit(len(cuts))).cast("bigint")


def _drawn_counts(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(_score, _chunk, tp_*, fp_*, part): weighted counts of distinct scores, from the highest down in even parts.

    Rows are multiplied by the chunks only ahead of the map-side combine; what is shuffled are distinct scores.
    """
    chunks = replicates // PER_DIGEST
    spread = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks))))
    told = F.concat_ws(":", F.col("_key"), F.lit(str(seed)), F.col("_chunk").cast("string"))
    spread = spread.withColumn("_digest", F.md5(told.cast("binary")))
    drawn = spread.select("_score", "_chunk", "_label", *[_times(place).alias(f"_w{place}") for place in range(PER_DIGEST)])
    sums = []
    for place in range(PER_DIGEST):
        times = F.col(f"_w{place}")
        sums.append(F.sum(times * F.col("_label")).alias(f"tp_{place}"))
        sums.append(F.sum(times * (1 - F.col("_label"))).alias(f"fp_{place}"))
    counted = drawn.groupBy("_score", "_chunk").agg(*sums).repartitionByRange(F.desc("_score"))
    return materialize(counted.withColumn("part", F.spark_partition_id()), "drawn-counts")


def replicate_metrics(
    scored: DataFrame, key: str, score: str = "score", label: str = "label", threshold: float = 0.5, replicates: int = 200, seed: int = 7
) -> DataFrame:
    """(replicate, positives, negatives, roc_auc, accuracy, recall, precision), replicate 0 being the sample itself.

    Rows of one key are drawn together. Rows without a key or a score, or with a label other than 0 and 1, are left
    out; a metric without rows to be taken over is null. An empty table has no replicates. Ties of scores count half
    in the area. No task orders all scores: the running sums are taken inside parts and over part totals.
    """
    rows = scored.where(F.col(key).isNotNull() & F.col(score).isNotNull() & F.col(label).isin(0, 1)).select(
        F.col(key).cast("string").alias("_key"), F.col(score).cast("double").alias("_score"), F.col(label).cast("int").alias("_label")
    )
    down = Window.partitionBy("part", "_chunk").orderBy(F.desc("_score")).rowsBetween(Window.unboundedPreceding, 0)
    counted, taken = _drawn_counts(rows, replicates, seed), F.col("_score") > F.lit(threshold)
    upto = counted.select("*", *[F.sum(f"tp_{k}").over(down).alias(f"upto_{k}") for k in range(PER_DIGEST)])
    told = []
    for k in range(PER_DIGEST):
        tp, fp = F.col(f"tp_{k}"), F.col(f"fp_{k}")
        told.append(
            F.struct(
                F.lit(k).alias("place"),
                F.sum(fp.cast("double") * (F.col(f"upto_{k}") - tp / F.lit(2.0))).alias("won"),
                F.sum(tp).alias("p"),
                F.sum(fp).alias("n"),
                F.sum(F.when(taken, tp).otherwise(0)).alias("hit"),
                F.sum(F.when(taken, fp).otherwise(0)).alias("wrong"),
            )
        )
    # One row per part and replicate from here on.
    parts = upto.groupBy("part", "_chunk").agg(F.array(*told).alias("told")).select("part", "_chunk", F.inline("told"))
    parts = parts.withColumn("replicate", (F.col("_chunk") * PER_DIGEST + F.col("place")).cast("int")).where(F.col("replicate") <= replicates)
    before = Window.partitionBy("replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum("p").over(before), F.lit(0))
    parts = parts.withColumn("won", F.col("won") + F.col("n").cast("double") * above.cast("double"))
    whole = parts.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("won", "p", "n", "hit", "wrong")])
    p, n, hit, wrong = (F.col(c).cast("double") for c in ("p", "n", "hit", "wrong"))
    return whole.select(
        "replicate",
        F.col("p").alias("positives"),
        F.col("n").alias("negatives"),
        F.try_divide(F.col("won"), p * n).alias("roc_auc"),
        F.try_divide(hit + n - wrong, p + n).alias("accuracy"),
        F.try_divide(hit, p).alias("recall"),
        F.try_divide(hit, hit + wrong).alias("precision"),
    )


def _summary(long: DataFrame, coverage: float) -> DataFrame:
    """One row per metric from rows (replicate, metric, value)."""
    drawn = F.when(F.col("replicate") > 0, F.col("value"))
    tail = (1 - coverage) / 2
    ends = F.percentile(drawn, [tail, 1 - tail])
    return long.groupBy("metric").agg(
        F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("estimate"),
        F.stddev_samp(drawn).alias("deviation"),
        ends[0].alias("low"),
        ends[1].alias("high"),
        F.count(drawn).alias("n_used"),
        F.avg(F.when(drawn > 0, 1.0).when(drawn.isNotNull(), 0.0)).alias("above_zero"),
    )


def _long(wide: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return wide.select("replicate", F.inline(pairs))


def bootstrap_metrics(
    scored: DataFrame,
    key: str,
    score: str = "score",
    label: str = "label",
    threshold: float = 0.5,
    replicates: int = 200,
    coverage: float = 0.95,
    seed: int = 7,
) -> DataFrame:
    """(metric, estimate, deviation, low, high, n_used): percentile intervals of the four metrics.

    `n_used` counts the replicates in which the metric is defined. An empty table gives no rows.
    """
    drawn = replicate_metrics(scored, key, score, label, threshold, replicates, seed)
    return _summary(_long(drawn), coverage).drop("above_zero")


def bootstrap_difference(
    scored: DataFrame,
    key: str,
    first: str,
    second: str,
    label: str = "label",
    thresholds: tuple[float, float] = (0.5, 0.5),
    replicates: int = 200,
    coverage: float = 0.95,
    seed: int = 7,
) -> DataFrame:
    """(metric, estimate, deviation, low, high, n_used, above_zero): first score less second, drawn in pairs.

    `above_zero` is the share of replicates in which the first is better. Rows without both scores are left out.
    """
    both = scored.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(
        F.col(key).alias("_key"), F.col(first).alias("_a"), F.col(second).alias("_b"), F.col(label).alias("_label")
    )
    both = materialize(both, "scored-twice")
    sides = [
        _long(replicate_metrics(both, "_key", name, "_label", threshold, replicates, seed)).withColumnRenamed("value", name)
        for name, threshold in zip(("_a", "_b"), thresholds)
    ]
    paired = sides[0].join(sides[1], ["replicate", "metric"])
    return _summary(paired.select("replicate", "metric", (F.col("_a") - F.col("_b")).alias("value")), coverage)
