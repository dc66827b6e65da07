"""Train/test split and classifier metrics without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sleuthflow.session import materialize

PREFIX = 4


def stratified_split(df: DataFrame, key: str, label: str = "label", test_share: float = 0.2) -> DataFrame:
    """`is_test` for an exact share of every class: the first rows of a class in md5(key) order.

    A histogram over the first hash digits finds the digit group where the share is reached; only the
    rows of that group are ordered. The split does not depend on partitioning or on the run. `df` is
    read three times, so pass a table rather than a long plan.
    """
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    hashed = df.withColumn("_md5", digest).withColumn("_prefix", F.substring("_md5", 1, PREFIX))
    running = Window.partitionBy(label).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    histogram = (
        hashed.groupBy(label, "_prefix")
        .agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(label)))
        .withColumn("_quota", F.ceil(F.col("_total") * F.lit(test_share)))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
    )
    border = histogram.where((F.col("_before") < F.col("_quota")) & (F.col("_upto") >= F.col("_quota"))).select(
        label, F.col("_prefix").alias("_border"), "_before", "_quota"
    )
    # One border row per class: the broadcast side is as long as the list of classes.
    placed = hashed.join(F.broadcast(border), label, "left")
    inside = F.col("_prefix") == F.col("_border")
    order = Window.partitionBy(label, "_prefix").orderBy("_md5", key)
    ranked = placed.where(inside).withColumn("is_test", F.row_number().over(order) + F.col("_before") <= F.col("_quota"))
    clear = placed.where(~inside | F.col("_border").isNull()).withColumn(
        "is_test", F.coalesce(F.col("_prefix") < F.col("_border"), F.lit(False))
    )
    extra = ["_md5", "_prefix", "_border", "_before", "_quota"]
    return ranked.unionByName(clear).drop(*extra)


def binary_metrics(scored: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Accuracy, recall, precision, confusion counts and the area under the curve, one row."""
    points = score_points(score_counts(scored, score, label))
    positive = F.col("score") > F.lit(threshold)
    counts = {
        "true_negatives": F.sum(F.when(~positive, F.col("fp")).otherwise(0)),
        "false_positives": F.sum(F.when(positive, F.col("fp")).otherwise(0)),
        "false_negatives": F.sum(F.when(~positive, F.col("tp")).otherwise(0)),
        "true_positives": F.sum(F.when(positive, F.col("tp")).otherwise(0)),
    }
    # Each negative of a score loses to the positives above it and halves with those at the same score.
    won = F.col("fp").cast("double") * (F.col("tp_upto").cast("double") - F.col("tp").cast("double") / F.lit(2.0))
    totals = points.agg(*[column.alias(name) for name, column in counts.items()], F.sum(won).alias("won"))
    c = F.col

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))

    hits = c("true_positives") + c("true_negatives")
    positives = c("true_positives") + c("false_negatives")
    negatives = c("true_negatives") + c("false_positives")
    return totals.select(
        ratio(hits, positives + negatives).alias("accuracy"),
        ratio(c("won"), positives * negatives).alias("roc_auc"),
        ratio(c("true_positives"), positives).alias("recall_pyramid"),
        ratio(c("true_positives"), c("true_positives") + c("false_positives")).alias("precision_pyramid"),
        *counts,
    )


def score_counts(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Distinct scores with their positives and negatives, from the highest down in parts of even size.

    The parts are cut by rank, so scores crowded into a sliver of their range are split too. Rows without a
    score are left out.
    """
    counted = scored.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("tp"), F.count_if(F.col(label) == 0).alias("fp")
    )
    ranged = counted.where(F.col("score").isNotNull()).repartitionByRange(F.desc("score"))
    return materialize(ranged.withColumn("part", F.spark_partition_id()), "score-counts")


def score_points(counted: DataFrame) -> DataFrame:
    """Distinct scores with their counts and the cumulative counts from the highest score down.

    The running sum is taken inside the parts and over their totals, one row per part, so no task orders all
    scores. `next_*` are the counts of the next lower score.
    """
    down = Window.orderBy("part")
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(F.struct("score", "tp", "fp")).alias("top")
    offsets = (
        counted.groupBy("part")
        .agg(F.sum("tp").alias("part_tp"), F.sum("fp").alias("part_fp"), top)
        .select(
            "part",
            F.coalesce(F.sum("part_tp").over(above), F.lit(0)).alias("tp_above"),
            F.coalesce(F.sum("part_fp").over(above), F.lit(0)).alias("fp_above"),
            F.lead("top").over(down).alias("below"),
        )
    )
    inside = Window.partitionBy("part").orderBy(F.desc("score"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # One offset row per part, that is per shuffle partition.
    return counted.join(F.broadcast(offsets), "part").select(
        "score",
        "tp",
        "fp",
        (F.col("tp_above") + F.sum("tp").over(upto)).alias("tp_upto"),
        (F.col("fp_above") + F.sum("fp").over(upto)).alias("fp_upto"),
        F.coalesce(F.lead("tp").over(inside), F.col("below.tp")).alias("next_tp"),
        F.coalesce(F.lead("fp").over(inside), F.col("below.fp")).alias("next_fp"),
        ((F.col("tp_above") == 0) & (F.col("fp_above") == 0) & (F.row_number().over(inside) == 1)).alias("is_first"),
    )


def roc_curve(
    scored: DataFrame, score: str = "score", label: str = "label", drop_collinear: bool = True
) -> DataFrame:
    """(threshold, fpr, tpr) from the highest score down, after the start (Infinity, 0, 0).

    `drop_collinear` leaves out a point whose neighbours lie on the same straight step.
    """
    counted = score_counts(scored, score, label)
    points = score_points(counted)
    if drop_collinear:
        bend = (F.col("next_tp") != F.col("tp")) | (F.col("next_fp") != F.col("fp"))
        points = points.where(F.coalesce(bend, F.lit(True)) | F.col("is_first"))
    totals = counted.agg(F.sum("tp").alias("positives"), F.sum("fp").alias("negatives"))
    start = totals.select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    positives, negatives = (totals.select(c).scalar() for c in ("positives", "negatives"))
    curve = points.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp_upto").cast("double"), negatives.cast("double")).alias("fpr"),
        F.try_divide(F.col("tp_upto").cast("double"), positives.cast("double")).alias("tpr"),
    )
    return start.unionByName(curve)


def _placements(scored: DataFrame, score: str, label: str) -> DataFrame:
    """(score, higher): per distinct score, share of the other class that a positive beats, and that beats a negative."""
    points = materialize(score_points(score_counts(scored, score, label)), "score-points")
    totals = points.agg(F.sum("tp").alias("m"), F.sum("fp").alias("n")).first()
    m, n = float(totals["m"] or 0), float(totals["n"] or 0)
    below = F.lit(n) - F.col("fp_upto") + F.col("fp") / F.lit(2.0)
    above = F.col("tp_upto") - F.col("tp") / F.lit(2.0)
    return points.select("score", F.try_divide(below, F.lit(n)).alias("beaten"), F.try_divide(above, F.lit(m)).alias("beating"))


def compare_auc(scored: DataFrame, first: str, second: str, label: str = "label") -> DataFrame:
    """(auc_first, auc_second, difference, deviation, z): two scores of the same rows by DeLong's test, one row.

    The deviation is that of the difference, with the covariance of both scores. Rows without both scores or with
    a label other than 0 and 1 are left out; without two rows of each class the deviation is null.
    """
    rows = materialize(
        scored.where(F.col(label).isin(0, 1) & F.col(first).isNotNull() & F.col(second).isNotNull())
        .select(F.col(label).alias("label"), F.col(first).cast("double").alias("a"), F.col(second).cast("double").alias("b")),
        "scored-twice",
    )
    placed = rows
    for name in ("a", "b"):
        found = _placements(rows, name, "label").select(F.col("score").alias(name), F.col("beaten").alias(f"{name}_1"), F.col("beating").alias(f"{name}_0"))
        placed = placed.join(materialize(found, "placements"), name)
    parts = {}
    for k in (1, 0):
        of = [F.when(F.col("label") == k, F.col(f"{name}_{k}")) for name in ("a", "b")]
        parts |= {f"n{k}": F.count(of[0]), f"auc_a{k}": F.avg(of[0]), f"auc_b{k}": F.avg(of[1])}
        # Both variances less twice the covariance, without what their rounding leaves.
        parts |= {f"v{k}": F.var_samp(of[0] - of[1])}
    told = placed.agg(*[c.alias(n) for n, c in parts.items()])
    known = (F.col("n1") > 1) & (F.col("n0") > 1)
    deviation = F.when(known, F.sqrt(F.greatest(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"), F.lit(0.0))))
    difference = F.col("auc_a1") - F.col("auc_b1")
    return told.select(
        F.col("auc_a1").alias("auc_first"), F.col("auc_b1").alias("auc_second"), difference.alias("difference"),
        deviation.alias("deviation"), F.try_divide(difference, deviation).alias("z"),
    )
