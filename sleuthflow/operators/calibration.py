"""Calibration of scores: isotonic by pooling adjacent violators, Platt's logistic curve, and how well either does.

Both fits read distinct scores with their counts, in parts cut by rank; rows are read once for that. Pooling runs
inside the parts first. What is left of them are blocks of different shares of positives, and n rows cannot form
more than about 0.9 * n ** (2 / 3) blocks of different shares in rising order, since shares are fractions whose
denominators add up to n: a billion rows leave at most 900,000, and data that no one built for it some thousands.
That many are pooled once more in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sleuthflow.operators.evaluation import score_counts
from sleuthflow.session import materialize

BLOCK_SCHEMA = "low double, high double, n long, positives long"
SEGMENT_SCHEMA = "x0 double, x1 double, y0 double, y1 double, closed boolean"
#: Cells of the score axis by which scores meet the segments of a curve.
CELLS = 4096


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in rising order of score -> blocks of strictly rising shares; shares are compared as whole numbers."""
    kept: list[list] = []
    for batch in batches:
        for low, high, n, positives in zip(*(c.to_pylist() for c in batch.columns)):
            block = [low, high, n, positives]
            while kept and kept[-1][3] * block[2] >= block[3] * kept[-1][2]:
                before = kept.pop()
                block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
            kept.append(block)
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), (pa.float64(),) * 2 + (pa.int64(),) * 2)], ["low", "high", "n", "positives"])


def isotonic_curve(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(low, high, n, positives, value): blocks of scores with one calibrated value, rising with the score.

    The least-squares curve that never falls; equal to the mean of labels in each block. Rows without a score or
    with a label other than 0 and 1 are left out; no rows give no blocks.
    """
    counted = score_counts(scored.where(F.col(label).isin(0, 1)), score, label)
    single = counted.select("part", F.col("score").alias("low"), F.col("score").alias("high"), (F.col("tp") + F.col("fp")).alias("n"), F.col("tp").alias("positives"))
    columns = ["low", "high", "n", "positives"]

    def pool_part(part: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_pooled(iter(part.select(columns).sort_by("low").to_batches())))

    local = materialize(single.groupBy("part").applyInArrow(pool_part, BLOCK_SCHEMA), "pooled-parts")
    whole = local.repartition(1).sortWithinPartitions("low").mapInArrow(_pooled, BLOCK_SCHEMA)
    return materialize(whole.withColumn("value", F.col("positives") / F.col("n")), "isotonic-curve")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered blocks -> segments from x0 to x1, in turn a block and the line to the next; a block is closed below."""
    before = None
    for batch in batches:
        rows = []
        for low, high, value in zip(*(c.to_pylist() for c in batch.columns)):
            if before:
                rows.append((before[0], low, before[1], value, False))
            # The lower end of a block behind a line belongs to the line, whose value there is the same.
            rows.append((low, high, value, value, before is None))
            before = (high, value)
        if rows:
            types = (pa.float64(),) * 4 + (pa.bool_(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["x0", "x1", "y0", "y1", "closed"])


def apply_curve(scored: DataFrame, curve: DataFrame, score: str = "score", out: str = "calibrated") -> DataFrame:
    """`scored` with `out`: the value of the block of a score, between two blocks the straight line, else the nearest end.

    Segments and scores meet in an ordinary join by cells of the score axis. A null or NaN score stays null. The
    names x0, x1, y0, y1 and closed are taken by segments.
    """
    ends = curve.agg(F.min("low").alias("least"), F.max("high").alias("most")).first()
    if ends["least"] is None:
        return scored.withColumn(out, F.lit(None).cast("double"))
    least, most = ends["least"], ends["most"]
    width = (most - least) / CELLS or 1.0

    def cell(x: Column) -> Column:
        return F.least(F.greatest(F.floor((x - F.lit(least)) / F.lit(width)), F.lit(0)), F.lit(CELLS - 1)).cast("int")

    blocks = materialize(curve.select("low", "high", "value"), "curve")
    lines = blocks.repartition(1).sortWithinPartitions("low").mapInArrow(_segments, SEGMENT_SCHEMA)
    spread = materialize(lines.withColumn("_cell", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1"))))), "segments")
    x = F.col(score).cast("double")
    known = F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(x, F.lit(least)), F.lit(most)))
    placed = scored.withColumn("_x", known).withColumn("_cell", cell(F.col("_x")))
    # A segment holds its upper end, and the first one its lower end too, so that a score meets one of them.
    inside = (F.col("_x") <= F.col("x1")) & ((F.col("_x") > F.col("x0")) | ((F.col("_x") == F.col("x0")) & F.col("closed")))
    met = placed.join(spread.withColumnRenamed("_cell", "_of"), (F.col("_cell") == F.col("_of")) & inside, "left")
    rise = F.coalesce(F.try_divide(F.col("_x") - F.col("x0"), F.col("x1") - F.col("x0")), F.lit(0.0))
    value = F.col("y0") + (F.col("y1") - F.col("y0")) * rise
    return met.withColumn(out, F.when(F.col("_x") == F.col("x1"), F.col("y1")).otherwise(value)).drop("_x", "_cell", "_of", "x0", "x1", "y0", "y1", "closed")


def platt_curve(scored: DataFrame, score: str = "score", label: str = "label", steps: int = 50) -> tuple[float, float]:
    """(slope, offset) of the logistic curve of least log loss, with Platt's smoothed targets.

    Newton steps from a flat curve; each is one aggregate over the distinct scores, and is halved while the loss
    does not fall. Without both classes the curve stays flat.
    """
    counted = score_counts(scored.where(F.col(label).isin(0, 1)), score, label)
    totals = counted.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp")).first()
    positives, negatives = totals["tp"] or 0, totals["fp"] or 0
    high, low = (positives + 1) / (positives + 2), 1 / (negatives + 2)
    x, n = F.col("score"), F.col("tp") + F.col("fp")
    wanted = F.col("tp") * F.lit(high) + F.col("fp") * F.lit(low)

    def at(slope: float, offset: float):
        margin = F.lit(slope) * x + F.lit(offset)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
        # log(1 + exp(margin)) without overflow.
        loss = n * (F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))) - wanted * margin
        off, curved = n * p - wanted, n * p * (F.lit(1.0) - p)
        parts = {"loss": loss, "g0": off * x, "g1": off, "h00": curved * x * x, "h01": curved * x, "h11": curved}
        return counted.agg(*[F.sum(c).alias(k) for k, c in parts.items()]).first()

    slope, offset = 0.0, math.log((positives + 1) / (negatives + 1))
    if not positives or not negatives:
        return slope, offset
    here = at(slope, offset)
    for _ in range(steps):
        det = here["h00"] * here["h11"] - here["h01"] ** 2
        if det <= 1e-12 * max(here["h00"] * here["h11"], 1e-300):
            break
        by = ((here["h11"] * here["g0"] - here["h01"] * here["g1"]) / det, (here["h00"] * here["g1"] - here["h01"] * here["g0"]) / det)
        share = 1.0
        there = at(slope - by[0], offset - by[1])
        while there["loss"] > here["loss"] + 1e-12 * abs(here["loss"]) and share > 1e-6:
            share /= 2
            there = at(slope - share * by[0], offset - share * by[1])
        slope, offset, here = slope - share * by[0], offset - share * by[1], there
        if max(map(abs, by)) * share < 1e-10 * (1 + abs(slope) + abs(offset)):
            break
    return slope, offset


def platt(slope: float, offset: float, score: str = "score") -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * F.col(score) + F.lit(offset))))


def calibration_report(scored: DataFrame, probability: str, label: str = "label", bins: int = 10) -> DataFrame:
    """(n, brier, calibration_error): mean squared error, and mean gap of probability and outcome over equal bins."""
    p, y = F.col(probability), F.col(label).cast("double")
    binned = (
        scored.where(p.isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.least(F.floor(p * F.lit(bins)), F.lit(bins - 1)).alias("bin"))
        .agg(F.count("*").alias("n"), F.sum((p - y) * (p - y)).alias("square"), F.abs(F.sum(p - y)).alias("gap"))
    )
    return binned.agg(F.sum("n").alias("n"), (F.sum("square") / F.sum("n")).alias("brier"), (F.sum("gap") / F.sum("n")).alias("calibration_error"))
