import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sleuthflow.operators import calibration


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "score double, label int").repartition(parts)


def sample(n=400, seed=3, digits=2):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x = round(rng.random(), digits)
        rows.append((x, int(rng.random() < x * x)))
    return rows


def pooled(rows):
    """Greatest over starts of the least over ends of the means between them."""
    scores = sorted({s for s, _ in rows})
    n = [sum(s == x for s, _ in rows) for x in scores]
    p = [sum(label for s, label in rows if s == x) for x in scores]
    value = []
    for i in range(len(scores)):
        value.append(max(min(Fraction(sum(p[j : k + 1]), sum(n[j : k + 1])) for k in range(i, len(scores))) for j in range(i + 1)))
    return dict(zip(scores, value))


@pytest.mark.parametrize("parts", [1, 7])
def test_isotonic_curve_is_the_least_squares_curve(spark, parts):
    rows = sample(digits=1) + [(0.55, 0), (0.55, 1), (0.55, 1)]
    expected = pooled(rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        curve = calibration.isotonic_curve(frame(spark, [*rows, (None, 1), (0.3, None), (0.2, 7)])).orderBy("low").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sum(b.n for b in curve) == len(rows) and sum(b.positives for b in curve) == sum(y for _, y in rows)
    assert all(a.value < b.value and a.high < b.low for a, b in zip(curve, curve[1:]))
    for score, value in expected.items():
        assert [b.value for b in curve if b.low <= score <= b.high] == [float(value)]


def test_rising_shares_stay_apart_and_falling_ones_become_one_block(spark):
    rising = [(x / 10, int(k < x)) for x in range(10) for k in range(9)]
    assert calibration.isotonic_curve(frame(spark, rising)).count() == 10
    falling = [(1 - s, y) for s, y in rising]
    assert [tuple(r) for r in calibration.isotonic_curve(frame(spark, falling)).select("n", "positives").collect()] == [(90, 45)]


def test_curve_applied_between_and_beyond_blocks(spark):
    curve = spark.createDataFrame([(0.2, 0.4, 0.1), (0.6, 0.6, 0.5), (0.7, 0.9, 0.8)], "low double, high double, value double")
    scores = [0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.65, 0.7, 0.9, 1.5, None, float("nan")]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(scores)], "id int, score double").repartition(3)
    found = {r.id: r.calibrated for r in calibration.apply_curve(rows, curve).collect()}
    expected = [0.1, 0.1, 0.1, 0.1, 0.3, 0.5, 0.65, 0.8, 0.8, 0.8, None, None]
    assert len(found) == len(scores)
    for k, value in enumerate(expected):
        assert found[k] is None if value is None else found[k] == pytest.approx(value)


def test_one_block_and_no_block(spark):
    rows = frame(spark, [(0.5, 1), (0.5, 0)])
    curve = calibration.isotonic_curve(rows)
    assert {r.calibrated for r in calibration.apply_curve(rows, curve).collect()} == {0.5}
    nothing = calibration.isotonic_curve(rows.limit(0))
    assert nothing.count() == 0
    assert [r.calibrated for r in calibration.apply_curve(rows, nothing).collect()] == [None, None]


def test_platt_curve_has_no_better_neighbour(spark):
    rows = sample()
    slope, offset = calibration.platt_curve(frame(spark, rows))
    positives, negatives = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    high, low = (positives + 1) / (positives + 2), 1 / (negatives + 2)

    def loss(a, b):
        total = 0.0
        for x, y in rows:
            p, t = 1 / (1 + math.exp(-(a * x + b))), high if y else low
            total -= t * math.log(p) + (1 - t) * math.log(1 - p)
        return total

    best = loss(slope, offset)
    assert all(loss(slope + i, offset + j) > best for i in (-1e-3, 0, 1e-3) for j in (-1e-3, 0, 1e-3) if i or j)


def test_separable_and_single_class_scores(spark):
    slope, _ = calibration.platt_curve(frame(spark, [(0.1, 0)] * 20 + [(0.9, 1)] * 20))
    assert math.isfinite(slope) and slope > 0
    assert calibration.platt_curve(frame(spark, [(0.1, 1), (0.9, 1)])) == (0.0, math.log(3))
    assert calibration.platt_curve(frame(spark, [(0.5, 0), (0.5, 1)]))[0] == 0.0


def test_calibration_lowers_the_error(spark):
    rows = frame(spark, sample(4000, digits=3))
    curve = calibration.isotonic_curve(rows)
    told = calibration.apply_curve(rows, curve, out="p")
    raw, fitted = (calibration.calibration_report(rows.withColumn("p", F.col("score")), "p").first(), calibration.calibration_report(told, "p").first())
    assert fitted.n == raw.n == 4000
    assert fitted.brier < raw.brier and fitted.calibration_error < 0.01 < raw.calibration_error


def test_hot_score(spark):
    """A third of the rows in one score: counted before anything is ordered."""
    rows = sample(1000) + [(0.37, k % 2) for k in range(500)]
    curve = calibration.isotonic_curve(frame(spark, rows))
    assert curve.agg(F.sum("n")).first()[0] == 1500
    assert calibration.apply_curve(frame(spark, rows), curve).where(F.col("calibrated").isNull()).count() == 0
