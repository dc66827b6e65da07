import math
import random

import pytest
from pyspark.sql import functions as F

from sleuthflow.operators import drift, evaluation


def frame(spark, rows, schema="x double, y double"):
    return spark.createDataFrame(rows, schema).repartition(5)


def quantile(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = math.floor(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


def plain(reference, current):
    edges = [quantile(reference, k / 10) for k in range(1, 10)]

    def share(values, cell):
        return max(sum(sum(e < v for e in edges) == cell for v in values) / len(values), drift.LEAST_SHARE)

    psi = 0.0
    for cell in range(10):
        if any(sum(e < v for e in edges) == cell for v in reference + current):
            a, b = share(reference, cell), share(current, cell)
            psi += (b - a) * math.log(b / a)
    ks = max(abs(sum(r <= v for r in reference) / len(reference) - sum(c <= v for c in current) / len(current)) for v in reference + current)
    return psi, ks


def test_drift_equals_the_plain_one(spark):
    rng = random.Random(2)
    reference = [(rng.gauss(0, 1), round(rng.random(), 1)) for _ in range(300)]
    current = [(rng.gauss(0.4, 1), round(rng.random(), 1)) for _ in range(170)]
    holes = [(None, 0.5), (float("nan"), 0.5)]
    found = {r.feature: r for r in drift.drift(frame(spark, reference), frame(spark, current + holes), ["x", "y"]).collect()}
    for k, name in enumerate("xy"):
        theirs = [r[k] for r in current] + ([0.5, 0.5] if name == "y" else [])
        psi, ks = plain([r[k] for r in reference], theirs)
        assert (found[name].n_reference, found[name].n_current) == (300, len(theirs))
        assert found[name].stability_index == pytest.approx(psi) and found[name].ks == pytest.approx(ks)
    assert found["x"].ks > 2 * found["y"].ks


def test_equal_and_missing_populations(spark):
    rows = frame(spark, [(k / 7, float(k % 3)) for k in range(60)])
    same = drift.drift(rows, rows, ["x", "y"]).collect()
    assert [(r.stability_index, r.ks) for r in same] == [(0.0, 0.0)] * 2
    lacking = drift.drift(rows, rows.limit(0), ["x"]).collect()
    assert [(r.n_reference, r.n_current, r.stability_index, r.ks) for r in lacking] == [(60, 0, None, None)]
    assert drift.drift(rows.limit(0), rows, ["x"]).first().ks is None
    assert drift.drift(rows.limit(0), rows.limit(0), ["x"]).count() == 0


def test_a_third_of_the_rows_in_one_value(spark):
    rows = frame(spark, [(0.0 if k % 3 == 0 else k / 100, 1.0) for k in range(900)])
    moved = rows.withColumn("x", F.when(F.col("x") == 0, 5.0).otherwise(F.col("x")))
    found = drift.drift(rows, moved, ["x", "y"]).collect()
    assert {r.feature: round(r.ks, 6) for r in found}["x"] == pytest.approx(1 / 3, abs=0.01)
    assert {r.feature: r.stability_index for r in found}["y"] == 0


def sample(n=120, seed=4, digits=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        y = int(rng.random() < 0.4)
        base = rng.gauss(y, 1)
        rows.append((round(base + rng.gauss(0, 0.4), digits), round(base + rng.gauss(0, 1.5), digits), y))
    return rows


def delong(rows):
    """From all pairs of a positive and a negative."""

    def won(x, y):
        return 1.0 if x > y else 0.5 if x == y else 0.0

    positives, negatives = [r for r in rows if r[2] == 1], [r for r in rows if r[2] == 0]
    out = []
    for mine, others, turn in ((positives, negatives, 1), (negatives, positives, -1)):
        out.append([[sum(won(turn * r[k], turn * o[k]) for o in others) / len(others) for k in (0, 1)] for r in mine])
    auc = [sum(v[k] for v in out[0]) / len(out[0]) for k in (0, 1)]
    variance = 0.0
    for part in out:
        gaps = [a - b for a, b in part]
        mean = sum(gaps) / len(gaps)
        variance += sum((g - mean) ** 2 for g in gaps) / (len(gaps) - 1) / len(gaps)
    return auc, math.sqrt(variance)


def test_two_scores_compared(spark):
    rows = sample()
    auc, deviation = delong(rows)
    df = frame(spark, [*rows, (None, 1.0, 1), (1.0, None, 0), (0.5, 0.5, None)], "a double, b double, label int")
    found = evaluation.compare_auc(df, "a", "b").first()
    assert (found.auc_first, found.auc_second) == pytest.approx(tuple(auc))
    assert found.deviation == pytest.approx(deviation) and found.z == pytest.approx((auc[0] - auc[1]) / deviation)
    back = evaluation.compare_auc(df, "b", "a").first()
    assert back.z == pytest.approx(-found.z)


def test_a_score_against_itself_and_too_few_rows(spark):
    df = frame(spark, sample(40), "a double, b double, label int")
    same = evaluation.compare_auc(df, "a", "a").first()
    assert same.difference == 0 and same.deviation == pytest.approx(0, abs=1e-9) and same.auc_first == same.auc_second
    one = evaluation.compare_auc(df.where("label = 1"), "a", "b").first()
    assert (one.deviation, one.z) == (None, None)
    assert evaluation.compare_auc(df.limit(0), "a", "b").first().auc_first is None


def test_each_population_is_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(x):
        seen.add(1)
        return x

    once = F.udf(passed, "double").asNondeterministic()
    rows = spark.range(500).select((F.col("id") % 37).cast("double").alias("x"))
    found = drift.drift(rows.select(once("x").alias("x")), rows.where("x > 3"), ["x"]).collect()
    assert seen.value == 500
    assert (found[0].n_reference, found[0].n_current) == (500, rows.where("x > 3").count())
