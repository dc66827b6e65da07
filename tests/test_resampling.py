import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sleuthflow.operators import evaluation, resampling

SCHEMA = "id string, a double, b double, label int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def sample(n=150, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        y = int(rng.random() < 0.4)
        base = rng.gauss(0.3 + 0.4 * y, 0.2)
        rows.append((f"r{k}", round(base, 2), round(base + rng.gauss(0, 0.4), 1), y))
    return rows


def times(key, replicate, seed):
    """Poisson(1) by its distribution function, from the digits of the digest."""
    if replicate == 0:
        return 1
    chunk, place = divmod(replicate, 8)
    digits = hashlib.md5(f"{key}:{seed}:{chunk}".encode()).hexdigest()[4 * place : 4 * place + 4]
    u, k, upto = int(digits, 16), 0, math.exp(-1)
    while u >= round(65536 * upto):
        k += 1
        upto += math.exp(-1) / math.factorial(k)
    return k


def plain(rows, place, replicate, threshold, seed=7):
    drawn = [(r[place], r[3], times(r[0], replicate, seed)) for r in rows]
    positives = [(s, w) for s, y, w in drawn if y == 1]
    negatives = [(s, w) for s, y, w in drawn if y == 0]
    p, n = sum(w for _, w in positives), sum(w for _, w in negatives)
    won = sum(v * w * (1.0 if s > t else 0.5 if s == t else 0.0) for s, v in positives for t, w in negatives)
    hit, wrong = sum(w for s, w in positives if s > threshold), sum(w for s, w in negatives if s > threshold)
    return p, n, won / (p * n), (hit + n - wrong) / (p + n), hit / p, hit / (hit + wrong)


def test_replicates_equal_plain_resampling(spark):
    rows = sample()
    found = {r.replicate: tuple(r)[1:] for r in resampling.replicate_metrics(frame(spark, rows), "id", "a", threshold=0.45, replicates=20).collect()}
    assert sorted(found) == list(range(21))
    for replicate, values in found.items():
        assert values == pytest.approx(plain(rows, 1, replicate, 0.45))


def test_intervals_hold_the_sample_and_agree_with_delong(spark):
    rows = sample(400)
    df = frame(spark, rows)
    told = {r.metric: r for r in resampling.bootstrap_metrics(df, "id", "a", threshold=0.45).collect()}
    one = evaluation.binary_metrics(df, "a", threshold=0.45).first()
    assert told["roc_auc"].estimate == pytest.approx(one.roc_auc) and told["accuracy"].estimate == pytest.approx(one.accuracy)
    assert set(told) == set(resampling.METRICS)
    assert all(r.low < r.estimate < r.high and r.n_used == 200 for r in told.values())
    exact = evaluation.compare_auc(df, "a", "b").first()
    drawn = {r.metric: r for r in resampling.bootstrap_difference(df, "id", "a", "b").collect()}["roc_auc"]
    assert drawn.estimate == pytest.approx(exact.difference)
    assert drawn.deviation == pytest.approx(exact.deviation, rel=0.2)
    assert drawn.above_zero == 1.0 and exact.z > 3


def test_draws_have_mean_and_variance_one():
    weights = [times(f"k{k}", 1 + k % 7, 7) for k in range(20_000)]
    assert statistics.mean(weights) == pytest.approx(1, abs=0.03) and statistics.variance(weights) == pytest.approx(1, abs=0.05)
    assert resampling.poisson_cuts()[0] == round(65536 / math.e)


def test_partitioning_does_not_matter_and_one_score_holds_a_third(spark):
    rows = [(i, 0.5 if k % 3 == 0 else a, b, y) for k, (i, a, b, y) in enumerate(sample(300))]
    ways = [spark.createDataFrame(rows, SCHEMA).repartition(n, "label") for n in (1, 9)]
    told = [sorted(resampling.replicate_metrics(w, "id", "a", replicates=9).collect()) for w in ways]
    assert told[0] == told[1]
    assert tuple(told[0][5])[1:] == pytest.approx(plain(rows, 1, 5, 0.5))


def test_rows_of_one_key_are_drawn_together(spark):
    rows = [(f"c{k // 4}", a, b, y) for k, (_, a, b, y) in enumerate(sample(120))]
    one = resampling.replicate_metrics(frame(spark, rows), "id", "a", replicates=3, threshold=0.45).where("replicate = 2").first()
    assert tuple(one)[1:] == pytest.approx(plain(rows, 1, 2, 0.45))


def test_missing_values_other_labels_and_clashing_names(spark):
    rows = sample(60)
    holes = [(None, 0.5, 0.5, 1), ("x", None, 0.5, 0), ("y", 0.5, 0.5, None), ("z", 0.5, 0.5, 2)]
    extra = frame(spark, [*rows, *holes]).withColumn("part", F.lit(1)).withColumn("_key", F.lit("k")).withColumn("replicate", F.lit(0))
    clean = sorted(resampling.replicate_metrics(frame(spark, rows), "id", "a", replicates=4).collect())
    assert sorted(resampling.replicate_metrics(extra, "id", "a", replicates=4).collect()) == clean


def test_one_class_and_empty(spark):
    df = frame(spark, sample(60))
    told = {r.metric: r for r in resampling.bootstrap_metrics(df.where("label = 1"), "id", "a", replicates=16).collect()}
    assert (told["roc_auc"].estimate, told["roc_auc"].n_used, told["roc_auc"].low) == (None, 0, None)
    assert told["recall"].n_used == 16
    assert resampling.bootstrap_metrics(df.limit(0), "id", "a").count() == 0
    assert resampling.bootstrap_difference(df.limit(0), "id", "a", "b").count() == 0
