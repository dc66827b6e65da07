import random

import pytest
from pyspark.sql import functions as F

from sleuthflow import catalog
from sleuthflow.functions.ranking import exact_quantiles
from sleuthflow.functions.skew import attach
from sleuthflow.operators import evaluation, quality


def population(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = i % 2
        row = {name: low + (high - low) * min(1.0, rng.random() * 0.8 + 0.1 * label) for name, (low, high) in catalog.FEATURE_BOUNDS.items()}
        row["referral_ratio"] = min(1.0, row["growth_rate"] / 1.2)
        row["gini_coefficient"] = max(0.1, row["centralization_index"])
        rows.append((f"e{i}", *[row[f] for f in catalog.FEATURES], label, i % 20 < 3))
    schema = "entity_id string, " + ", ".join(f"{f} double" for f in catalog.FEATURES) + ", label int, is_borderline boolean"
    return spark.createDataFrame(rows, schema)


def linear_quantile(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


@pytest.mark.parametrize("bins, most_ordered", [(1, 3), (7, 3), (4096, 5), (4096, 100_000)])
def test_exact_quantiles(spark, bins, most_ordered):
    rng = random.Random(5)
    rows = [(g, rng.choice((0.5, rng.random()))) for g in "ab" for _ in range(57)] + [("c", 3.0)]
    rows += [("d", 0.25 + rng.random() * 1e-9) for _ in range(40)] + [("d", -1e6), ("d", 1e6)]
    frame = spark.createDataFrame(rows, "g string, x double")
    found = exact_quantiles(frame, ["g"], "x", [0.05, 0.5, 0.95, 1.0], bins, most_ordered)
    got = {(r.g, r.p): r.q for r in found.collect()}
    assert len(got) == 16
    for (g, p), q in got.items():
        assert q == pytest.approx(linear_quantile([x for k, x in rows if k == g], p))


def test_attach_cuts_hot_keys(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 80, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n_rows"), F.max("id").alias("top"))
    joined = attach(rows, facts, "k", ["id"], rows_per_slice=9)
    assert joined.count() == 100
    assert joined.where("k = 'hot'").select("top").distinct().count() == 1


def test_attach_bounds_the_list_of_hot_keys(spark):
    rows = spark.range(120).select(F.concat(F.lit("k"), (F.col("id") % 4).cast("string")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n_rows"), F.max("id").alias("top"))
    for most in (0, 1, 3, 9):
        joined = attach(rows, facts, "k", ["id"], rows_per_slice=7, most_hot=most)
        assert sorted((r.id, r.top) for r in joined.collect()) == [(k, 116 + k % 4) for k in range(120)]


def test_gate_passes_a_good_population(spark):
    report = {r.check: r for r in quality.quality_gate(population(spark)).collect()}
    assert len(report) == 1 + 9 + 2 + 2 + 9
    assert [c for c, r in report.items() if not r.ok] == []


def test_overlap_by_sketch_is_close(spark):
    rows = population(spark)
    exact = {r.feature: r.overlap_ratio for r in quality.class_overlap(rows).collect()}
    rough = {r.feature: r.overlap_ratio for r in quality.class_overlap(rows, approximate=True).collect()}
    assert rough == pytest.approx(exact, abs=0.05)


def test_gate_reports_each_fault(spark):
    good = population(spark)
    bad = good.withColumn("growth_rate", F.when(F.col("entity_id") == "e0", F.lit(float("nan"))).otherwise(F.col("growth_rate")))
    bad = bad.withColumn("structural_depth", F.lit(99.0)).withColumn("label", F.lit(1)).withColumn("is_borderline", F.lit(True))
    failed = {r.check for r in quality.quality_gate(bad).collect() if not r.ok}
    assert {"non_finite_rows", "out_of_bounds:structural_depth", "label_share", "borderline_share"} <= failed
    without = {r.check for r in quality.quality_gate(good.drop("is_borderline")).collect()}
    assert "borderline_share" not in without
    with pytest.raises(ValueError, match="label"):
        quality.quality_gate(good.drop("label"))


def test_split_is_exact_per_class_and_disjoint(spark):
    rows = population(spark, 330)
    split = evaluation.stratified_split(rows, "entity_id")
    assert split.count() == 330
    counts = {r.label: (r.n, r.t) for r in split.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert counts == {0: (165, 33), 1: (165, 33)}
    report = quality.leakage_check(split.where(~F.col("is_test")), split.where("is_test"), "entity_id", catalog.FEATURES)
    assert all(r.ok for r in report.collect())
    with pytest.raises(ValueError, match="leakage"):
        quality.assert_no_leakage([*catalog.FEATURES, "label"])


def test_metrics_and_curve(spark):
    rng = random.Random(9)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(300)] + [(1.0, 1), (0.0, 0)]
    scored = spark.createDataFrame(rows, "score double, label int")
    found = evaluation.binary_metrics(scored).first()
    positives = [s for s, y in rows if y == 1]
    negatives = [s for s, y in rows if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives) / (len(positives) * len(negatives))
    assert found.roc_auc == pytest.approx(auc)
    assert found.true_positives == sum(s > 0.5 for s in positives)
    assert found.accuracy == pytest.approx(sum((s > 0.5) == y for s, y in rows) / len(rows))

    def rates(limit):
        return (sum(n >= limit for n in negatives) / len(negatives), sum(p >= limit for p in positives) / len(positives))

    full = evaluation.roc_curve(scored, drop_collinear=False).collect()
    assert len(full) == 1 + len({s for s, _ in rows})
    for point in full:
        assert (point.fpr, point.tpr) == pytest.approx(rates(point.threshold))
    short = evaluation.roc_curve(scored).orderBy("threshold").collect()
    assert len(short) <= len(full)
    assert (short[0].fpr, short[0].tpr, short[-1].fpr, short[-1].tpr) == (1, 1, 0, 0)


def test_collinear_points_are_dropped(spark):
    scored = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 1), (0.2, 0), (0.1, 0)], "score double, label int")
    kept = sorted((r.threshold for r in evaluation.roc_curve(scored).collect()), reverse=True)
    assert kept == [float("inf"), 0.9, 0.7, 0.1]


def test_crowded_scores_are_cut_by_rank_and_may_lie_outside_zero_to_one(spark):
    rows = [(0.9 + k / 1e7, k % 2) for k in range(5000)] + [(-3.0, 0), (7.5, 1), (None, 1)]
    scored = spark.createDataFrame(rows, "score double, label int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counted = evaluation.score_counts(scored)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in counted.groupBy("part").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 2 * sum(sizes) / len(sizes)
    won = sum((a > b) + 0.5 * (a == b) for a, x in rows[::50] if x == 1 and a is not None for b, y in rows[::50] if y == 0)
    sampled = spark.createDataFrame(rows[::50], "score double, label int")
    found = evaluation.binary_metrics(sampled).first().roc_auc
    ones, zeros = sum(x for a, x in rows[::50] if a is not None), sum(1 - x for a, x in rows[::50] if a is not None)
    assert found == (won / (ones * zeros) if ones * zeros else 0.0)
