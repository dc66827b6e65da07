import collections

import cases
import pytest
from pyspark.sql import functions as F
from sleuthflow.llm import mixing
from sleuthflow.llm.numbering import numbered


def plain_targets(sizes):
    """Water level by repeated capping."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    capped = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        if not above:
            return {s: 2 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= above


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, source string, size long")


@pytest.mark.parametrize("block", [2, 256])
def test_words_come_near_targets(spark, block):
    data = [(k, f"s{k % 7}", (k * 37) % 90) for k in range(1500)] + [(5000 + k, None, 40) for k in range(30)]
    data += [(9000, "big", 100_000), (9001, "none", 0)]
    taken = mixing.spread(mixing.copies(rows(spark, data), block=block)).collect()
    sizes, words, most = collections.Counter(), collections.Counter(), collections.Counter()
    for key, source, size in data:
        sizes[source] += size
        most[source] = max(most[source], size)
    expected = plain_targets(sizes)
    assert sorted((r["doc_id"], r["size"]) for r in taken) == sorted((k, s) for k, _, s in data)
    for r in taken:
        words[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2 and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]])
    for source, target in expected.items():
        assert abs(words[source] - target) <= most[source]


def test_reruns_and_other_partitions_agree(spark):
    data = [(k, f"s{k % 5}", 1 + k % 50) for k in range(800)]
    first = mixing.copies(rows(spark, data).repartition(2)).collect()
    second = mixing.copies(rows(spark, data[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, second))


def test_rounding_keeps_each_rate(spark):
    """Over many keyed draws the share of rows taken twice is near the fraction."""
    data = [(k, "a" if k % 3 else "b", 10) for k in range(3000)]
    taken = mixing.copies(rows(spark, data)).groupBy("source").agg(F.sum("copies").alias("n"), F.first("target").alias("t")).collect()
    for r in taken:
        assert abs(r["n"] * 10 - r["t"]) <= 10


def test_repeated_rows_share_their_copies(spark):
    data = [(1, "a", 10)] * 1000 + [(None, "a", 10)] * 500 + [(2, "b", 10)] * 3
    found = mixing.spread(mixing.copies(rows(spark, data)), at_once=64).collect()
    assert collections.Counter((r["doc_id"], r["source"]) for r in found) == collections.Counter((k, s) for k, s, _ in data)
    assert abs(sum(r["copies"] * 10 for r in found if r["source"] == "a") - next(r["target"] for r in found if r["source"] == "a")) <= 10


def test_rows_of_all_kinds_and_none(spark):
    df = cases.documents(spark, True).drop("size").withColumn("size", F.coalesce("n_chars", F.lit(0)))
    assert mixing.spread(mixing.copies(df)).count() == len(cases.TEXTS)
    assert mixing.copies(rows(spark, []).limit(0)).count() == 0
    assert mixing.copies(rows(spark, [(1, "a", 0), (2, None, 0)])).agg(F.sum("copies")).first()[0] == 0


def test_numbers_are_gapless_in_order(spark):
    data = [(g, v) for g in ("a", None, "b") for v in [5, 3, 3, 3, None, 9]] + [("hot", 1)] * 500
    found = numbered(spark.createDataFrame(data, "g string, v int").repartition(5), "g", [F.col("v").asc_nulls_first()], "n").collect()
    for group in {g for g, _ in data}:
        mine = sorted((r for r in found if r["g"] == group), key=lambda r: r["n"])
        assert [r["n"] for r in mine] == list(range(len(mine)))
        values = [-1 if r["v"] is None else r["v"] for r in mine]
        assert values == sorted(values)
