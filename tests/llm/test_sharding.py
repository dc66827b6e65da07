import collections
import hashlib
import math
import zlib

import cases
from pyspark.sql import functions as F
from sleuthflow.llm import sharding
from sleuthflow.llm.sharding import Shard


def plain_shard(key, tree):
    """Descends region, rack and shard by the least draw."""

    def draw(level, child, weight):
        digits = hashlib.md5(f"{'null' if key is None else key}/{level}{child}".encode()).hexdigest()[:13]
        return -math.log((int(digits, 16) + 0.5) / 2.0**52) / weight

    members = tree
    for level in ("region", "rack", "shard"):
        weights = collections.defaultdict(float)
        for s in members:
            weights[getattr(s, level)] += s.weight
        winner = min(weights, key=lambda c: (draw(level, c, weights[c]), c))
        members = [s for s in members if getattr(s, level) == winner]
    return members[0].shard


def test_rows_of_all_kinds(spark):
    tree = sharding.full_tree(8)
    more = sharding.grown(tree)
    found = sharding.shards(cases.documents(spark, True), tree, more).collect()
    got = sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in found), key=repr)
    expected = [
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain_shard(k, tree), plain_shard(k, more))
        for k, t, *_ in cases.TEXTS
    ]
    assert got == sorted(expected, key=repr)
    for shard in range(8):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shards(cases.nothing(spark), tree, more).count() == 0


def placed(spark, tree, n=4000):
    rows = spark.range(n).select("id", sharding.placement(F.col("id"), tree).alias("shard")).collect()
    return {r["id"]: r["shard"] for r in rows}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    tree = sharding.full_tree(8)
    before, after = placed(spark, tree), placed(spark, sharding.grown(tree))
    moved = {k for k in before if before[k] != after[k]}
    assert {after[k] for k in moved} == {8} and abs(len(moved) / len(before) - 1 / 9) < 0.02
    counts = collections.Counter(before.values())
    assert max(counts.values()) < 1.2 * len(before) / 8


def test_a_heavier_shard_moves_rows_only_into_its_own_subtree(spark):
    tree = sharding.full_tree(8)
    heavy = [Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in tree]
    before, after = placed(spark, tree), placed(spark, heavy)
    region = {s.shard: s.region for s in tree}
    for k in before:
        if before[k] != after[k]:
            assert region[after[k]] == region[5]
    assert collections.Counter(after.values())[5] > 1.8 * collections.Counter(before.values())[5]
