import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sleuthflow.llm import projections, segments, vectors


def table(spark, n=400, length=16, seed=1):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, 1) for _ in range(length)]) for k in range(n)]
    rows[7] = (7, rows[20][1])
    rows[8] = (8, rows[20][1])
    rows += [
        (1000, None), (1020, []), (1040, [0.0] * length), (1060, [None] + [1.0] * (length - 1)),
        (1080, [math.nan] * length), (1100, [math.inf] + [0.5] * (length - 1)), (None, rows[3][1]),
        (1200, [1.0, 2.0]), (1220, [1.0, 2.5]), (20, rows[20][1]), (33, rows[33][1]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.withColumns({"id": F.lit("clash"), "vector": F.lit("clash"), "cost": F.lit(1)})
    return df.repartition(3), [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]


def good(v, zero):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def plain(rows, step, k, cost, zero):
    """Every query against every row."""
    kept = [(i, v) for i, v in rows if i is not None and good(v, zero)]
    out = []
    for q, a in kept:
        if q % step == 0:
            near = sorted((cost(a, b), i) for i, b in kept if i != q and len(a) == len(b))[:k]
            out += [(q, r, i, c) for r, (c, i) in enumerate(near, 1)]
    return out


@pytest.mark.parametrize("block_bytes", [vectors.BLOCK_BYTES, 400])
def test_top_products_are_exact(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(vectors, "TILE", 64)
    df, rows = table(spark)
    whole = [(k, v and [None if x is None else x if not math.isfinite(x) else math.floor(64 * x) for x in v]) for k, v in rows]
    found = {tuple(r) for r in segments.top_products(df, F.col("id") % 20 == 0, k=20).collect()}
    expected = {(q, r, i, -c) for q, r, i, c in plain(whole, 20, 20, lambda a, b: -sum(x * y for x, y in zip(a, b)), True)}
    assert found == expected


def test_segment_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(50, 24)), rng.normal(size=(60, 24))
    exact = a @ b.T
    coarse, fine = (segments.statistics(a, s) @ segments.statistics(b, s).T for s in (3, 12))
    assert (coarse >= exact - 1e-9).all() and (fine >= exact - 1e-9).all() and fine.mean() < coarse.mean()


def test_neighbours_are_found(spark):
    df, rows = table(spark)
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["cost"]) for r in projections.neighbours(df, F.col("id") % 20 == 0, k=10).collect()}
    expected = plain(rows, 20, 10, lambda a, b: math.dist(a, b), False)
    true, got = {}, {}
    for q, r, i, c in expected:
        true.setdefault(q, set()).add(i)
    for (q, r), (i, c) in found.items():
        got.setdefault(q, set()).add(i)
        assert c == pytest.approx(math.dist(dict(rows)[q], dict(rows)[i]), abs=1e-12)
    assert set(true) == set(got)
    assert sum(len(true[q] & got[q]) for q in true) >= 0.95 * sum(map(len, true.values()))


def test_no_vectors(spark):
    df, _ = table(spark)
    assert projections.neighbours(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert segments.top_products(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_chi_square_law():
    draws = np.random.default_rng(0).chisquare(8, 200_000)
    for p in (0.1, 0.5, 0.99):
        assert (draws < projections.chi_square_quantile(p, 8)).mean() == pytest.approx(p, abs=0.01)


def test_kd_leaves_partition_the_points():
    points = np.random.default_rng(2).normal(size=(777, 4))
    leaves = projections.kd_leaves(points)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(777)) and max(map(len, leaves)) <= projections.LEAF
