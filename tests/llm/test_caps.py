import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sleuthflow.llm import caps

SCHEMA = "vec_id long, embedding array<double>, label int"


def near(rng, u, cosine):
    w = rng.standard_normal(len(u))
    w -= (w @ u) * u
    return cosine * u + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def planted(length=64, n=300, seed=5):
    """Random vectors, chains, a dense group, exact copies and pairs just above and below 0.93."""
    rng = np.random.default_rng(seed)
    vectors = list(caps.units(rng.standard_normal((n, length))))
    for k in range(30):
        vectors.append(near(rng, vectors[k], 0.9301) * (k + 0.5))
        vectors.append(near(rng, vectors[k + 30], 0.9299))
    step = vectors[100]
    for _ in range(12):
        step = near(rng, step, 0.95)
        vectors.append(step)
    vectors += [caps.units((vectors[110] + 0.02 * rng.standard_normal(length))[None])[0] for _ in range(60)]
    vectors += [vectors[5]] * 4
    return [(k, [float(x) for x in v], 1 if k < n or k % 7 else 2) for k, v in enumerate(vectors)]


def links(rows, cosine=0.93):
    good = [
        (n, k, np.array(v, float), label)
        for n, (k, v, label) in enumerate(rows)
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = []
    for (i, _, u, a), (j, _, v, b) in ((x, y) for at, x in enumerate(good) for y in good[:at]):
        if a == b and len(u) == len(v) and u @ v / math.sqrt((u @ u) * (v @ v)) >= cosine:
            out.append((i, j))
    return out


def plain(rows, cosine=0.93):
    count, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links(rows, cosine):
        count[i] += 1
        count[j] += 1
        root[find(i)] = find(j)
    least = {}
    for n, (k, _, _) in enumerate(rows):
        if k is not None:
            least[find(n)] = min(least.get(find(n), k), k)
    found = [(k, count[n], least.get(find(n))) for n, (k, _, _) in enumerate(rows)]
    return sorted(((k, c, r, k == r) for k, c, r in found), key=str)


def told(df, **options):
    return sorted((tuple(r) for r in caps.near_duplicates(df, **options).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    return planted()


@pytest.mark.parametrize("tile", [caps.TILE, 16])
def test_links_equal_all_pairs(spark, monkeypatch, rows, tile):
    monkeypatch.setattr(caps, "TILE", tile)
    assert len(links(rows)) > 1000
    assert told(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    u = [float(x) for x in rng.standard_normal(8)]
    rows = [
        (1, u, 1), (2, u, 1), (2, u, 1), (3, [2 * x for x in u], 1), (4, u, 2), (5, u, None), (6, None, 1), (7, [], 1), (8, [0.0] * 8, 1),
        (9, [None, *u[1:]], 1), (10, [math.nan, *u[1:]], 1), (11, [math.inf, *u[1:]], 1), (None, u, 1), (None, [-x for x in u], 3),
        (12, [1e300 * x for x in u], 1), (13, [1e-300 * x for x in u], 1), (14, u[:5], 1), (15, [1.0], 1), (16, [3.0], 1), (17, [-1.0], 1),
        (18, [1.0, 0.0], 1), (19, [1.0, 0.2], 1), (20, [0.0, 1.0], 1), (-21, u, 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "vector", "class", "h1", "h2", "filter", "copies", "links", "root")})
    expected = [r for r in plain([(k, v if k not in (12, 13) else u, x) for k, v, x in rows])]
    assert told(df) == sorted(((k, c, r, k == r) for k, c, r, _ in expected), key=str)
    assert caps.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("length", [2, 5, 12, 96])
def test_other_lengths(spark, length):
    rows = planted(length, 120, seed=length)
    assert told(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_another_threshold(spark, rows):
    assert told(spark.createDataFrame(rows, SCHEMA), cosine=0.85) == plain(rows, 0.85)


def test_codes_list_the_best_filters():
    code = caps.ProductCode(10, 32, 12, 0)
    rows = caps.units(np.random.default_rng(3).standard_normal((50, 10)))
    turned = rows @ code.rotation
    whole = (turned[:, :5] @ code.halves[0].T)[:, :, None] + (turned[:, 5:] @ code.halves[1].T)[:, None, :]
    expected = np.argsort(-whole.reshape(50, -1), axis=1)[:, :12]
    assert (np.sort(code.decode(rows), axis=1) == np.sort(expected, axis=1)).all()


def test_pairs_at_the_threshold_share_a_filter():
    rng = np.random.default_rng(9)
    u = caps.units(rng.standard_normal((20_000, 64)))
    v = np.stack([near(rng, x, 0.93) for x in u])
    found = np.zeros(len(u), bool)
    for code in caps.codes(64, 0.93, caps.CODEWORDS, caps.LISTED, caps.ROTATIONS):
        a, b = code.decode(u), code.decode(v)
        for low in range(0, len(u), 4000):
            part = slice(low, low + 4000)
            found[part] |= (a[part, :, None] == b[part, None, :]).any(axis=(1, 2))
    assert (~found).sum() <= 1
    assert (np.bitwise_count(caps.signs(u).view(np.uint64) ^ caps.signs(v).view(np.uint64)).sum(axis=1) <= caps.sign_radius(0.93)).all()


def test_hot_group_and_copies(spark):
    """A third of the rows near one vector and a third equal: no pair is emitted, all links are counted."""
    rng = np.random.default_rng(2)
    center = caps.units(rng.standard_normal((1, 64)))[0]
    dense = caps.units(center + 0.01 * rng.standard_normal((400, 64)))
    far = caps.units(rng.standard_normal((400, 64)))
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate([*dense, *far, *[far[0]] * 400])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = {r.vec_id: r for r in caps.near_duplicates(df).collect()}
    assert all(found[k].n_links == 399 and found[k].component_id == 0 for k in range(400))
    assert all(found[k].n_links == 400 and found[k].component_id == 400 for k in (400, *range(800, 1200)))
    assert all(found[k].n_links == 0 and found[k].kept for k in range(401, 800))


def test_random_order_gives_the_same(spark, rows):
    mixed = random.Random(1).sample(rows, len(rows))
    assert told(spark.createDataFrame(mixed, SCHEMA).repartition(7)) == told(spark.createDataFrame(rows, SCHEMA).coalesce(1))
