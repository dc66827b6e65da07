import collections
import random

import cases
import numpy as np
import xxhash
from sleuthflow.llm import simhash
from sleuthflow.llm.components import components
from sleuthflow.session import materialize


def plain_fingerprint(text, n):
    found = cases.words(cases.lower(text))
    if not found:
        return 0
    shingles = [" ".join(found[k : k + n]) for k in range(len(found) - n + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(keyed, radius):
    """Smallest key reachable for each row, by comparing all rows."""
    group = list(range(len(keyed)))
    changed = True
    while changed:
        changed = False
        for a in range(len(keyed)):
            for b in range(len(keyed)):
                if (keyed[a][1] ^ keyed[b][1]).bit_count() <= radius and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    least = {}
    for g, (key, _) in zip(group, keyed):
        if key is not None:
            least[g] = min(least.get(g, key), key)
    return [least.get(g) for g in group]


def check(df, rows, n, radius):
    keyed = [(k, plain_fingerprint(t, n)) for k, t in rows]
    expected = [(k, f"{f:016x}", g) for (k, f), g in zip(keyed, plain_groups(keyed, radius))]
    found = simhash.near_duplicates(df, words=n, width=1, radius=radius, repeats=True)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_rows_of_all_kinds(spark):
    check(cases.documents(spark, True), [r[:2] for r in cases.TEXTS], 3, 2)


def test_no_rows(spark):
    assert simhash.near_duplicates(cases.nothing(spark)).count() == 0


def test_groups_equal_plain_comparison(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(1, 40))] for _ in range(25)]
    rows = []
    for k in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice("pqr")
        rows.append((k, " ".join(words)))
    for radius in (0, 2, 6):
        check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 3, radius)


def test_small_tiles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 3)
    monkeypatch.setattr(simhash, "AT_ONCE", 4)
    rows = [(k, f"one two three four five six seven {k // 3}") for k in range(40)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 3, 2)


def test_long_texts_are_cut_without_losing_shingles():
    text = " ".join(f"w{k % 977}" for k in range(20_000)).encode()
    for n in (1, 3, 5):
        whole = [h for part in simhash.shingle_hashes(text, n) for h in part.tolist()]
        cut = [h for part in simhash.shingle_hashes(text, n, 1000) for h in part.tolist()]
        assert whole == cut and len(whole) == 20_000 - n + 1


def test_wide_fingerprints_find_similar_texts_only(spark):
    rng = random.Random(1)
    rows, pairs = [], []
    for k in range(60):
        words = [f"{rng.choice('bcdfgh')}{rng.randrange(900)}" for _ in range(300)]
        near = list(words)
        for at in rng.sample(range(300), 4):
            near[at] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
        pairs.append({2 * k, 2 * k + 1})
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert sum(g in pairs for g in groups.values()) >= 57 and all(g in pairs or len(g) == 1 for g in groups.values())


def changed(rng, words, count):
    """`words` with `count` of them replaced, no two within a shingle of five: five shingles go, five come."""
    near = list(words)
    for at in rng.sample(range(1, len(words) // 6 - 1), count):
        near[6 * at] = f"changed{rng.randrange(10**9)}"
    return near


def similarity(a, b):
    a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def exact_groups(texts, at_least):
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if similarity(texts[a], texts[b]) >= at_least:
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    return group


def test_no_text_below_the_similarity_is_linked_and_none_above_is_lost(spark):
    rng = random.Random(3)
    texts = []
    for k in range(40):
        words = [f"{rng.choice('bcdfgh')}{rng.randrange(900)}" for _ in range(300)]
        texts += [words, changed(rng, words, 8 if k % 2 else 6)]
    assert all(0.74 < similarity(texts[2 * k], texts[2 * k + 1]) < 0.83 for k in range(40))
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert [found[k] for k in range(len(texts))] == exact_groups(texts, 0.8)


def test_blocks_of_a_chain_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 700)
    rng = random.Random(4)
    texts = [[f"{rng.choice('bcdfgh')}{rng.randrange(900)}" for _ in range(300)]]
    for k in range(30):
        texts.append(changed(rng, texts[-1], 8 if k % 6 == 5 else 4))
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    expected = exact_groups(texts, 0.8)
    assert [found[k] for k in range(len(texts))] == expected and len(set(expected)) == 6


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 30)] + [(3, 3), (5, 6), (6, 5), (None, 1)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {**{k: 100 for k in range(101, 161)}, **{k: 5 for k in range(6, 30)}}


def test_strips_spread_a_large_cell_and_miss_no_pair_that_sizes_allow(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STRIP", 2)
    rng = random.Random(6)
    sizes = [50] * 60 + [rng.randrange(400) for _ in range(60)] + [40, 50, 64, 80, 0, 0]
    df = spark.createDataFrame([(k, [rng.randrange(-(2**63), 2**63)], n) for k, n in enumerate(sizes)], "id long, fp array<long>, size int")
    tiles = materialize(simhash._tiles(df, simhash._size_cell(0.8), 4), "tiles")
    found = simhash._strip_pairs(tiles, simhash._steps(simhash.SIZE_STEPS, 1))
    found = found.where("_from <> cell OR _tile <= tile").selectExpr("to_json(at) AS at", "_ids", "ids", "_from = cell AND _tile = tile AS same").collect()
    assert max(collections.Counter(r["at"] for r in found).values()) <= simhash.STRIP**2
    pairs = collections.Counter()
    for r in found:
        pairs.update(frozenset((a, b)) for a in r["_ids"] for b in r["ids"] if (a < b if r["same"] else True))
    assert set(pairs.values()) == {1} and len(pairs) < 0.5 * len(sizes) * (len(sizes) - 1) / 2
    for a in range(len(sizes)):
        for b in range(a):
            if min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b]) > 0:
                assert frozenset((a, b)) in pairs


def test_texts_at_the_limit_of_size_are_linked(spark, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE_TILE", 5)
    rng = random.Random(7)
    texts = []
    for k in range(40):
        words = [f"{rng.choice('bcdfgh')}{rng.randrange(10**6)}" for _ in range(5 * (8 + k) + 5)]
        # 4 of 5 shingles, a similarity of 0.8 just so, and one shingle fewer.
        texts += [words[:-1], words[: 4 * (8 + k) + 4 - k % 2]]
    assert all((similarity(texts[2 * k], texts[2 * k + 1]) >= 0.8) == (k % 2 == 0) for k in range(40))
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert [found[k] for k in range(len(texts))] == exact_groups(texts, 0.8)


def test_forest_joins_what_chunks_find_apart(monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    monkeypatch.setattr(simhash, "LINKS", 3)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, (6, 2), dtype=np.uint64)
    which = rng.integers(0, 6, 40)
    rows = base[which] ^ (np.uint64(1) << rng.integers(0, 64, (40, 2), dtype=np.uint64))
    for split in (0, 15):
        left, right = (rows, rows) if not split else (rows[:split], rows[split:])
        child, parent = simhash._forest(left, right, 2, 4, not split)
        label = np.arange(40)
        label[child] = parent
        for a in range(split or 40):
            for b in range(split, 40):
                assert (label[a] == label[b]) == (which[a] == which[b])
