import collections
import math
import random
import zlib

import cases
import numpy as np
import pytest
from sleuthflow.llm import lm


def fold(key):
    return zlib.crc32(("null" if key is None else str(key)).encode()) % 5


def bucket(n):
    return 1 + math.floor(math.log2(n)) if n else 0


def cell(n, total):
    return int(np.round(-lm.CELLS * np.log2(n / total))) if n else lm.FAR


def plain(rows):
    """Counts and scores by dictionaries; the weights by the same fit from plainly counted cells."""
    docs = [(k, fold(k), cases.words(cases.lower(t)) + [None]) for k, t in rows]
    one, two, kept_one, kept_two = (collections.Counter() for _ in range(4))
    for _, f, words in docs:
        pairs = list(zip([None] + words[:-1], words))
        if f != 1:
            one.update(words)
            two.update(pairs)
        if f > 1:
            kept_one.update(words)
            kept_two.update(pairs)
    total, types, kept = sum(one.values()), len(one), max(1, sum(kept_one.values()))
    cells = collections.Counter()
    for _, f, words in docs:
        for v, w in zip([None] + words[:-1], words):
            if f == 0:
                n = kept_one[v]
                cells[bucket(n), cell(kept_two[v, w], n), cell(kept_one[w], kept)] += 1
    weights = lm.learned_weights(np.array([(*k, n) for k, n in sorted(cells.items())], np.int64).reshape(-1, 4), types)
    out = []
    for k, f, words in docs:
        base = sum(math.log10((one[w] + 0.5) / (total + 0.5 * (types + 1))) for w in words)
        score = 0.0
        for v, w in zip([None] + words[:-1], words):
            a, b, u = weights[bucket(one[v])]
            score += math.log10(a * two[v, w] / max(1, one[v]) + b * one[w] / max(1, total) + u / (types + 1))
        out.append((k, f == 1, len(words), sum(one[w] > 0 for w in words), total, base, score))
    return out


def check(df, rows):
    found = sorted(map(tuple, lm.scores(df).collect()), key=repr)
    expected = sorted(plain(rows), key=repr)
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    for a, b in zip(found, expected):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    return found


@pytest.mark.parametrize(("block", "width"), [(2_000_000, 1_000_000), (300, 400)])
def test_scores_equal_plain_counting(spark, monkeypatch, block, width):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm, "RANGE_TOKENS", width)
    rng = random.Random(4)
    chain = {w: rng.sample(range(80), 4) for w in range(80)}
    rows = []
    for k in range(300):
        at, words = rng.randrange(80), []
        for _ in range(rng.randrange(30)):
            at = rng.choice(chain[at])
            words.append(f"W{at}" if rng.random() < 0.95 else f"odd{rng.randrange(10**6)}")
        rows.append((k, " ".join(words)))
    found = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)
    held = [r for r in found if r[1]]
    assert sum(r[6] for r in held) > 1.1 * sum(r[5] for r in held)  # above the base on held-out rows


def test_rows_of_all_kinds(spark):
    check(cases.documents(spark, True), [r[:2] for r in cases.TEXTS])
    assert lm.scores(cases.nothing(spark)).count() == 0


def test_no_training_rows(spark):
    key = next(k for k in range(100) if fold(k) == 1)
    (row,) = lm.scores(spark.createDataFrame([(key, "a b")], "doc_id long, text string")).collect()
    assert tuple(row)[:6] == (key, True, 3, 0, 0, 0.0) and row["score"] == pytest.approx(0.0)


def test_probabilities_sum_to_one():
    """Over the vocabulary and one unknown word, after any context."""
    rows = [(k, "a b a c" if k % 2 else "b c b d") for k in range(40)]
    one, two = collections.Counter(), collections.Counter()
    for k, t in rows:
        words = t.split() + [None]
        if fold(k) != 1:
            one.update(words)
            two.update(zip([None] + words[:-1], words))
    weights = lm.learned_weights(np.array([[3, 8, 16, 10], [0, lm.FAR, 20, 4]]), len(one))
    for v in [*one, "never"]:
        a, b, u = weights[bucket(one[v])]
        total = sum(a * two[v, w] / max(1, one[v]) + b * one[w] / sum(one.values()) + u / (len(one) + 1) for w in one)
        assert total + u / (len(one) + 1) == pytest.approx(1.0)


def test_packed_arrays_come_back():
    for kind in (np.uint32, np.uint64):
        for n in (0, 1, 1000):
            values = np.random.default_rng(n).integers(0, np.iinfo(kind).max, n, dtype=kind)
            assert lm._unpack(lm._pack(values), n, kind).tolist() == values.tolist()
