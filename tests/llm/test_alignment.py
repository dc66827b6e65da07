import hashlib
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from cases import TEXTS, documents, nothing
from tokenizers import Tokenizer

from sleuthflow.llm import alignment
from sleuthflow.llm.bpe import byte_units

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = [chr(c) for c in (0x20, 0x20, 0x61, 0x62, 0x41, 0x31, 0x2E, 0x27, 0x73, 0xE9, 0xDF, 0x4E2D, 0x6587, 0x1F600, 0x0A, 0x09, 0x3000, 0xA0, 0x2581, 0x301, 0, 0xFB01, 0x200D)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    made += ["x" * 3000, " " * 3000, "xyz" * 700 + " " + "é" * 1500, "<|endoftext|> <s> </s> <0x41> <unk>", "▁a b", "don't we'll  they've"]
    made += ["\n\n\n", None, "", " ", "word " * 1500, "".join(rng.choice("abcdefghij") for _ in range(4000)), "word word word", "word word word"]
    return made


def plain(texts):
    """Tokens, groups, links and counts one by one, with the tokenizers library."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    octet = {u: b for b, u in enumerate(byte_units())}
    rows, counts = [], {}
    for text in texts:
        if not text:
            rows.append(None)
            continue
        whole = (" " + text).encode()
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        a_bytes = [bytes(octet[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            rows.append(None)
            continue
        a_ends, b_ends = ([sum(map(len, ts[: n + 1])) for n in range(len(ts))] if len(ts) < 50 else _ends(ts) for ts in (a_bytes, b_bytes))
        groups, i, j = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            k, m = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        for pair in {(x, y) for left, right in groups for x in left for y in right}:
            counts[pair] = counts.get(pair, 0) + 1
        rows.append((a, b, groups))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups = row
        linked = [(x, y) for left, right in groups for x in left for y in right]
        shown = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append((len(a), len(b), len(groups), len(linked), sum(counts[p] == most[p[0]] for p in linked), sum(counts[p] for p in linked), shown))
    return out


def _ends(tokens):
    total, out = 0, []
    for t in tokens:
        total += len(t)
        out.append(total)
    return out


def test_alignment_equals_the_plain_one(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = {k: row for k, row in enumerate(plain(texts))}
    assert sum(row[0] > 0 for row in expected.values()) > 80
    assert {r[0]: tuple(r)[1:] for r in alignment.align(df, A, B).collect()} == expected
    hashed = {r[0]: r[-1] for r in alignment.align(df, A, B, digest=True).collect()}
    assert hashed == {k: hashlib.sha256(row[-1].encode()).hexdigest() if row[-1] else "" for k, row in expected.items()}


def test_blocks_windows_and_large_groups_change_nothing(spark, monkeypatch, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    expected = sorted(tuple(r) for r in alignment.align(df, A, B).collect())
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(alignment, "CACHED_IDS", 100)
    monkeypatch.setattr(alignment, "LARGE", 1)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 500)
    assert sorted(tuple(r) for r in alignment.align(df, A, B).collect()) == expected


def test_awkward_rows(spark):
    expected = sorted(((k, *row) for (k, *_), row in zip(TEXTS, plain([t[1] for t in TEXTS]))), key=str)
    assert sorted((tuple(r) for r in alignment.align(documents(spark, clashing=True), A, B).collect()), key=str) == expected
    assert alignment.align(nothing(spark), A, B).count() == 0


def test_both_libraries_split_alike():
    """The faster encoder gives the ids of the tokenizers library for every code point, next to letters, digits and blanks."""
    fast, _ = alignment.byte_level(Path(A).read_text(encoding="utf-8"))
    slow = Tokenizer.from_file(A)
    slow.encode_special_tokens = True
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(points), 8192):
        shown = [f" a{c}b 1{c}2 .{c}, {c} x {c}{c}'s{c}  {c}" for c in map(chr, points[low : low + 8192])]
        assert [e.ids for e in slow.encode_batch(shown, add_special_tokens=False)] == fast.encode_ordinary_batch(shown, num_threads=4)


def test_other_vocabularies_are_refused():
    with pytest.raises((ValueError, KeyError)):
        alignment.byte_level(Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8"))


def test_common_words_are_asked_once_a_block(spark):
    """One text in all rows: the pairs of a block are its distinct pairs, however many documents hold them."""
    df = spark.createDataFrame([(k, "the same words again and again") for k in range(3000)], "doc_id long, text string").repartition(4)
    found = alignment.align(df, A, B).collect()
    assert len(found) == 3000 and len({tuple(r)[1:] for r in found}) == 1
    assert found[0].count_sum == 3000 * found[0].n_links


def test_documents_of_a_block_stream_past_its_answers(spark):
    """No worker is handed a block as a whole, and batches that cut answers, documents and blocks change nothing."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["the", "same", "wörds", "again", "x1", "中文", "the the"], k=rng.randint(1, 30))) for _ in range(400)]
    df = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    expected = {f"d{k}": row for k, row in enumerate(plain(texts))}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = alignment.align(df, A, B)
        assert {r[0]: tuple(r)[1:] for r in found.collect()} == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().executedPlan().toString()


def test_answers_wait_for_documents_of_their_block():
    kind = pa.schema([("block", pa.int64()), ("slot", pa.int32()), ("count", pa.int64()), ("best", pa.bool_()), ("slots", pa.binary()), ("times", pa.binary())])

    def rows(*values):
        packed = [(*v[:4], np.array(v[4], "<i4").tobytes(), np.array(v[5], "<i8").tobytes()) for v in values]
        return pa.RecordBatch.from_pylist([dict(zip(kind.names, v)) for v in packed], kind)

    held = alignment.Answers()
    assert held.taken(rows((1, 0, 5, True, [], []), (1, 1, 3, False, [], []))).num_rows == 0
    docs = held.taken(rows((1, 2, 9, True, [], []), (1, None, None, None, [2, 0, 1], [4]), (1, None, None, None, [], [])))
    assert [s.tolist() for s in held.sums(docs)] == [[5, 0], [44, 0]]
    docs = held.taken(rows((1, None, None, None, [1, 0], [2, 3])))
    assert [s.tolist() for s in held.sums(docs)] == [[3], [21]]
    docs = held.taken(rows((2, 0, 7, False, [], []), (2, None, None, None, [0], [])))
    assert [s.tolist() for s in held.sums(docs)] == [[0], [7]]
    docs = held.taken(rows((3, None, None, None, [], [])))
    assert [s.tolist() for s in held.sums(docs)] == [[0], [0]]
