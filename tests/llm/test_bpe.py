import hashlib
import re

import cases
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings, strategies as st
from sleuthflow.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


CODEC = bpe.Codec(open(PATH, encoding="utf-8").read())
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_as_the_library_does(text):
    (ids,) = CODEC.encode([text])
    assert np.frombuffer(ids, np.int32).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("length", [1, 2, bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 3000])
def test_rank_array_and_heap_agree(library, length):
    word = ("abcaabbccthethe" * 300)[:length]
    (ids,) = CODEC.merge([word.encode()])
    assert ids == CODEC._merge_long(word.encode())
    assert np.frombuffer(ids, np.int32).tolist() == library.encode(word, add_special_tokens=False).ids


def test_rows_of_all_kinds(spark, library):
    rows = bpe.digests(bpe.encode(cases.documents(spark, True), PATH, decoded="decoded")).collect()
    expected = []
    for key, text, *_ in cases.TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
        expected.append((key, len(ids), *digest))
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)


def test_decoding_stored_ids(spark, library):
    ids = spark.createDataFrame([([320, 49406, 5],), ([],), (None,), ([-1, 10**6, 320, None],)], "ids array<int>")
    found = [r["decoded"] for r in bpe.decode(ids, PATH).collect()]
    assert found == [library.decode([320, 49406, 5], skip_special_tokens=False), "", None, library.decode([320])]


def test_no_rows(spark):
    assert bpe.encode(cases.nothing(spark), PATH, decoded="decoded").count() == 0


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 50)
    codec = bpe.Codec(open(PATH, encoding="utf-8").read())
    for n in range(20):
        text = " ".join(f"word{n}x{k} " for k in range(40)) + "y" * 100
        (ids,) = codec.encode([text])
        assert np.frombuffer(ids, np.int32).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert len(codec.cache) <= 60


def test_plain_words_and_equal_texts_leave_no_pieces_behind():
    codec = bpe.Codec(open(PATH, encoding="utf-8").read())
    held = len(codec.cache)
    texts = [" ".join(f"{'Wörter'[: 1 + k % 6]}{chr(97 + k % 26)}{chr(97 + k // 26)}{bpe.MARKS[k % 6]}" for k in range(600)), "", None, " \xa0\u3000\t ", "?! 42"]
    texts += ["çà\u2003va\x85ÀÉß×÷ Σίσυφος İ ªº straße. a.. \x1cb", "<|endoftext|>plain <|", "x" * 300 + " y"] + texts
    found = codec.encode(texts)
    assert [np.frombuffer(ids, np.int32).tolist() for ids in found] == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(codec.cache) < held + 20


def test_plain_letters_lower_alike_in_arrow():
    letters = [c for c in map(chr, range(256)) if re.search(bpe.PLAIN, c)]
    assert len(letters) == 52 + 62 and pc.utf8_lower(pa.array(letters)).to_pylist() == [c.lower() for c in letters]
    assert {c for c in map(chr, range(0x110000)) if c.isspace()} - set(map(chr, range(0x1C, 0x20))) == set(re.findall(f"[{bpe.BLANK}]", "".join(map(chr, range(0x110000)))))


def test_empty_list_array():
    assert CODEC.decode(pa.array([], pa.list_(pa.int32()))).to_pylist() == []
