import collections
import math

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F
from sleuthflow.llm import language
from sleuthflow.llm.common import fold

SAMPLES = {
    "en": [b"the cat sat on the mat", b"and the dog ran to the house"],
    "de": ["der Hund lief über das Feld".encode(), b"und die Katze schlief"],
}


def plain_bits(samples, text, order, alphabet):
    """Code length byte by byte with a dictionary tree."""
    tree = collections.defaultdict(collections.Counter)
    for sample in samples:
        for k, byte in enumerate(sample):
            for depth in range(min(order, k) + 1):
                tree[sample[k - depth : k]][byte] += 1
    total = 0.0
    for k, byte in enumerate(text):
        for depth in range(order, -1, -1):
            context = text[k - depth : k] if depth <= k else None
            seen = tree.get(context) if context is not None else None
            if not seen or any(b not in alphabet for b in context):
                continue
            n, d = sum(seen.values()), len(seen)
            if byte in seen:
                total -= math.log2(seen[byte] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += math.log2(256)
    return total


@pytest.mark.parametrize("order", [0, 1, 2])
def test_tables_equal_the_tree(order):
    model = language.train(SAMPLES, order)
    alphabet = set(b"".join(b"".join(x) for x in SAMPLES.values()))
    for text in (b"", b"t", b"the dog", "Füße \x00 zzz QQ über".encode(), b"the cat sat on the mat" * 3):
        expected = [plain_bits(SAMPLES[x], text, order, alphabet) for x in model.languages]
        assert language.code_lengths(model, text) == pytest.approx(expected, rel=1e-5)


@pytest.mark.parametrize("order", [2, 3])
def test_sparse_layers_equal_the_tree(order, monkeypatch):
    monkeypatch.setattr(language, "CELLS", 0)
    model = language.train(SAMPLES, order)
    assert model.layers
    alphabet = set(b"".join(b"".join(x) for x in SAMPLES.values()))
    for text in (b"", b"t", b"the dog", "Füße \x00 zzz QQ über".encode(), b"the cat sat on the mat" * 3):
        expected = [plain_bits(SAMPLES[x], text, order, alphabet) for x in model.languages]
        assert language.code_lengths(model, text) == pytest.approx(expected, rel=1e-5)
        monkeypatch.setattr(language, "RUN", 7)


def test_every_labelled_language_is_learned(spark):
    rows = [(40 * n + k, f"{chr(97 + n)}{chr(110 - n % 13)}ka {chr(97 + n)}{chr(97 + n)}lo " * 8, f"l{n:02d}") for n in range(22) for k in range(25 - n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(language.sample(docs))
    assert model.languages == [f"l{n:02d}" for n in range(22)]
    assert language.predict(docs, model).where(F.col("lang") != F.col("lang_pred")).count() == 0


def test_limits_tell_junk_from_scripts_not_learned():
    rng = np.random.default_rng(0)
    words = [b"haus", b"und", b"katze", b"feld", b"lief", b"hund"]
    texts = [b" ".join(words[k] for k in rng.integers(0, 6, 30)) for _ in range(200)]
    within = language.limits({"de": texts})
    model = language.train({"de": texts})
    def standing(text):
        body = text.encode()
        return language._standing(within, "de", body, float(language.code_lengths(model, body)[0] / len(body)))
    assert standing(texts[0].decode()) == "in"
    assert standing("Ελληνικά γράμματα σε μια πρόταση " * 3) == standing("Русские буквы в одном предложении " * 3) == "foreign"
    assert standing("QXZJ7%K#9" * 17) == "out"


def test_long_texts_are_summed_in_runs(monkeypatch):
    model = language.train(SAMPLES)
    text = b"the hound and the field, der Hund und das Feld " * 50
    whole = language.code_lengths(model, text)
    monkeypatch.setattr(language, "RUN", 7)
    assert language.code_lengths(model, text) == pytest.approx(whole)


def test_rows_of_all_kinds(spark):
    docs = cases.documents(spark, True)
    model = language.train(language.sample(docs))
    assert model.languages == ["de", "en"]
    found = language.predict(docs, model).select("doc_id", "text", "lang_pred", "score", "bits_per_byte", "size").collect()
    assert len(found) == len(cases.TEXTS)
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1 and r["size"] == "clash"
    assert {r["lang_pred"] for r in found if r["doc_id"] == 7} == {"de"}
    assert language.predict(cases.nothing(spark), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = cases.documents(spark).withColumn("lang", F.lit(None).cast("string"))
    model = language.train(language.sample(docs))
    assert {r["lang_pred"] for r in language.predict(docs, model).collect()} == {"und"}


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", fold("doc_id") == 0)
    model = language.train(language.sample(docs.where(~F.col("held_out"))))
    held = language.predict(docs.where("held_out"), model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.9


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_TEXTS", 3)
    monkeypatch.setattr(language, "SAMPLE_BYTES", 50)
    rows = [(k, "x" * 30, f"l{k % 2}") for k in range(100)] + [(7, "y" * 30, "l1")] * 20
    found = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {x: set(map(len, t)) for x, t in found.items()} == {"l0": {30}, "l1": {30}}
    assert {x: sum(map(len, t)) for x, t in found.items()} == {"l0": 60, "l1": 60}
    assert np.all([len(t) <= 3 for t in found.values()])


def test_sampled_texts_are_whole_and_long_ones_come_last(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_BYTES", 800)
    rows = [(k, "s" * 90, "mixed") for k in range(5)] + [(k, "t" * 5000 + "!", "mixed") for k in range(5, 30)]
    rows += [(k, "u" * 3000 + "\u00e9", "long") for k in range(30, 34)] + [(40, None, "none"), (41, "", "none")]
    found = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(map(len, found["mixed"])) == [90] * 5 + [5001]
    assert found["long"] == [("u" * 3000 + "\u00e9").encode()]
    assert "none" not in found
