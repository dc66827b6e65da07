import collections

import cases
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from sleuthflow.llm import secrets, stages
from sleuthflow.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_the_columns_and_chain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, sf_dir), name)
        assert after.columns == COLUMNS and after.dtypes == docs.dtypes and after.count() > 0
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() and "ids" in last.columns
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens").collect())) == sorted(
        map(tuple, last.select("doc_id", "n_tokens").collect())
    )


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_takes_awkward_rows_and_none(spark, sf_dir, stage):
    stage(spark, cases.documents(spark, True), sf_dir).collect()
    assert stage(spark, cases.nothing(spark), sf_dir).count() == 0


def test_language_rejects_texts_without_letters_only(spark):
    kept = collections.Counter(r["doc_id"] for r in stages.in_a_language(cases.documents(spark)).collect())
    expected = collections.Counter(k for k, t, *_ in cases.TEXTS if any(c.isalpha() for c in t or ""))
    assert kept == expected


def test_language_keeps_scripts_without_a_sample(spark):
    latin = [(k, f"der Hund und die Katze und das Feld {k}", "de") for k in range(30)]
    other = [(100, "Ελληνικά γράμματα σε μια πρόταση " * 3, None), (101, "Русские буквы в одном предложении " * 3, None)]
    docs = spark.createDataFrame([(k, t, x, "s", 1) for k, t, x in latin + other], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["lang"] for r in stages.in_a_language(docs).collect()}
    assert kept == {**{k: "de" for k in range(30)}, 100: None, 101: None}


def test_one_row_of_each_group_stays(spark):
    near = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 6
    rows = [(5, near), (3, near), (3, near), (9, near + "lambda"), (4, "other words here now again"), (None, near), (None, None), (1, "")]
    rows += [(None, "only null keys have this text of words")] * 3
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in stages.one_of_each_group(df).collect()]
    assert sorted(kept, key=repr) == sorted([(3, near), (4, "other words here now again"), (1, ""), rows[-1]], key=repr)


def test_secrets_leave_no_span_and_clean_rows_alone(spark):
    before = {(r["doc_id"], r["text"]) for r in cases.documents(spark).collect()}
    after = stages.without_secrets(cases.documents(spark))
    assert after.count() == len(cases.TEXTS)
    assert secrets.scan(after).where(F.size("secrets") > 0).isEmpty()
    changed = {(r["doc_id"], r["text"]) for r in after.collect()} - before
    assert {k for k, _ in changed} == {8}
    assert after.where(F.col("n_chars") != F.length("text")).isEmpty()


def test_mixing_repeats_rows_as_often_as_taken(spark):
    rows = [(k, "w " * (1 + k % 40), "en", f"s{k % 4}", 1) for k in range(400)] + [(9, "w w", "en", "s0", 1)] * 301
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    after = stages.mixed(df)
    words = F.sum(F.size(F.split(F.trim("text"), " ")))
    took = {r["source"]: r["w"] for r in after.groupBy("source").agg(words.alias("w")).collect()}
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(text.split())
    level, capped = 1.5 * sum(sizes.values()), {}
    weights = {"s0": 3, "s1": 1, "s2": 2, "s3": 3}
    while True:
        free = {s: w for s, w in weights.items() if s not in capped}
        unit = (level - sum(capped.values())) / sum(free.values())
        above = {s: 2 * sizes[s] for s, w in free.items() if w * unit >= 2 * sizes[s]}
        if not above:
            break
        capped |= above
    for source in sizes:
        assert abs(took[source] - capped.get(source, weights[source] * unit)) <= 40
    assert after.groupBy("doc_id", "text").count().where("doc_id <> 9 AND count > 2").isEmpty()
