"""Registered queries of the operators: callables (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sleuthflow.llm import alignment, bpe, caps, conversations, language, lm, mixing, projections, secrets, segments, sharding, simhash, substring
from sleuthflow.llm.common import WORD, documents, embeddings, fold
from sleuthflow.session import configure, materialize

TOKENIZER = "word_bpe_49k.json"
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text, decode the ids, digest both."""
    configure(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, public_tokenizers.path(TOKENIZER), decoded="decoded"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when sources are mixed to their target weights."""
    configure(spark)
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialize(documents(spark, sf_dir).select("doc_id", "source", words.alias("size")), "sizes")
    taken = mixing.spread(mixing.copies(rows))
    return taken.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over 3-word shingles, linked at 2 bits or fewer."""
    configure(spark)
    return simhash.near_duplicates(documents(spark, sf_dir), words=3, width=1, radius=2, repeats=True)


def op4_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 by the hash tree, and the shards with one more."""
    configure(spark)
    tree = sharding.full_tree(8)
    return sharding.shards(documents(spark, sf_dir), tree, sharding.grown(tree))


def op5_ann_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found of every hundredth one."""
    configure(spark)
    found = projections.neighbours(embeddings(spark, sf_dir), F.col("id") % 100 == 0, k=10)
    return found.withColumnRenamed("cost", "score")


def op6_lm_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole text, counts from four fifths of the documents."""
    configure(spark)
    return lm.scores(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and sentences of whole texts that repeat an earlier one, with their offsets."""
    configure(spark)
    return substring.repeated(documents(spark, sf_dir)).drop("copy")


def op8_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; models from documents outside fold 0."""
    configure(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id") == 0)
    model = language.train(language.sample(docs.where(~F.col("held_out"))))
    return language.predict(docs.select("doc_id", "held_out", "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "bits_per_byte"
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every whole text."""
    configure(spark)
    return secrets.report(secrets.scan(documents(spark, sf_dir).select("doc_id", "text")))


def op10_topk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector."""
    configure(spark)
    return segments.top_products(embeddings(spark, sf_dir), F.col("id") % 20 == 0, k=20)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every damaged conversation."""
    configure(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repairs(conversations.damaged(rows), gone="gone")


def op12_cap_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label linked at a cosine of 0.93 or more."""
    configure(spark)
    return caps.near_duplicates(embeddings(spark, sf_dir), cosine=0.93)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers linked by shared ends, with the counts of their links over the corpus."""
    configure(spark)
    found = alignment.align(documents(spark, sf_dir), *map(public_tokenizers.path, ALIGNED), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_roundtrip": op1_bpe_roundtrip,
    "op2_mix_sources": op2_mix_sources,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_shard_tree": op4_shard_tree,
    "op5_ann_projections": op5_ann_projections,
    "op6_lm_deleted_interpolation": op6_lm_deleted_interpolation,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_language_ppm": op8_language_ppm,
    "op9_secret_scan": op9_secret_scan,
    "op10_topk_segments": op10_topk_segments,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_cap_near_dedup": op12_cap_near_dedup,
    "op13_token_alignment": op13_token_alignment,
}
