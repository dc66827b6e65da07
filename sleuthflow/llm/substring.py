"""Repeated passages by hashing of lines.

Units are the lines of a text, its paragraphs (lines without a blank one between) and, inside a line, its sentences
of some length. A unit is normalised (lower case, words joined by
one blank) and hashed to 128 bits; digests are grouped globally, the earliest ranked occurrence stays and the others
are reported with their offsets in the original text. A sentence inside a reported line is not reported again;
a line inside a reported paragraph, but for the first, is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sleuthflow.llm.common import slices
from sleuthflow.session import materialize

LEAST_WORDS = 10
_LINES = re.compile(r"[^\n]+").finditer
_SENTENCES = re.compile(r"\S.*?(?:[.!?](?=\s)|$)").finditer


def units_of(text: str, least: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(line start, start, end, words, digest) of every line and of every paragraph of several lines, whatever their
    length, and of the sentences of `least` words or more of lines with several. A paragraph counts for its first line."""

    def unit(line: int, start: int, end: int, floor: int) -> Iterator[tuple[int, int, int, int, bytes]]:
        words = text[start:end].lower().split()
        if len(words) >= floor:
            yield line, start, end, len(words), xxhash.xxh3_128_digest(" ".join(words).encode())

    block: list[tuple[int, int]] = []
    for line in _LINES(text):
        start, end = line.span()
        if text[start:end].isspace() or (block and start > block[-1][1] + 1):
            if len(block) > 1:
                yield from unit(block[0][0], block[0][0], block[-1][1], 1)
            block = []
        if not text[start:end].isspace():
            block.append((start, end))
        yield from unit(start, start, end, 1)
        sentences = [m.span() for m in _SENTENCES(text, start, end)]
        if len(sentences) > 1:
            for low, high in sentences:
                yield from unit(start, low, high, least)
    if len(block) > 1:
        yield from unit(block[0][0], block[0][0], block[-1][1], 1)


def units(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    names = [key, "copy", "row", "line", "start", "end", "n_words", "digest"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    source = docs.select(key, text, F.xxhash64(text).alias("copy"), F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                copies = list(zip(part.column("copy").to_pylist(), part.column("row").to_pylist()))
                rows, owner = [], []
                for k, value in enumerate(part.column(text).to_pylist()):
                    for unit in units_of(value or "", least):
                        rows.append((*copies[k], *unit))
                        owner.append(k)
                columns = [part.column(0).take(pa.array(owner, pa.int32()))]
                columns += [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"`{key}` {kind}, copy bigint, row bigint, line int, start int, end int, n_words int, digest binary")


def repeated(docs: DataFrame, least: int = LEAST_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, n_words, kept_<key>, kept_start) of every unit that repeats an earlier one.

    Occurrences are ranked by key (nulls last), then by start; the first stays and has no row. Offsets are code
    points of the original text, end exclusive. Sentences below `least` words are left alone; null and blank texts
    have none. Repeated rows repeat their units, of which one stays; other columns are not read; an empty table
    gives an empty one. A unit that a third of all rows share is pre-aggregated and its join can be split.
    """
    stored = materialize(units(docs, key, text, least).withColumn("uid", F.monotonically_increasing_id()), "units")
    rank = F.struct(F.col(key).isNull().alias("absent"), F.col(key).alias("key"), F.col("start").alias("start"), F.col("line").alias("line"), "uid")
    # A line and its only sentence are one unit, so every occurrence counts.
    # Stored, since a join can be split at a hot digest only if no aggregate stands right before it.
    first = materialize(stored.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1), "first")
    again = stored.join(first, "digest").where(F.col("uid") != F.col("first.uid"))
    again = materialize(again.drop("digest", "n"), "repeats")
    whole = (
        again.where(F.col("start") == F.col("line"))
        .groupBy(F.col("row").alias("_row"), F.col("line").alias("_line"))
        .agg(F.max("end").alias("_until"))
    )
    same = (F.col("row") == F.col("_row")) & (F.col("line") == F.col("_line"))
    found = again.join(whole, same, "left")
    inside = (F.col("start") > F.col("line")) | (F.col("end") < F.col("_until"))
    covered = F.coalesce(inside & (F.col("end") <= F.col("_until")), F.lit(False))
    return found.where(~covered).select(
        key, "start", "end", "n_words", F.col("first.key").alias(f"kept_{key}"), F.col("first.start").alias("kept_start"), "copy"
    )


def without_repeats(docs: DataFrame, least: int = LEAST_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with repeated units cut out of the text; other columns stay, null texts stay null.

    Of rows with equal key and text, a unit is cut only if it repeats in all of them.
    """
    name = [F.col(key).alias("_k"), F.xxhash64(text).alias("_copy")]
    rows = docs.select(*name).groupBy("_k", "_copy").agg(F.count("*").alias("_rows"))
    spans = repeated(docs, least, key, text).groupBy(F.col(key).alias("_k2"), F.col("copy").alias("_c2"), "start", "end").agg(F.count("*").alias("_n"))
    joined = spans.join(rows, spans["_k2"].eqNullSafe(rows["_k"]) & (spans["_c2"] == rows["_copy"]))
    cut = joined.where(F.col("_n") >= F.col("_rows")).groupBy("_k2", "_c2").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    state = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))

    def step(s, x):
        return F.struct(
            F.concat(s["kept"], F.substring(F.col(text), s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))).alias("kept"),
            F.greatest(s["at"], x["end"]).alias("at"),
        )

    folded = F.aggregate("_spans", state, step)
    rest = F.concat(folded["kept"], F.substring(F.col(text), folded["at"] + 1, F.length(text)))
    same = F.col(key).eqNullSafe(F.col("_k2")) & (F.xxhash64(F.col(text)) == F.col("_c2"))
    found = docs.join(cut, same, "left")
    return found.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(rest)).select(*docs.columns)
