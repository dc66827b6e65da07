"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Words are runs of anything but space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a Python worker handles at once.
SLICE_BYTES = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def fold(key: str) -> Column:
    """crc32 of the key as text, modulo 5; a null key counts as the text `null`."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")), F.lit(5)).cast("int")


def extended(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    """Schema of `df` with `fields` behind it; fields of the same name are replaced."""
    added = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in added] + fields)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `size` text bytes; one long text makes a run of its own."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
    part = (lengths + 64).cumsum() // size
    edges = [0, *((part[1:] != part[:-1]).nonzero()[0] + 1).tolist(), batch.num_rows]
    for low, high in zip(edges, edges[1:]):
        yield batch.slice(low, high - low)


def texts_as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of every text, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
