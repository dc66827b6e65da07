"""Gapless numbers over sorted groups of any size, without ordering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sleuthflow.session import materialize

_ROW = (1 << 33) - 1


def numbered(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """`df` with `out`: 0, 1, 2, ... inside each `group`, by `order`.

    The table is range partitioned by group and order and sorted within partitions; a row's number is its
    place in its partition, less the place where its group starts there, plus the rows of the group in
    earlier partitions. Rows that tie in `order` are told apart by their input place, so that even a third
    of all rows in one tie is cut between partitions; equal rows are interchangeable. Nulls come first.
    """
    by = [F.col(group).asc_nulls_first(), *order, F.col("_input").asc()]
    placed = materialize(
        df.withColumn("_input", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("_input")
        .withColumn("_place", F.monotonically_increasing_id()),
        "placed",
    )
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit(_ROW))
    starts = placed.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(
        F.min(place).alias("_start"), F.count("*").alias("_rows")
    )
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_start"))
    return (
        placed.join(starts, (part == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
        .withColumn(out, (place + F.col("_shift")).cast("long"))
        .drop("_place", "_group", "_part", "_start", "_rows", "_shift")
    )
