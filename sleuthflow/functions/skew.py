"""Joining one fact row per key onto many raw rows when one key may hold a third of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ROWS_PER_SLICE = 2_000_000
#: Longest list of hot keys that is broadcast.
MOST_HOT = 500_000


def attach(
    rows: DataFrame,
    facts: DataFrame,
    key: str,
    spread_by: list[str],
    size: str = "n_rows",
    rows_per_slice: int = ROWS_PER_SLICE,
    most_hot: int = MOST_HOT,
) -> DataFrame:
    """Inner join of `facts` (one row per `key`, with its row count in `size`) onto `rows`.

    A key with more than `rows_per_slice` rows is cut into slices by a hash of `spread_by`, and its fact
    row is repeated once per slice. The list of such keys is broadcast; it holds the `most_hot` largest, so it is
    bounded whatever the input. A key beyond them has less than one in `most_hot` of all rows and is joined whole,
    as are the keys below the limit.
    """
    slices = F.ceil(F.col(size) / F.lit(rows_per_slice)).cast("int")
    largest = facts.where(F.col(size) > rows_per_slice).orderBy(F.desc(size), key).limit(most_hot)
    hot = F.broadcast(largest.select(key, slices.alias("_slices")))
    parts = F.coalesce("_slices", F.lit(1))
    cut = rows.join(hot, key, "left").withColumn("_slice", F.pmod(F.xxhash64(*spread_by), parts).cast("int")).drop("_slices")
    spread = facts.join(hot, key, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_slices")
    return cut.join(spread, [key, "_slice"]).drop("_slice")
