"""Placement by a hierarchical weighted hash tree.

A tree has regions, racks and shards, each with the weight of what lies below it. A key descends level by
level: every child draws -ln(u) / weight from a hash of key and child, and the least draw wins (weighted
rendezvous). A changed weight changes the draws of that child alone, so rows move only into or out of the
subtree whose weight changed. A shard that is added as a region of its own takes rows only into itself.

Draws use the first 52 bits of MD5, so that any SQL engine can repeat them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sleuthflow.llm.numbering import numbered
from sleuthflow.session import materialize

PER_RACK = 2
PER_REGION = 4
BITS = 52


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def full_tree(shards: int) -> list[Shard]:
    """Equal shards, two to a rack and two racks to a region."""
    return [Shard(s // PER_REGION, s // PER_RACK, s) for s in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region and a rack of its own."""
    top = [max(x) + 1 for x in zip(*[(s.region, s.rack, s.shard) for s in tree])]
    return [*tree, Shard(*top, weight)]


def _draw(key: Column, level: str, child: int, weight: float) -> Column:
    """Least wins; u lies strictly between 0 and 1."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{level}{child}")).cast("binary")), 1, BITS // 4)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << BITS))
    return -F.log(u) / F.lit(float(weight))


def _winner(key: Column, level: str, children: dict[int, float]) -> Column:
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [F.struct(_draw(key, level, c, w).alias("draw"), F.lit(c).alias("child")) for c, w in children.items()]
    return F.least(*draws)["child"]


def placement(key: Column, tree: list[Shard]) -> Column:
    """Shard of a key; a null key is the text `null`."""
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def below(level: int, members: list[Shard]) -> Column:
        names = ("region", "rack", "shard")
        if level == len(names):
            return F.lit(members[0].shard)
        groups: dict[int, list[Shard]] = {}
        for s in members:
            groups.setdefault(getattr(s, names[level]), []).append(s)
        winner = _winner(text, names[level], {c: sum(s.weight for s in ms) for c, ms in groups.items()})
        found = None
        for child, ms in groups.items():
            under = below(level + 1, ms)
            found = F.when(winner == child, under) if found is None else found.when(winner == child, under)
        return found if len(groups) > 1 else below(level + 1, members)

    return below(0, tree)


def shards(
    docs: DataFrame, tree: list[Shard], more: list[Shard] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row of `docs`.

    The law is `key`: key and tree alone decide the shard, so copies of a text under other keys may part.
    size is the UTF-8 length plus 1; a null text has size 1 and the CRC of an empty one. Null keys share one
    shard. slot numbers a shard's rows from 0 by key, size, CRC; repeated rows get slots of their own.
    grown_shard is the shard under `more`, null without it. Other columns are not read; an empty table gives
    an empty one.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    at = F.col(key)
    placed = docs.select(
        key,
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        placement(at, tree).cast("int").alias("shard"),
        (placement(at, more) if more else F.lit(None)).cast("int").alias("grown_shard"),
    )
    order = [F.col(key).asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc()]
    columns = [key, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return numbered(materialize(placed, "shard-rows"), "shard", order, "slot").select(*columns)
