"""Mixing sources to target weights by pivotal dependent rounding.

Every row of a source is wanted rate = target / source size times, at most `most` times. It is taken
floor(rate) times for certain; the remaining fraction is rounded to 0 or 1 dependently: two rows meet, and
words are moved from one to the other, at random but with the expectation kept, until the fraction of one is
0 or 1. What is left of the other meets the next row. Rows meet inside blocks of bounded size; the residual of
each block goes on to a block of the next level, until each source has one residual, which is rounded alone.
The words that a source gives thus miss its target by less than one row, and every row keeps its rate.

All draws are hashes of the keys, so a rerun takes the same rows on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sleuthflow.llm.numbering import numbered
from sleuthflow.session import materialize

BLOCK = 256
CYCLE = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
_UNIT = float(1 << 53)


def _chance(*parts: Column | str) -> Column:
    """Uniform in (0, 1) by hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + F.lit(0.5)) / F.lit(_UNIT)


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, get the weights of `cycle`, repeating, of `share` times all sizes. A
    target stops at `most` times its source's size and what is above is shared again by weight: the level,
    words per unit of weight, rises until no further source is above. Only totals reach the driver.
    """
    listed = sizes.withColumn("_last", F.col("source").isNull())
    ranked = numbered(listed, "_last", [F.col("source").asc_nulls_last()], "_rank")
    before = sizes.where(F.col("source").isNotNull()).count()
    number = F.when(F.col("_last"), F.lit(before)).otherwise(0) + F.col("_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.pmod(number, F.lit(len(cycle))) + 1).cast("int"))
    weighed = materialize(ranked.select("source", "source_size", weight.alias("weight")), "weights")
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= F.col("source_size") * F.lit(most)
        total, fixed, open_weight, n = weighed.agg(
            F.sum("source_size"),
            F.sum(F.when(above, F.col("source_size"))),
            F.sum(F.when(~above, F.col("weight"))),
            F.sum(above.cast("long")),
        ).first()
        if n is None or n == full or not open_weight:
            break
        full, level = n, (share * total - most * (fixed or 0)) / open_weight
    target = F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(most)).cast("double")
    return weighed.select("source", "source_size", target.alias("target"))


def _settle(state: Column, item: Column) -> Column:
    """The item in hand meets the next one: one of them becomes integral, the other stays in hand."""
    held = state["held"]
    a, b = held["part"] * held["words"], item["part"] * item["words"]
    free_a, free_b = held["words"] - a, item["words"] - b
    gain, loss = F.least(free_a, b), F.least(a, free_b)
    up = _chance(F.lit("meet"), held["draw"], item["draw"]) * (gain + loss) < loss
    moved = F.when(up, gain).otherwise(-loss)
    first = F.when(up, free_a <= b).otherwise(a <= free_b)

    def entry(source: Column, part: Column) -> Column:
        return F.struct(
            source["draw"].alias("draw"), source["key"].alias("key"), source["words"].alias("words"), part.alias("part")
        )

    def inside(part: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))

    new_a = F.when(first, F.when(up, 1.0).otherwise(0.0)).otherwise(inside((a + moved) / held["words"]))
    new_b = F.when(first, inside((b - moved) / item["words"])).otherwise(F.when(up, 0.0).otherwise(1.0))
    out = F.when(first, entry(held, new_a)).otherwise(entry(item, new_b))
    keep = F.when(first, entry(item, new_b)).otherwise(entry(held, new_a))
    return F.struct(keep.alias("held"), F.concat(state["done"], F.array(out)).alias("done"))


def _rounded(items: DataFrame, block: int) -> DataFrame:
    """(source, key, extra) with extra 0 or 1 for every item (source, key, words > 0, 0 < part < 1)."""
    entry = F.struct("draw", "key", "words", "part")
    level = materialize(items.withColumn("draw", F.xxhash64(F.lit("order"), "source", "key")), "mix-items")
    found = None
    depth = 0
    while True:
        counts = level.groupBy("source").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
        counts = materialize(counts, "mix-blocks")
        most = counts.agg(F.max("blocks")).first()[0]
        if most is None:
            break
        cut = (
            level.join(counts, level["source"].eqNullSafe(counts["source"])).drop(counts["source"])
            .groupBy("source", F.pmod(F.xxhash64(F.lit(depth), "draw"), "blocks").alias("_block"))
            .agg(F.sort_array(F.collect_list(entry)).alias("_items"))
        )
        kind = "array<" + level.select(entry.alias("x")).schema["x"].dataType.simpleString() + ">"
        start = F.struct(F.col("_items")[0].alias("held"), F.array().cast(kind).alias("done"))
        folded = cut.withColumn("_state", F.aggregate(F.slice("_items", F.lit(2), F.size("_items")), start, _settle))
        folded = materialize(folded.select("source", "_state"), "mix-level")
        done = folded.select("source", F.inline("_state.done"))
        found = done if found is None else found.unionByName(done)
        level = folded.select("source", "_state.held.*")
        if most == 1:
            alone = (_chance(F.lit("alone"), "draw") < F.col("part")).cast("double")
            found = found.unionByName(level.withColumn("part", alone))
            break
        whole = F.col("part").isin(0.0, 1.0)
        found = found.unionByName(level.where(whole))
        level = level.where(~whole)
        depth += 1
    if found is None:
        return items.select("source", "key", F.lit(0).alias("extra"))
    return found.select("source", "key", F.col("part").cast("int").alias("extra"))


def copies(
    rows: DataFrame,
    share: float = SHARE,
    most: float = MOST,
    cycle: tuple[int, ...] = CYCLE,
    block: int = BLOCK,
    key: str = "doc_id",
    source: str = "source",
    size: str = "size",
) -> DataFrame:
    """(key, source, size, source_size, target, repeats, copies): how often each distinct row is taken.

    `rows` has key, source and size (words, not null). Rows equal in all three are one item with `repeats`
    rows, of which the words count together; `copies` is what all of them are taken together, spread evenly
    by `spread`. Rows without words carry no mass; they are rounded alone. A source without words has
    target 0. Null keys and sources are values like any other. An empty table gives an empty one.
    """
    items = rows.groupBy(F.col(key).alias("key"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"))
    items = materialize(items.agg(F.count("*").alias("repeats")), "mix-rows")
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("source_size"))
    wanted = targets(materialize(sizes, "mix-sizes"), share, most, cycle)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = items.join(wanted, items["source"].eqNullSafe(wanted["source"])).drop(wanted["source"])
    joined = materialize(joined.withColumn("wish", rate * F.col("repeats")).withColumn("sure", F.floor("wish")), "mix-wish")
    part = F.col("wish") - F.col("sure")
    name = F.struct("key", "size")
    moving = joined.where((part > 0) & (F.col("size") > 0)).select(
        "source", name.alias("key"), F.col("size").cast("double").alias("words"), part.alias("part")
    )
    extra = _rounded(moving, block).select(F.col("source").alias("_source"), F.col("key").alias("_key"), "extra")
    lonely = F.when(F.col("size") == 0, (_chance(F.lit("blank"), "source", "key") < part).cast("int")).otherwise(0)
    on = F.col("source").eqNullSafe(F.col("_source")) & F.col("key").eqNullSafe(F.col("_key.key"))
    return joined.join(extra, on & (F.col("size") == F.col("_key.size")), "left").select(
        F.col("key").alias(key),
        F.col("source").alias(source),
        F.col("size").alias(size),
        "source_size",
        "target",
        "repeats",
        (F.col("sure") + F.coalesce("extra", lonely)).cast("long").alias("copies"),
    )


def spread(taken: DataFrame, at_once: int = 100_000) -> DataFrame:
    """One row per input row: the copies of repeated rows are dealt evenly, the first ones take one more.

    More than `at_once` repeats are first cut in runs that are dealt over the tasks.
    """
    run = F.floor((F.col("repeats") - 1) / F.lit(at_once))
    cut = taken.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), run)))
    few = F.col("repeats") <= at_once
    dealt = cut.where(few).unionByName(cut.where(~few).repartition(*[F.col(c) for c in taken.columns[:3]], "_run"))
    low = F.col("_run") * at_once + 1
    each = dealt.withColumn("_nth", F.explode(F.sequence(low, F.least(low + (at_once - 1), "repeats"))))
    more = (F.col("_nth") <= F.pmod("copies", "repeats")).cast("long")
    return each.withColumn("copies", F.floor(F.col("copies") / F.col("repeats")) + more).drop("_nth", "_run", "repeats")
