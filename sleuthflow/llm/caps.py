"""Exact links of near-equal embeddings, found by spherical-cap filters (Becker, Ducas, Gama, Laarhoven 2016).

Filters are the caps around the words of a random product code: after a rotation, a vector is cut in two halves,
each half has its own few hundred random directions, and every pair of them is one filter direction. The best
filters of a vector are list-decoded from the two short score lists, without touching the other quarter of a
million. A vector takes all directions that exceed its own cap height, which is the score of its LISTED-th best:
one height for all leaves unlucky vectors without a filter (measured in 64 dimensions for pairs of cosine 0.93:
0.27 % of the pairs lost at 125 filters a vector, against 0.07 % at 32 with own heights). Independent rotations
multiply the losses, so that two of them lose some 10^-6 of the pairs right at the threshold and fewer above.

Vectors meet in the filters they share. A first round carries 128 sign bits only and drops every posting that has
no partner within reach in its filter; a second round carries vectors and decides by the cosine in double
precision. A pair that meets in several filters counts in the least one. Filters with many members are cut in
tiles, and pairs of tiles are compared as rows. A batch reports counts per vector and a forest of its links,
never the pairs of a dense group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sleuthflow.llm.components import components
from sleuthflow.llm.vectors import usable
from sleuthflow.session import materialize

#: Most directions of a half, filters a vector takes per rotation, and rotations.
CODEWORDS, LISTED, ROTATIONS = 512, 24, 2
#: Share of sampled pairs at the threshold that one rotation may leave without a common filter, and the sample.
MISSED, SAMPLED = 0.004, 2048
#: Members of a filter that are compared as one block.
TILE = 1024
#: Sign bits, and standard deviations by which a linked pair may differ in more of them than expected.
SIGNS, SLACK = 128, 6.0
SEED = 12

BUCKET = ["label", "length", "filter"]


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares of very large or small components are no trouble."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("nd,nd->n", scaled, scaled))[:, None]


class ProductCode:
    """One rotation with `codewords` random directions in each half."""

    def __init__(self, length: int, codewords: int, listed: int, seed: int) -> None:
        rng = np.random.default_rng([SEED, length, codewords, seed])
        self.rotation = np.linalg.qr(rng.standard_normal((length, length)))[0]
        self.cut = length // 2
        self.halves = []
        for size in (self.cut, length - self.cut):
            words = rng.standard_normal((codewords, size))
            self.halves.append(words / np.maximum(np.sqrt((words**2).sum(axis=1, keepdims=True)), 1e-300))
        self.codewords, self.listed = codewords, min(listed, codewords**2)
        # The best sums of two falling lists lie where (place in one) * (place in the other) <= listed.
        self.places = np.array(
            [(i, j) for i in range(min(listed, codewords)) for j in range(min(listed, codewords)) if (i + 1) * (j + 1) <= listed]
        )

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """Numbers of the filters of every unit vector."""
        turned = rows @ self.rotation
        scores = [part @ words.T for part, words in zip((turned[:, : self.cut], turned[:, self.cut :]), self.halves)]
        best = [np.argsort(-s, axis=1, kind="stable")[:, : self.listed] for s in scores]
        top = [np.take_along_axis(s, b, 1) for s, b in zip(scores, best)]
        i, j = self.places.T
        taken = np.argsort(-(top[0][:, i] + top[1][:, j]), axis=1, kind="stable")[:, : self.listed]
        first, second = np.take_along_axis(best[0], i[taken], 1), np.take_along_axis(best[1], j[taken], 1)
        return first.astype(np.int64) * self.codewords + second


def _sampled_pairs(length: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Seeded pairs of unit vectors at exactly the cosine."""
    rng = np.random.default_rng([SEED, length])
    u = units(rng.standard_normal((SAMPLED, length)))
    w = rng.standard_normal((SAMPLED, length))
    w = units(w - np.einsum("nd,nd->n", u, w)[:, None] * u)
    return u, cosine * u + math.sqrt(max(0.0, 1 - cosine * cosine)) * w


@lru_cache(maxsize=64)
def codes(length: int, cosine: float, codewords: int, listed: int, rotations: int) -> tuple[ProductCode, ...]:
    """Codes for one vector length: as many directions as keep sampled pairs at the threshold together.

    Few dimensions hold fewer distinct directions within the angle of a pair; in the end one filter is left that
    all vectors share, and every pair is compared.
    """
    while codewords > 1 and length > 1:
        code = ProductCode(length, codewords, listed, 0)
        u, v = (code.decode(x) for x in _sampled_pairs(length, cosine))
        together = np.concatenate([(a[:, :, None] == b[:, None, :]).any(axis=(1, 2)) for a, b in zip(np.array_split(u, 8), np.array_split(v, 8))])
        if 1 - together.mean() <= MISSED:
            return tuple(ProductCode(length, codewords, listed, n) for n in range(rotations))
        codewords //= 2
    return (ProductCode(length, 1, 1, 0),)


def sign_radius(cosine: float) -> int:
    """Differing sign bits up to which a pair is decided by its vectors."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.ceil(SIGNS * p + SLACK * math.sqrt(SIGNS * p * (1 - p)))


def signs(rows: np.ndarray) -> np.ndarray:
    """Signs of fixed random projections, packed in 64-bit words."""
    planes = np.random.default_rng([SEED, rows.shape[1], SIGNS]).standard_normal((rows.shape[1], SIGNS))
    return np.packbits(rows @ planes > 0, axis=1).view(np.int64)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def decoded(classes: DataFrame, cosine: float, codewords: int, listed: int, rotations: int) -> DataFrame:
    """(class, label, length, filters, signs) of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == n))
                rows = units(part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n))
                found = [c.decode(rows) + k * c.codewords**2 for k, c in enumerate(codes(n, cosine, codewords, listed, rotations))]
                length = pa.array(np.full(len(rows), n, np.int32))
                columns = [part.column("class"), part.column("label"), length, _lists(np.hstack(found)), _lists(signs(rows))]
                yield pa.RecordBatch.from_arrays(columns, ["class", "label", "length", "filters", "signs"])

    kind = classes.schema["label"].dataType.simpleString()
    schema = f"class bigint, label {kind}, length int, filters array<bigint>, signs array<bigint>"
    return classes.select("class", "label", "vector").mapInArrow(run, schema)


def _met(postings: DataFrame, payload: list[str]) -> DataFrame:
    """(filter, split, payload lists): every block of members to be compared, whole or in pairs of tiles.

    `split` is the number of members of the first tile of a pair, 0 for a tile with itself. The tiles of a large
    filter are dealt out by filter and tile, so that none of its steps sits in one task.
    """
    hot = materialize(
        postings.groupBy(*BUCKET).agg(F.count("*").alias("members")).where(F.col("members") > TILE)
        .select(*BUCKET, F.ceil(F.col("members") / F.lit(TILE)).cast("int").alias("tiles")),
        "large-filters",
    )
    tiles = materialize(
        postings.join(hot, BUCKET, "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
        .repartition(*BUCKET, "tile")
        .groupBy(*BUCKET, "tile", "tiles")
        .agg(F.collect_list(F.struct("class", *payload)).alias("rows"))
        .where((F.size("rows") > 1) | (F.col("tiles") > 1)),
        "tiles",
    )
    listed = [F.col("filter"), *[F.col(f"rows.{c}").alias(c) for c in ["class", *payload]]]
    alone = tiles.where(F.size("rows") > 1).select(F.lit(0).alias("split"), *listed)
    several = tiles.where(F.col("tiles") > 1)
    left = several.withColumn("other", F.explode(F.sequence("tile", F.col("tiles") - 1))).where(F.col("other") > F.col("tile"))
    right = several.select(*BUCKET, F.col("tile").alias("other"), F.col("rows").alias("theirs"))
    both = left.join(right, [*BUCKET, "other"]).withColumn("split", F.size("rows")).withColumn("rows", F.concat("rows", "theirs"))
    return alone.unionByName(both.select("split", *listed))


class Members:
    """Members of the blocks of one Arrow batch, in a row; `pairs` are all that are to be compared."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.sizes = pc.list_value_length(batch.column("class")).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = self.sizes.cumsum()
        self.block = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.ends = np.repeat(ends, self.sizes)
        self.filter = np.repeat(batch.column("filter").to_numpy(), self.sizes)
        split = np.repeat(batch.column("split").to_numpy().astype(np.int64), self.sizes)
        place = np.arange(len(self.block)) - np.repeat(ends - self.sizes, self.sizes)
        self.crossed, self.second = split > 0, place >= split
        self.ids, self.inverse = np.unique(batch.column("class").flatten().to_numpy(), return_inverse=True)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index arrays (i, j), one step for each distance of places."""
        i, step = np.arange(len(self.block)), 1
        while len(i := i[i + step < self.ends[i]]):
            j = i + step
            wanted = ~self.crossed[i] | (self.second[j] & ~self.second[i])
            yield i[wanted], j[wanted]
            step += 1


def partnered(met: DataFrame, radius: int) -> DataFrame:
    """(class, filter): postings with another within `radius` sign bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            members = Members(batch)
            bits = batch.column("signs").flatten().flatten().to_numpy().view(np.uint64).reshape(-1, SIGNS // 64)
            kept = np.zeros(len(bits), bool)
            for i, j in members.pairs():
                near = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= radius
                kept[i[near]] = kept[j[near]] = True
            columns = [pa.array(members.ids[members.inverse[kept]]), pa.array(members.filter[kept])]
            yield pa.RecordBatch.from_arrays(columns, ["class", "filter"])

    return met.mapInArrow(run, "class bigint, filter bigint")


def _lesser_filters(members: Members, filters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bit sets of the filters below the block's own that at least two of its members hold."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    below = filters < members.filter[owner]
    owner, held = owner[below], filters[below]
    order = np.lexsort((held, members.block[owner]))
    owner, held = owner[order], held[order]
    block = members.block[owner]
    new = np.ones(len(held), bool)
    new[1:] = (block[1:] != block[:-1]) | (held[1:] != held[:-1])
    run = new.cumsum() - 1
    shared = np.bincount(run, minlength=1)[run] > 1 if len(run) else np.zeros(0, bool)
    owner, block, run = owner[shared], block[shared], run[shared]
    if not len(run):
        return np.zeros((len(sizes), 1), np.uint64)
    first = np.full(len(members.sizes), np.iinfo(np.int64).max)
    np.minimum.at(first, block, run)
    place = run - first[block]
    bits = np.zeros((len(sizes), int(place.max()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (owner, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    return bits


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-member labels after joining the sets of `a` and `b`."""
    a, b = label[a], label[b]
    a, b = a[a != b], b[a != b]
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return label[label]


def verified(met: DataFrame, cosine: float) -> DataFrame:
    """(u, v, links): a forest (u, v) of the linked classes, and with v null, links that u has in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = pc.list_value_length(pc.list_element(whole.column("vector"), 0)).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths).tolist():
                batch = whole.filter(pa.array(lengths == n))
                members = Members(batch)
                rows = units(batch.column("vector").flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n))
                copies = batch.column("copies").flatten().to_numpy()
                held = batch.column("filters").flatten()
                lesser = _lesser_filters(members, held.flatten().to_numpy(), pc.list_value_length(held).to_numpy().astype(np.int64))
                links, label = np.zeros(len(members.ids), np.int64), np.arange(len(members.ids))
                for i, j in members.pairs():
                    here = ~(lesser[i] & lesser[j]).any(axis=1)
                    i, j = i[here], j[here]
                    near = np.einsum("nd,nd->n", rows[i], rows[j]) >= cosine
                    i, j = i[near], j[near]
                    a, b = members.inverse[i], members.inverse[j]
                    np.add.at(links, a, copies[j])
                    np.add.at(links, b, copies[i])
                    label = merged(label, a, b)
                child, some = np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(links)
                u = np.concatenate([members.ids[child], members.ids[some]])
                v = pa.array(np.concatenate([members.ids[label[child]], members.ids[some]]), mask=np.arange(len(u)) >= len(child))
                counts = pa.array(np.concatenate([np.zeros(len(child), np.int64), links[some]]))
                yield pa.RecordBatch.from_arrays([pa.array(u), v, counts], ["u", "v", "links"])

    return met.mapInArrow(run, "u bigint, v bigint, links bigint")


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.93,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    codewords: int = CODEWORDS,
    listed: int = LISTED,
    rotations: int = ROTATIONS,
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Rows of equal label whose vectors have a cosine of at least `cosine` in double precision are linked, as far
    as they share a filter (see MISSED: some 10^-5 at most of the pairs right at the threshold do not); no pair
    below it is. n_links counts the other rows linked directly, component_id is the smallest key that links
    reach, the row's own included, and kept says that it is the row's own.

    A null label, and vectors null, empty, zero or with null or non-finite components link with nothing; so do
    vectors of different lengths. Equal vectors of a label are searched once and counted for every row. Rows
    with a null key link like others; their component is null only if no key is reached. Repeated rows stay
    repeated. Other columns are not read; an empty table gives an empty one. About 0.1 % of the pairs of unlike
    vectors of a label meet in a filter; labels of many millions want more `codewords`.
    """
    here = F.col("label").isNotNull() & usable("vector", zero=False)
    hashes: list[Column] = [F.when(here, F.xxhash64(F.lit(n), "label", "vector")).alias(f"h{n}") for n in (1, 2)]
    rows = materialize(
        vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label")).select("key", "label", "vector", *hashes),
        "vectors",
    )
    same = ["label", "h1", "h2"]
    classes = materialize(
        rows.where(F.col("h1").isNotNull())
        .groupBy(*same).agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("key").alias("least"))
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    filtered = materialize(decoded(classes, cosine, codewords, listed, rotations), "filters")
    postings = filtered.select("class", "label", "length", "signs", F.explode("filters").alias("filter"))
    found = materialize(partnered(_met(postings, ["signs"]), sign_radius(cosine)), "partnered")
    lists = found.groupBy("class").agg(F.collect_set("filter").alias("filters"))
    held = materialize(
        lists.join(classes.select("class", "label", "vector", "copies"), "class")
        .select("class", "label", F.size("vector").alias("length"), "vector", "copies", "filters"),
        "held",
    )
    met = _met(held.withColumn("filter", F.explode("filters")), ["vector", "copies", "filters"])
    links = materialize(verified(met, cosine), "links")
    counts = materialize(links.where(F.col("v").isNull()).groupBy(F.col("u").alias("class")).agg(F.sum("links").alias("links")), "counts")
    roots = components(links.where(F.col("v").isNotNull()), "u", "v")
    rooted = classes.join(roots, classes["class"] == roots["node"], "left").withColumn("root", F.coalesce("root", "class")).drop("node")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    told = materialize(
        rooted.join(least, "root").join(counts, "class", "left")
        .select(*same, "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "told",
    )
    component = F.when(F.col("n_links").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return rows.select("key", *same).join(told, same, "left").select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )
