"""SimHash fingerprints and exact near-duplicate groups by tiled comparison.

A fingerprint bit is 1 if it is set in more than half of the hashes of a text's word shingles. Distinct
fingerprints (copies fold into one) are laid out in cells by population count, and pairs of tiles whose counts
differ by more than the radius are skipped. For a small radius the counts of four 16-bit quarters are taken:
flipping a bit changes one of them by one, so the sum of their differences is at most the radius. A cell is cut
in tiles of bounded size; each needed pair of tiles is one row with both packed arrays and is compared whole
with exclusive-or and bit counts. A tile pair reports a spanning forest of the links it finds, never all pairs
of a dense group.

Fingerprints of several 64-bit words serve similarities as low as 0.8, which 64 bits cannot tell from chance:
the first word sifts the pairs, the whole fingerprint makes them candidates, and the sets of shingles decide.
Sets of Jaccard similarity J differ in size by a factor of 1 / J at most, so there the cells are laid out by size.
Strips of tiles are dealt out in pairs, so that a large cell is compared by many tasks.
Candidate groups are cut in blocks of bounded size; each pair of blocks of a group is one row and reports a
spanning forest of the pairs whose Jaccard similarity is high enough.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sleuthflow.llm.common import SLICE_BYTES, slices, texts_as_bytes
from sleuthflow.llm.components import components
from sleuthflow.session import materialize

SEED = 42
#: Fingerprints in a tile, for small and for large radii.
TILE, WIDE_TILE = 2048, 8192
#: Tiles of a cell that are dealt out together for large radii.
STRIP = 4
#: Cells of sizes within the factor that a similarity allows.
SIZE_STEPS = 2
#: Largest radius for which cells are laid out by quarters.
QUARTERED = 3
#: Pairs compared at once (few enough for a core's cache), and links that are gathered before they are joined.
AT_ONCE, LINKS = 1 << 17, 1 << 18
#: Standard deviations of the distance at the wanted similarity that candidates may lie above its mean.
SLACK = 3.5
#: Shingles and texts in a block that is compared exactly.
BLOCK, BLOCK_TEXTS = 1 << 18, 256
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _pieces(text: bytes, limit: int) -> Iterator[list[bytes]]:
    """Words of a text in bounded lists, cut at white space only."""
    low = 0
    while len(text) - low > limit:
        high = low + limit
        while high < len(text) and not text[high : high + 1].isspace():
            high += 1
        yield text[low:high].split()
        low = high
    yield text[low:].split()


def shingle_hashes(text: bytes, words: int, limit: int = SLICE_BYTES) -> Iterator[np.ndarray]:
    """Unsigned XXH64 of every shingle, repeats included, in bounded arrays; a short text is one shingle."""
    digest, seed = xxhash.xxh64_intdigest, itertools.repeat(SEED)
    last: list[bytes] = []
    found = 0
    for piece in _pieces(text.lower(), limit):
        run = last + piece
        n = len(run) - words + 1
        if n > 0:
            rows = map(b" ".join, zip(*[run[k:] for k in range(words)]))
            yield np.fromiter(map(digest, rows, seed), np.uint64, n)
            found += n
        last = run[len(run) - words + 1 :] if n > 0 else run
    if not found and last:
        yield np.array([digest(b" ".join(last), SEED)], np.uint64)


def _distinct(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def fingerprint(text: bytes, words: int, width: int = 1, repeats: bool = True) -> np.ndarray:
    """Fingerprint as signed 64-bit words; a text without words has zeros.

    Without `repeats` every distinct shingle counts once, so that a line said a hundred times does not outweigh
    the rest; the hashes of a text are then held together.

    The first word takes the bits of the shingle hashes themselves, each further one those of a remixed hash.
    """
    return _majority(shingle_hashes(text, words) if repeats else [_distinct(text, words)], width)


def _majority(found: Iterable[np.ndarray], width: int) -> np.ndarray:
    total, counts = 0, np.zeros((width, 64), np.int64)
    for hashes in found:
        total += len(hashes)
        for n in range(width):
            octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
            if len(hashes) <= 512:
                counts[n] += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
            else:
                counts[n] += np.concatenate([np.bincount(octets[:, k], minlength=256) @ BITS for k in range(8)])
            if n + 1 < width:
                hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
                hashes ^= hashes >> np.uint64(32)
    return np.packbits(counts * 2 > total, axis=1).view(">i8")[:, 0].astype(np.int64)


def fingerprints(
    docs: DataFrame, words: int = 5, width: int = 1, key: str = "doc_id", text: str = "text", repeats: bool = True
) -> DataFrame:
    """(key, fp) of every document, whole texts: lower-case ASCII letters, words by ASCII white space.

    Without `repeats` also size, the number of distinct shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found, sizes = [], []
                for t in texts_as_bytes(part, text):
                    hashes = shingle_hashes(t, words) if repeats else [_distinct(t, words)]
                    found.append(_majority(hashes, width))
                    sizes += [] if repeats else [len(hashes[0])]
                offsets = pa.array(np.arange(0, len(found) * width + 1, width, dtype=np.int32))
                fp = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))
                size = {} if repeats else {"size": pa.array(sizes, pa.int32())}
                yield pa.RecordBatch.from_pydict({key: part.column(0), "fp": fp, **size})

    source = docs.select(key, text)
    kinds = f"`{key}` {source.schema[key].dataType.simpleString()}, fp array<bigint>"
    return source.mapInArrow(run, kinds if repeats else f"{kinds}, size int")


def shingle_sets(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(key, shingles): sorted distinct hashes of every text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = [_distinct(t, words).view(np.int64) for t in texts_as_bytes(part, text)]
                offsets = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
                sets = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column(0), sets], [key, "shingles"])

    source = docs.select(key, text)
    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, shingles array<bigint>")


def radius_of(similarity: float, bits: int, slack: float = 1.0) -> int:
    """Differing bits up to which texts of a Jaccard similarity are linked.

    Shingle counts of Jaccard similarity J have cosine 2 J / (1 + J), and a bit differs with probability
    angle / pi. `slack` standard deviations are added so that pairs at the threshold are found.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def _quarters(parts: int) -> Column:
    """Population counts of the first word, or of each of its parts."""
    width = 64 // parts
    mask = F.lit((1 << width) - 1 if parts > 1 else -1)
    return F.array(*[F.bit_count(F.shiftrightunsigned(F.col("fp")[0], width * k).bitwiseAND(mask)) for k in range(parts)])


def _size_cell(similarity: float) -> Column:
    """Logarithm of the size, in steps of which SIZE_STEPS are the factor that the similarity allows; nothing is by itself."""
    # A little wider than the factor, so that rounding moves no pair at the limit out of reach.
    step = max(-math.log(max(similarity, 1e-9)), 1e-6) * (1 + 1e-9) / SIZE_STEPS
    return F.array(F.when(F.col("size") > 0, F.floor(F.log("size") / F.lit(step))).otherwise(-2 * SIZE_STEPS).cast("int"))


def _tiles(distinct: DataFrame, cell: Column, tile: int) -> DataFrame:
    """(cell, tile, ids, words) of packed arrays of about `tile` rows."""
    celled = distinct.select("id", "fp", cell.alias("cell"))
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    tiles = (
        celled.join(F.broadcast(sizes), "cell")
        .groupBy("cell", F.pmod(F.xxhash64("id"), "tiles").cast("int").alias("tile"))
        .agg(F.collect_list(F.struct("id", "fp")).alias("rows"))
    )
    return tiles.select("cell", "tile", F.col("rows.id").alias("ids"), F.flatten("rows.fp").alias("words"))


def _steps(radius: int, parts: int) -> list[list[int]]:
    """Half of the steps between cells whose counts differ by at most `radius` in sum: zero and the positive ones."""
    span = range(-radius, radius + 1)
    near = [s for s in itertools.product(span, repeat=parts) if sum(map(abs, s)) <= radius]
    return [list(s) for s in near if s >= (0,) * parts]


def _reached(rows: DataFrame, steps: list[list[int]], *names: str) -> DataFrame:
    """`rows` once for every cell in reach as `cell`; their own is `_from`, columns `names` get a leading `_`."""
    step = F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps])
    there = F.zip_with("cell", "_step", lambda a, b: (a + b).cast("int")).alias("cell")
    return rows.withColumn("_step", F.explode(step)).select(F.col("cell").alias("_from"), *[F.col(n).alias(f"_{n}") for n in names], there)


def _strip_pairs(tiles: DataFrame, steps: list[list[int]]) -> DataFrame:
    """Tile rows of every pair of strips in reach, so that the tiles of one cell are dealt over many keys."""
    held = tiles.withColumn("strip", F.floor(F.col("tile") / F.lit(STRIP)).cast("int"))
    strips = materialize(held.select("cell", "strip").distinct(), "strips")
    near = _reached(strips, steps, "strip").join(strips, "cell").where((F.col("_from") != F.col("cell")) | (F.col("_strip") <= F.col("strip")))
    near = materialize(near.select(F.struct("_from", "_strip", "cell", "strip").alias("at")), "strip-pairs")
    own = [F.col(n).alias(f"_{n}") for n in ("tile", "ids", "words")]
    left = held.select(F.col("cell").alias("_from"), F.col("strip").alias("_strip"), *own)
    left = left.join(near.select("at", "at._from", "at._strip"), ["_from", "_strip"]).drop("_strip")
    right = held.join(near.select("at", "at.cell", "at.strip"), ["cell", "strip"]).drop("strip")
    return left.join(right, "at")


def _forest(left: np.ndarray, right: np.ndarray, sieve: int, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of a tile pair as a forest (child, parent) over its rows; right rows are numbered after left ones."""
    shift = 0 if same else len(left)
    label = np.arange(shift + len(right))
    first, other = np.ascontiguousarray(left[:, 0]), np.ascontiguousarray(right[:, 0])
    step = max(1, AT_ONCE // max(1, len(right)))
    words, counts = np.empty(step * len(right), np.uint64), np.empty(step * len(right), np.uint8)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for low in range(0, len(left), step):
        start = low if same else 0
        shape = len(first[low : low + step]), len(right) - start
        cells = shape[0] * shape[1]
        differ = np.bitwise_xor(first[low : low + step, None], other[None, start:], out=words[:cells].reshape(shape))
        near = np.flatnonzero(np.bitwise_count(differ.ravel(), out=counts[:cells]) <= sieve)
        i, j = np.divmod(near, max(1, shape[1]))
        i, j = i + low, j + start
        if left.shape[1] > 1:
            kept = np.bitwise_count(left[i] ^ right[j]).sum(axis=1) <= radius
            i, j = i[kept], j[kept]
        a, b = label[i], label[j + shift]
        links.append((a[a != b], b[a != b]))
        if low + step >= len(left) or sum(len(x) for x, _ in links) >= LINKS:
            label = _joined(label, *map(np.concatenate, zip(*links)))
            links = []
    child = np.flatnonzero(label != np.arange(len(label)))
    return child, label[child]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`label` with the trees of every a and b made one, the least label its root; trees are one level high."""
    a, b = label[a], label[b]
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return label[label]


def linked(distinct: DataFrame, radius: int, width: int = 1, sieve: int | None = None, similarity: float | None = None) -> DataFrame:
    """(u, v): edges that join the ids of `distinct` (id, fp) within `radius` bits, none beyond.

    With several words, pairs must also agree in the first word up to `sieve` bits. With a `similarity`, pairs
    whose `size` rules it out are left out.
    """
    sieve = radius if sieve is None else sieve
    parts, tile = (4, TILE) if sieve <= QUARTERED and similarity is None else (1, WIDE_TILE)
    cell, steps = (_quarters(parts), _steps(sieve, parts)) if similarity is None else (_size_cell(similarity), _steps(SIZE_STEPS, 1))
    tiles = materialize(_tiles(distinct, cell, tile), "tiles")
    pairs = _reached(tiles, steps, "tile", "ids", "words").join(tiles, "cell") if parts > 1 else _strip_pairs(tiles, steps)
    pairs = pairs.where((F.col("_from") != F.col("cell")) | (F.col("_tile") <= F.col("tile")))
    same = (F.col("_from") == F.col("cell")) & (F.col("_tile") == F.col("tile"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row in range(batch.num_rows):
                a, x, b, y = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in range(4))
                one = batch.column(4)[row].as_py()
                x, y = (w.view(np.uint64).reshape(-1, width) for w in (x, y))
                child, parent = _forest(x, y, sieve, radius, one)
                ids = a if one else np.concatenate([a, b])
                u.append(ids[child])
                v.append(ids[parent])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(w)) for w in (u, v)], ["u", "v"])

    return pairs.select("_ids", "_words", "ids", "words", same.alias("same")).mapInArrow(run, "u bigint, v bigint")


def _similar(sets: list[np.ndarray], split: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of Jaccard similarity `similarity` or more as a forest (child, parent) over all sets.

    The first `split` sets are compared with the others; all with all if `split` is their number.
    """
    label, sizes = np.arange(len(sets)), np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    mark = np.zeros(int(codes.max(initial=0)) + 1, bool)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i in range(split):
        low = i + 1 if split == len(sets) else split
        open_ = (label[low:] != label[i]) & (np.minimum(sizes[low:], sizes[i]) >= similarity * np.maximum(sizes[low:], sizes[i]) - 1)
        if not open_.any():
            continue
        own = codes[ends[i] - sizes[i] : ends[i]]
        mark[own] = True
        start = ends[low] - sizes[low]
        both = np.bincount(owner[start:][mark[codes[start:]]], minlength=len(sets))[low:]
        mark[own] = False
        union = sizes[low:] + sizes[i] - both
        near = low + np.flatnonzero(open_ & (both / np.maximum(union, 1) >= similarity))
        if len(near):
            joined = np.unique(label[np.append(near, i)])
            label[np.isin(label, joined)] = joined[0]
    child = np.flatnonzero(label != np.arange(len(label)))
    return child, label[child]


def verified(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): edges that join the ids of `sets` (id, shingles) of Jaccard similarity `similarity` or more.

    All pairs inside a group of `groups` (id, root) are compared, block by block.
    """
    members = materialize(groups.join(sets, "id").select("root", "id", "shingles"), "members")
    needed = F.greatest(F.ceil(F.sum(F.size("shingles")) / F.lit(BLOCK)), F.ceil(F.count("*") / F.lit(BLOCK_TEXTS)))
    # Stored, so that the join can be split at a large group; the groups of the next step are those of blocks, not of roots.
    sizes = materialize(members.groupBy("root").agg(needed.cast("int").alias("blocks")), "sizes")
    place = F.struct("root", "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
    blocks = members.join(sizes, "root").groupBy(place.alias("at")).agg(F.collect_list(F.struct("id", "shingles")).alias("rows")).select("at.*", "rows")
    sides = F.col("rows.id").alias("ids"), F.transform("rows", lambda x: F.size(x["shingles"])).alias("sizes"), F.flatten("rows.shingles").alias("shingles")
    blocks = materialize(blocks.select("root", "blocks", "block", *sides), "blocks")
    # Groups of one block need no join.
    nothing = [F.array().cast("array<bigint>").alias("ids2"), F.array().cast("array<int>").alias("sizes2"), F.array().cast("array<bigint>").alias("shingles2")]
    single = blocks.select("ids", "sizes", "shingles", *nothing)
    several = blocks.where(F.col("blocks") > 1)
    left = several.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).where(F.col("other") > F.col("block"))
    right = several.select("root", F.col("block").alias("other"), F.col("ids").alias("ids2"), F.col("sizes").alias("sizes2"), F.col("shingles").alias("shingles2"))
    pairs = left.join(right, ["root", "other"]).select("ids", "sizes", "shingles", "ids2", "sizes2", "shingles2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row in range(batch.num_rows):
                a, n, x, b, m, y = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in range(6))
                split = [*np.split(x, np.cumsum(n)[:-1]), *(np.split(y, np.cumsum(m)[:-1]) if len(b) else [])]
                child, parent = _similar(split, len(a), similarity)
                ids = np.concatenate([a, b])
                u.append(ids[child])
                v.append(ids[parent])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(w)) for w in (u, v)], ["u", "v"])

    return single.unionByName(pairs).mapInArrow(run, "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    similarity: float = 0.8,
    width: int = 4,
    radius: int | None = None,
    key: str = "doc_id",
    text: str = "text",
    repeats: bool = False,
) -> DataFrame:
    """(key, fingerprint, component_id) of every document.

    With a `radius`, documents are linked if their fingerprints of `width` 64-bit words differ in at most
    `radius` bits. Without one, those of Jaccard similarity `similarity` or more over distinct shingles are linked,
    as far as their fingerprints are near enough to make them candidates and the sizes of their sets allow it; none
    below is. component_id is the smallest
    key that links reach, the document's own included. Null and blank texts have fingerprint zero and are linked like any
    other. Fewer words than a shingle make one shingle of all. Null keys get the component of their
    fingerprint, null if nothing in it has a key. Repeated rows stay repeated; an empty table gives an empty
    one; other columns are not read. Classes of wide fingerprints are named by a 64-bit hash.
    """
    exact = radius is None
    sieve = radius_of(similarity, 64, SLACK) if exact else radius
    radius = radius_of(similarity, 64 * width, SLACK) if exact else radius
    at, owned = F.xxhash64(key, text), docs
    if exact:
        owned = docs.select(F.struct(F.col(key).alias("key"), at.alias("at")).alias("owner"), text)
    signed = materialize(fingerprints(owned, words, width, "owner" if exact else key, text, repeats), "fingerprints")
    if exact and repeats:
        signed = signed.withColumn("size", F.lit(None).cast("int"))
    name = F.col("fp")[0] if width == 1 else F.xxhash64("fp")
    signed = signed.withColumn("id", name)
    kept = [F.first("fp").alias("fp"), F.min("owner.key" if exact else key).alias("least")]
    if exact:
        # The size of the text whose shingles are compared.
        kept += [F.min("owner.at").alias("at"), F.min_by("size", "owner.at").alias("size")]
    classes = materialize(signed.groupBy("id").agg(*kept), "classes")
    signed = signed.select(F.col("owner.key" if exact else key).alias(key), "fp", "id")
    roots = components(linked(classes, radius, width, sieve, similarity if exact else None), "u", "v")
    if exact:
        roots = materialize(roots, "candidates")
        groups = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "id")
        wanted = classes.join(groups, "id").select("id", "at")
        texts = docs.select(at.alias("at"), text).join(wanted, "at").groupBy("id").agg(F.first(text).alias(text))
        roots = components(verified(groups, shingle_sets(texts, words, "id", text), similarity), "u", "v")
    rooted = classes.join(roots, classes["id"] == roots["node"], "left").select(
        "id", "least", F.coalesce("root", "id").alias("root")
    )
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    found = rooted.join(least, "root").select("id", "component_id")
    digits = F.transform("fp", lambda x: F.lower(F.lpad(F.hex(x), 16, "0")))
    return signed.join(found, "id").select(key, F.array_join(digits, "").alias("fingerprint"), "component_id")
