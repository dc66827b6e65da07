"""Alignment of the tokens of two public tokenizers, and how strongly their tokens go together in a corpus.

Both tokenizers encode whole texts. Where a token of each ends at the same byte and both next tokens are marked
as starting with a space, a text is cut: words mostly repeat, so that a window between two such anchors, named by
its two tuples of ids, is aligned once and looked up after that. The anchors are verified ends, so windows never
change the result: inside a window, the byte offsets where tokens of both end cut it into groups.

Documents are counted per pair of linked ids in blocks of about 16 MB of text. A block names each of its distinct
pairs once, asks for the corpus-wide count of that pair by an ordinary join, and gets the answers back to its own
documents. What is shuffled are the distinct pairs of blocks, never pairs of occurrences; a pair that every block
holds comes to one row a block. The answers of a block are sorted ahead of its documents, which then stream past
them in bounded batches: no worker holds the documents of a block at once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from sleuthflow.llm.bpe import byte_units
from sleuthflow.llm.common import slices
from sleuthflow.session import materialize

#: Text bytes that are aligned at once.
SLICE_BYTES = 1_000_000
#: Text bytes of the documents that ask for their counts together.
BLOCK_BYTES = 16_000_000
#: Ids in the windows that are kept between slices, and links of a group that are listed one by one.
CACHED_IDS, LARGE = 2_000_000, 4096
SPACE, PIECE_SPACE = b" ", "▁"
#: How slots and times are packed.
SLOT, TIMES = "<i4", "<i8"
#: The split pattern of byte-level tokenizers that use their built-in one (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_level(source: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """Encoder and token bytes of a byte-level BPE in the JSON format of the tokenizers library.

    The entries are handed as ranks to the faster library; that holds only if ids rise with the merges, which
    is checked, and equal results of both libraries are tested. Special tokens are left out: plain text.
    """
    spec = json.loads(source)
    octet = {u: b for b, u in enumerate(byte_units())}
    vocab = spec["model"]["vocab"]
    tokens = [b""] * (max(vocab.values()) + 1)
    for entry, number in vocab.items():
        tokens[number] = bytes(octet[c] for c in entry)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    merged = [vocab["".join(m)] for m in pairs]
    split = spec["pre_tokenizer"] or {}
    if merged != sorted(merged) or split.get("type") != "ByteLevel" or not split.get("use_regex") or spec["normalizer"]:
        raise ValueError("not a byte-level vocabulary whose ids follow its merges")
    special = {t["id"] for t in spec["added_tokens"]}
    ranks = {t: n for n, t in enumerate(tokens) if t and n not in special}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), tokens


def pieces(model: bytes) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """Encoder and token bytes of a piece vocabulary with byte fallback."""
    held = sentencepiece.SentencePieceProcessor(model_proto=model)
    tokens = []
    for n in range(held.get_piece_size()):
        piece = held.id_to_piece(n)
        tokens.append(bytes([int(piece[3:5], 16)]) if held.is_byte(n) else piece.replace(PIECE_SPACE, " ").encode())
    return held, tokens


class Slice:
    """Aligned documents: numbers a document, and (document, pair, times) of their distinct linked pairs.

    `codes` are tokens in the order of the groups, with the separator that follows; `ends` those of the documents.
    """

    def __init__(self, n: int) -> None:
        self.n_a, self.n_b, self.n_groups, self.n_links, self.ends = (np.zeros(n, np.int64) for _ in range(5))
        self.doc, self.pair, self.times, self.codes = (np.zeros(0, np.int64) for _ in range(4))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after another."""
    return np.repeat(starts - (sizes.cumsum() - sizes), sizes) + np.arange(sizes.sum())


class Rows:
    """Growing list of arrays of different length, held as one."""

    def __init__(self, *kinds: type) -> None:
        self.columns = [np.zeros(0, kind) for kind in kinds]
        self.starts = self.sizes = np.zeros(0, np.int64)

    def add(self, sizes: np.ndarray, *columns: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.columns[0]) + sizes.cumsum() - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.columns = [np.concatenate(both) for both in zip(self.columns, columns)]


class Aligner:
    """Both encoders, and the aligned windows by their ids."""

    def __init__(self, first: str, second: bytes) -> None:
        self.a, self.a_tokens = byte_level(first)
        self.b, self.b_tokens = pieces(second)
        self.a_size, self.b_size = (np.array([len(t) for t in ts], np.int64) for ts in (self.a_tokens, self.b_tokens))
        self.a_bytes, self.b_bytes = (pa.array(ts, pa.large_binary()) for ts in (self.a_tokens, self.b_tokens))
        self.a_spaced, self.b_spaced = (np.array([t.startswith(SPACE) for t in ts]) for ts in (self.a_tokens, self.b_tokens))
        n, m = len(self.a_tokens), len(self.b_tokens)
        # Code of a token: its id, those of the second vocabulary behind the first, and again for a last one of a group.
        self.shift, self.last, self.second = n, n + m, m
        rendered = [f"{k}," for k in range(n)] + [f"{k}," for k in range(m)] + [f"{k}|" for k in range(n)] + [f"{k};" for k in range(m)]
        self.rendered = pa.array(rendered, pa.large_string())
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        # Pairs are kept as first id * size of the second vocabulary + second id.
        self.codes, self.pairs = Rows(np.int32), Rows(np.int64, np.int64)
        self.groups = self.links = np.zeros(0, np.int64)

    def _spelled(self, ids: list[np.ndarray], whole: list[bytes], sizes: np.ndarray, tokens: pa.Array) -> list[bool]:
        """Whether the tokens of every document spell its bytes."""
        if not ids:
            return []
        flat = np.concatenate(ids)
        data = tokens.take(pa.array(flat)).buffers()[2]
        spelled = data.to_pybytes() if data else b""
        ends = np.append(0, sizes[flat].cumsum())[np.cumsum([0, *map(len, ids)])].tolist()
        return [spelled[i:j] == w for i, j, w in zip(ends, ends[1:], whole)]

    def _tokens(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Documents whose tokens of both spell a space and the text, with the ids of both."""
        docs = [n for n, t in enumerate(texts) if t]
        whole = [b" " + texts[n].encode() for n in docs]
        a = [np.array(self.a.encode_ordinary(" " + texts[n]), np.int32) for n in docs]
        b = [np.array(self.b.encode(texts[n]), np.int32) for n in docs]
        both = zip(self._spelled(a, whole, self.a_size, self.a_bytes), self._spelled(b, whole, self.b_size, self.b_bytes))
        kept = [k for k, held in enumerate(both) if all(held)]
        return np.array([docs[k] for k in kept], np.int64), [a[k] for k in kept], [b[k] for k in kept]

    def _learn(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, window: np.ndarray, count: int) -> None:
        """Aligns `count` new windows: tokens with their numbered groups, and the window of every group."""
        n = len(window)
        left, right = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        b_start = right.cumsum() - right
        # In the order of groups, the tokens of the second follow those of the first.
        a_last, b_last = np.append(a_group[1:] != a_group[:-1], True), np.append(b_group[1:] != b_group[:-1], True)
        codes = np.zeros(len(a) + len(b), np.int32)
        codes[np.arange(len(a)) + b_start[a_group]] = a + self.last * a_last
        codes[np.arange(len(b)) + left.cumsum()[b_group]] = b + self.shift + self.last * b_last
        self.codes.add(np.bincount(window, weights=left + right, minlength=count).astype(np.int64), codes)
        self.groups = np.concatenate([self.groups, np.bincount(window, minlength=count)])
        links = np.zeros(count, np.int64)
        np.add.at(links, window, left * right)
        self.links = np.concatenate([self.links, links])
        # Links one by one; a large group by its distinct ids.
        small = left * right <= LARGE
        i = np.flatnonzero(small[a_group])
        often = right[a_group[i]]
        first = a.astype(np.int64) * self.second
        pair = np.repeat(first[i], often) + b[_ranges(b_start[a_group[i]], often)]
        owner, times = np.repeat(window[a_group[i]], often), np.ones(len(pair), np.int64)
        for g in np.flatnonzero(~small).tolist():
            x, p = np.unique(first[a_group == g], return_counts=True)
            y, q = np.unique(b[b_group == g], return_counts=True)
            pair = np.concatenate([pair, (x[:, None] + y[None]).ravel()])
            times = np.concatenate([times, np.outer(p, q).ravel()])
            owner = np.concatenate([owner, np.full(len(x) * len(y), window[g])])
        held, pair, times = _summed(owner, pair, times, self.shift * self.second)
        self.pairs.add(np.bincount(held, minlength=count), pair, times)

    def align(self, texts: list[str | None]) -> Slice:
        out = Slice(len(texts))
        docs, *ids = self._tokens(texts)
        if not len(docs):
            return out
        a_count, b_count = (np.array([len(t) for t in ts]) for ts in ids)
        out.n_a[docs], out.n_b[docs] = a_count, b_count
        a, b = (np.concatenate(ts) for ts in ids)
        # Anchors: ends that both share, before tokens that both start with a space; the end of a document is one.
        a_ends, b_ends = self.a_size[a].cumsum(), self.b_size[b].cumsum()
        at = np.searchsorted(b_ends, a_ends)
        shared = np.flatnonzero(b_ends[np.minimum(at, len(b) - 1)] == a_ends)
        at = at[shared]
        spaced = np.append(self.a_spaced[a], True)[shared + 1] & np.append(self.b_spaced[b], True)[at + 1]
        last = np.zeros(len(a), bool)
        last[a_count.cumsum() - 1] = True
        last = last[shared]
        anchor = spaced | last
        a_cuts, b_cuts = np.append(0, shared[anchor] + 1), np.append(0, at[anchor] + 1)
        doc = np.append(0, last[anchor].cumsum()[:-1])
        # The ids of a window, first those of one vocabulary, then of the other, are its name.
        named = np.zeros(len(a) + len(b), np.int32)
        a_window, b_window = np.repeat(np.arange(len(doc)), np.diff(a_cuts)), np.repeat(np.arange(len(doc)), np.diff(b_cuts))
        named[np.arange(len(a)) + b_cuts[a_window]] = a
        named[np.arange(len(b)) + a_cuts[b_window + 1]] = b + self.shift
        names, cuts = named.tobytes(), ((a_cuts + b_cuts) * 4).tolist()
        keys = [names[i:j] for i, j in zip(cuts, cuts[1:])]
        numbers = list(map(self.memo.get, keys))
        missing = [n for n, known in enumerate(numbers) if known is None]
        if missing:
            new, memo = [], self.memo
            for n in missing:
                if keys[n] not in memo:
                    memo[keys[n]] = len(memo)
                    new.append(n)
                numbers[n] = memo[keys[n]]
            new = np.array(new)
            i = _ranges(a_cuts[new], np.diff(a_cuts)[new])
            j = _ranges(b_cuts[new], np.diff(b_cuts)[new])
            group, a_group = np.unique(np.searchsorted(shared, i), return_inverse=True)
            b_group = np.searchsorted(group, np.searchsorted(at, j))
            window = np.searchsorted(new, (anchor.cumsum() - anchor)[group])
            self._learn(a[i], b[j], a_group, b_group, window, len(new))
        window = np.array(numbers)
        np.add.at(out.n_groups, docs[doc], self.groups[window])
        np.add.at(out.n_links, docs[doc], self.links[window])
        out.codes = self.codes.columns[0][_ranges(self.codes.starts[window], self.codes.sizes[window])]
        out.ends[docs] = a_count + b_count
        out.ends = out.ends.cumsum()
        # Distinct windows of a document first, then their pairs.
        both, often = np.unique(doc * len(self.memo) + window, return_counts=True)
        doc, window = np.divmod(both, len(self.memo))
        many = self.pairs.sizes[window]
        place = _ranges(self.pairs.starts[window], many)
        times = self.pairs.columns[1][place] * np.repeat(often, many)
        owner, pair, out.times = _summed(np.repeat(doc, many), self.pairs.columns[0][place], times, self.shift * self.second)
        out.doc, out.pair = docs[owner], pair // self.second << 32 | pair % self.second
        if len(self.codes.columns[0]) > CACHED_IDS:
            self._clear()
        return out

    def texts(self, found: Slice) -> list[memoryview]:
        """The groups of every document in UTF-8, from the codes of their tokens."""
        rendered = self.rendered.take(pa.array(found.codes))
        _, offsets, data = rendered.buffers()
        at = np.frombuffer(offsets, np.int64)[found.ends] if len(found.codes) else np.zeros(len(found.ends), np.int64)
        whole = memoryview(data) if data else memoryview(b"")
        starts = np.append(0, at[:-1])
        return [whole[i : max(i, j - 1)] for i, j in zip(starts.tolist(), at.tolist())]


def _summed(owner: np.ndarray, pair: np.ndarray, times: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, pair) in order, with their times added up; pairs are below `span`."""
    key = owner * span + pair
    order = key.argsort()
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    return key[starts] // span, key[starts] % span, np.add.reduceat(times[order], starts)


_aligners: dict[int, Aligner] = {}


def _aligner(source) -> Aligner:
    """The aligner of broadcast vocabularies, built once per Python worker."""
    key = hash(source.value)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(*source.value)
    return _aligners[key]


def _forget() -> None:
    """Drops the windows of this Python worker, which are of no use once all is aligned; the vocabularies stay."""
    for aligner in _aligners.values():
        aligner._clear()


class Block:
    """Distinct pairs of the documents of a block, numbered as they come, with the documents that hold them."""

    def __init__(self, number: int) -> None:
        self.number, self.bytes = number, 0
        self.codes, self.slots = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.docs = np.zeros(0, np.int64)

    def add(self, pairs: np.ndarray) -> np.ndarray:
        """Slots of the pairs of distinct (document, pair) entries."""
        distinct, inverse, held = np.unique(pairs, return_inverse=True, return_counts=True)
        new = distinct[~np.isin(distinct, self.codes, assume_unique=True)]
        slots = np.concatenate([self.slots, len(self.codes) + np.arange(len(new), dtype=np.int32)])
        codes = np.concatenate([self.codes, new])
        order = codes.argsort(kind="stable")
        self.codes, self.slots = codes[order], slots[order]
        self.docs = np.concatenate([self.docs, np.zeros(len(new), np.int64)])
        found = self.slots[np.searchsorted(self.codes, distinct)]
        self.docs[found] += held
        return found[inverse]


def _packed(values: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """The values of each of n documents as bytes; `doc` rises."""
    offsets = np.searchsorted(doc, np.arange(n + 1)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of packed cells, and where those of each cell begin and the last end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data, size = column.buffers()[2], np.dtype(kind).itemsize
    values = np.frombuffer(data, kind, (offsets[-1] - offsets[0]) // size, offsets[0]) if data and offsets[-1] > offsets[0] else np.zeros(0, kind)
    return values, (offsets - offsets[0]) // size


def _counted(docs: DataFrame, source, key: str, text: str, digest: bool) -> DataFrame:
    """One row per document, and one per block with its distinct pairs by slot (`pairs`, null for documents).

    A document's `slots` begin with those of pairs that it holds more than once; `times` has only theirs. Both are
    packed as little-endian integers, which cost the JVM far less than lists.
    """
    kind = docs.schema[key].dataType
    fields = [T.StructField("key", kind), *[T.StructField(c, T.LongType()) for c in ("block", "n_a", "n_b", "n_groups", "n_links")]]
    fields += [T.StructField("groups", T.StringType()), *[T.StructField(c, T.BinaryType()) for c in ("slots", "times")]]
    fields += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("pairs", "held")]
    names, lists = [f.name for f in fields], pa.list_(pa.int64())

    def summary(block: Block, key_type: pa.DataType) -> pa.RecordBatch:
        by_slot = block.codes[block.slots.argsort()]
        empty = [pa.nulls(1, t) for t in (*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary())]
        columns = [pa.nulls(1, key_type), pa.array([block.number]), *empty, pa.array([by_slot], lists), pa.array([block.docs], lists)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = _aligner(source), TaskContext.get().partitionId() << 32
        block, key_type = None, None
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                block = block or Block(task)
                key_type, n = part.column(0).type, part.num_rows
                found = aligner.align(part.column(1).to_pylist())
                slots = block.add(found.pair)
                groups = [(hashlib.sha256(t).hexdigest() if t else "") if digest else bytes(t).decode() for t in aligner.texts(found)]
                once = found.times == 1
                slots, times = slots[(found.doc * 2 + once).argsort(kind="stable")], found.times[~once]
                packed = _packed(slots.astype(SLOT), found.doc, n), _packed(times.astype(TIMES), found.doc[~once], n)
                columns = [
                    part.column(0), pa.array(np.full(n, block.number)),
                    *[pa.array(c) for c in (found.n_a, found.n_b, found.n_groups, found.n_links)],
                    pa.array(groups, pa.string()),
                    *packed, pa.nulls(n, lists), pa.nulls(n, lists),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
                block.bytes += part.column(1).nbytes
                if block.bytes > BLOCK_BYTES:
                    yield summary(block, key_type)
                    task += 1
                    block = None
        if block:
            yield summary(block, key_type)

    return docs.select(key, text).mapInArrow(run, T.StructType(fields))


def pair_counts(counted: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold a pair linked; best if no pair of its first id has more."""
    summaries = counted.where(F.col("pairs").isNotNull())
    totals = materialize(
        summaries.select(F.explode(F.arrays_zip("pairs", "held")).alias("x"))
        .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("count")),
        "totals",
    )
    first = F.shiftright("pair", 32)
    # One row per id of the first vocabulary, whose size is fixed.
    most = totals.groupBy(first.alias("_first")).agg(F.max("count").alias("_most"))
    return totals.join(F.broadcast(most), first == F.col("_first")).select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))


class Answers:
    """Counts of the pairs of a block by slot, from rows that come by block: answers in order of their slots, then documents."""

    def __init__(self) -> None:
        self.block, self.parts = None, []

    def taken(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        """Takes the answers of rows of one block; returns the documents."""
        if rows["block"][0].as_py() != self.block:
            self.block, self.parts = rows["block"][0].as_py(), []
        n = rows.num_rows - rows["slot"].null_count
        if n:
            self.parts.append([rows[c].slice(0, n).to_numpy(zero_copy_only=False) for c in ("count", "best")])
        return rows.slice(n)

    def sums(self, docs: pa.RecordBatch) -> list[np.ndarray]:
        """Links of every document whose count is the highest of their first id, and the counts of all."""
        if len(self.parts) > 1:
            self.parts = [[np.concatenate(columns) for columns in zip(*self.parts)]]
        (slots, offsets), (times, repeated) = _unpacked(docs["slots"], SLOT), _unpacked(docs["times"], TIMES)
        links = np.ones(len(slots), np.int64)
        links[_ranges(offsets[:-1], np.diff(repeated))] = times
        count, best = self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, bool))
        totals = (np.append(0, (links * by_slot[slots]).cumsum()) for by_slot in (best, count))
        return [t[offsets[1:]] - t[offsets[:-1]] for t in totals]


def align(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document, whole texts.

    `first` is the path of a byte-level BPE in JSON, which encodes a space and the text; `second` that of a piece
    model that puts the space there itself. Special tokens in a text are plain text. Groups are `a1,a2|b1;a3|b2`:
    ids of tokens between byte offsets where tokens of both end; with `digest` their SHA-256 in lowercase hex is
    returned instead. n_links counts pairs of token occurrences that share a group. The count of a pair of ids is
    the number of documents (rows) that hold it linked; count_sum adds the counts of all links, and n_best counts
    links whose count no other pair of their first id exceeds.

    A text that is null, empty or not spelled by the tokens of both has no tokens: zeros and an empty string.
    Repeated rows stay repeated and count each; null keys stay null; other columns are not read; an empty table
    gives an empty one. One text and its groups are one cell; a text whose tokens never end together holds the
    products of its distinct ids in memory.
    """
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast((Path(first).read_text(encoding="utf-8"), Path(second).read_bytes()))
    counted = materialize(_counted(docs, source, key, text, digest), "aligned")
    known = materialize(pair_counts(counted), "counts")
    asked = counted.where(F.col("pairs").isNotNull()).select("block", F.posexplode("pairs").alias("slot", "pair"))
    members = counted.where(F.col("pairs").isNull()).drop("pairs", "held")
    # Texts and bytes of answers are empty, not null: Arrow's writer goes over a run of nulls again for every row of it.
    kinds = {f.name: f.dataType for f in members.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))}
    empty = {c: F.lit("").cast(k) for c, k in kinds.items()}
    answers = asked.join(known, "pair").select("block", "slot", "count", "best").withColumns(empty)
    rows = members.unionByName(answers, allowMissingColumns=True).repartition("block")
    kind = docs.schema[key].dataType
    fields = [T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]]
    fields.append(T.StructField("groups", T.StringType()))
    names = [f.name for f in fields]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        answers = Answers()
        for batch in batches:
            blocks = batch["block"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                mine = answers.taken(batch.slice(low, high - low))
                if mine.num_rows:
                    kept = [mine[c] for c in ("key", "n_a", "n_b", "n_groups", "n_links")]
                    yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, answers.sums(mine)), mine["groups"]], names)

    return rows.sortWithinPartitions("block", F.asc_nulls_last("slot")).mapInArrow(told, T.StructType(fields))
