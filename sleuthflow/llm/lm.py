"""Bigram scoring by deleted interpolation.

P(w | v) = a(v) c(v w) / c(v) + b(v) c(w) / N + u(v) / (V + 1): maximum-likelihood estimates of the bigram and the
word, and a uniform share, in which all unknown words count as one. The weights depend on the bucket of the
context's frequency c(v) (powers of two) and are learned by expectation-maximisation: one fold of the training
documents is deleted from the counts and serves as held-out text. The final counts take in all of them.

Texts are read once. A task turns documents into blocks: token numbers over the block's own word list. Each
distinct word and bigram of a block then asks once for its count: sorted 64-bit keys (packed, with the block's
own counts) go to key ranges, a range adds up what all blocks say of a key and answers in the same order. Hot
words thus send one key per block, ranges are even by hashing, and no table of counts is broadcast or collected.
Two words, or two bigrams, with the same 64-bit key would share their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sleuthflow.llm.common import fold, slices, texts_as_bytes
from sleuthflow.session import materialize

HELD_OUT, DELETED = 1, 0
BLOCK_TOKENS = 1_200_000
RANGE_TOKENS = 1_000_000
END = xxhash.xxh64_intdigest(b"\n", seed=42)  # no word holds white space
#: Histogram cells of held-out tokens: eighths of a power of two; beyond FAR there is no estimate.
CELLS, FAR = 8, 10_000
ROUNDS = 60
BUCKETS = 64


def _pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, count: int, kind: type) -> np.ndarray:
    if not count:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = pa.decompress(data, decompressed_size=count * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, count).T).view(kind).ravel()


def _mix(high: np.ndarray | np.uint64, low: np.ndarray) -> np.ndarray:
    """Even 64-bit keys of pairs."""
    x = high * np.uint64(0x9E3779B97F4A7C15) + low
    for factor in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        x ^= x >> np.uint64(32)
        x = x * np.uint64(factor)
    return (x ^ (x >> np.uint64(29))) & ~np.uint64(1)


def _hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    out[-1] = END
    return out


class _Block:
    """Documents of one kind, gathered up to BLOCK_TOKENS."""

    def __init__(self) -> None:
        self.keys, self.tokens, self.count = [], [], 0

    def add(self, key: object, tokens: np.ndarray) -> bool:
        self.keys.append(key)
        self.tokens.append(tokens)
        self.count += len(tokens)
        return self.count >= BLOCK_TOKENS

    def row(self, name: str, kind: int, key_type: pa.DataType) -> pa.RecordBatch:
        lengths = [len(t) for t in self.tokens]
        words, at, counts = np.unique(np.concatenate(self.tokens), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        number = np.empty(len(words), np.uint32)
        number[order] = np.arange(len(words), dtype=np.uint32)
        columns = {
            "block": pa.array([name]),
            "kind": pa.array([kind], pa.int32()),
            "keys": pa.array([self.keys], pa.list_(key_type)),
            "lengths": pa.array([lengths], pa.list_(pa.int32())),
            "n_tokens": pa.array([self.count], pa.int64()),
            "n_words": pa.array([len(words)], pa.int64()),
            "tokens": pa.array([_pack(number[at])], pa.binary()),
            "words": pa.array([words[order].tobytes()], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of tokenised documents; kind is the training fold: 0 deleted, 1 held out, 2 the others."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), fold(key).alias("fold"), F.expr("uuid()").alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, _Block] = {}
        name, key_type = None, None
        for batch in batches:
            key_type = batch.schema.field("key").type
            for part in slices(batch, "text"):
                names = part.column("name")
                for n, (k, t, f) in enumerate(zip(part.column("key").to_pylist(), texts_as_bytes(part, "text"), part.column("fold").to_pylist())):
                    kind = min(f, 2)
                    name = names[n].as_py()
                    if open_blocks.setdefault(kind, _Block()).add(k, _hashes(t)):
                        yield open_blocks.pop(kind).row(f"{name}-{kind}", kind, key_type)
        for kind, block in open_blocks.items():
            yield block.row(f"{name}-{kind}", kind, key_type)

    kind = rows.schema["key"].dataType.simpleString()
    schema = (
        f"block string, kind int, keys array<{kind}>, lengths array<int>, n_tokens bigint, n_words bigint,"
        " tokens binary, words binary"
    )
    return rows.mapInArrow(run, schema)


class _Opened:
    """A block's words, bigrams and their sorted keys."""

    def __init__(self, row: dict) -> None:
        self.words = np.frombuffer(row["words"], np.uint64)
        self.word = _unpack(row["tokens"], row["n_tokens"], np.uint32).astype(np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        starts = self.lengths.cumsum() - self.lengths
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[starts] = np.flatnonzero(self.words == END)[0]
        self.pairs, self.pair, self.pair_counts = np.unique(
            before * len(self.words) + self.word, return_inverse=True, return_counts=True
        )
        self.context, self.follower = np.divmod(self.pairs, len(self.words))
        one = _mix(np.uint64(1), self.words) | np.uint64(1)
        two = _mix(self.words[self.context], self.words[self.follower])
        keys = np.concatenate([one, two])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counts(self) -> np.ndarray:
        both = np.concatenate([np.bincount(self.word, minlength=len(self.words)), self.pair_counts])
        return both[self.order].astype(np.uint32)

    def split(self, answer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Answers in key order -> counts by word and by bigram."""
        out = np.empty(len(answer), np.int64)
        out[self.order] = answer
        return out[: len(self.words)], out[len(self.words) :]


def _questions(stored: DataFrame, ranges: int) -> DataFrame:
    width = min((1 << 64) // ranges + 1, (1 << 64) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for one in range(batch.num_rows) for r in batch.slice(one, 1).to_pylist()):
                opened = _Opened(row)
                counts = opened.counts() if row["kind"] != HELD_OUT else np.zeros(len(opened.keys), np.uint32)
                part = np.minimum(opened.keys // np.uint64(width), np.uint64(ranges - 1)).astype(np.int64)
                edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                out = []
                for low, high in zip(edges, edges[1:]):
                    keys = opened.keys[low:high]
                    steps = np.diff(keys, prepend=np.uint64(0))
                    out.append((int(part[low]), row["block"], row["kind"], high - low, _pack(steps), _pack(counts[low:high])))
                names = ["range", "block", "kind", "n", "keys", "counts"]
                types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    schema = "range bigint, block string, kind int, n bigint, keys binary, counts binary"
    return stored.select("block", "kind", "lengths", "n_tokens", "tokens", "words").mapInArrow(run, schema)


def _answer(table: pa.Table) -> pa.Table:
    """All questions of a range: the counts of every key over all blocks, and how many words it has."""
    rows = table.to_pylist()
    keys = np.concatenate([np.cumsum(_unpack(r["keys"], r["n"], np.uint64), dtype=np.uint64) for r in rows])
    names, at = np.unique(keys, return_inverse=True)
    said = np.concatenate([_unpack(r["counts"], r["n"], np.uint32) for r in rows]).astype(np.float64)
    deleted = np.concatenate([np.full(r["n"], r["kind"] == DELETED) for r in rows])
    every = np.bincount(at, said, len(names))
    kept = every - np.bincount(at[deleted], said[deleted], len(names))
    every, kept = every.astype(np.uint32), kept.astype(np.uint32)
    types = int(((names & np.uint64(1)).astype(bool) & (every > 0)).sum())
    out, low = [(None, rows[0]["range"], types, None, None)], 0
    for r in rows:
        mine = at[low : low + r["n"]]
        out.append((r["block"], r["range"], r["n"], _pack(every[mine]), _pack(kept[mine]) if r["kind"] == DELETED else None))
        low += r["n"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["block", "range", "n", "every", "kept"])


def _answered(left: pa.Table, right: pa.Table, which: str) -> tuple[dict, _Opened, np.ndarray, np.ndarray]:
    row = left.to_pylist()[0]
    opened = _Opened(row)
    parts = sorted(right.to_pylist(), key=lambda r: r["range"])
    return row, opened, *opened.split(np.concatenate([_unpack(r[which], r["n"], np.uint32) for r in parts]))


def _bucket(counts: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + the power of two below the count."""
    return np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1))), 0).astype(np.int64)


def _cell(counts: np.ndarray, total: np.ndarray | float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        cell = np.round(-CELLS * np.log2(counts / total))
    return np.where(counts > 0, cell, FAR).astype(np.int64)


def _histogram(kept_tokens: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Held-out tokens of a block by context bucket and cells of both estimates without this fold."""
        empty = [pa.array([], pa.int64())] * 4
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays(empty, ["bucket", "two", "one", "n"])
        _, opened, one, two = _answered(left, right, "kept")
        bucket = _bucket(one[opened.context])
        cells = np.stack([bucket, _cell(two, one[opened.context]), _cell(one[opened.follower], max(1, kept_tokens))])
        rows, at = np.unique(cells, axis=1, return_inverse=True)
        n = np.bincount(at.ravel(), opened.pair_counts, rows.shape[1]).astype(np.int64)
        return pa.Table.from_arrays([*map(pa.array, rows), pa.array(n)], ["bucket", "two", "one", "n"])

    return run


def learned_weights(cells: np.ndarray, types: int) -> np.ndarray:
    """Weights (bigram, word, uniform) of every bucket, from rows (bucket, two, one, n), by EM.

    Each weight gets one pseudo-count, so that none vanishes where it can be needed. A bucket without held-out
    tokens takes the weights of all together; unseen contexts have no bigram share.
    """
    estimate = np.where(cells[:, 1:3] < FAR, np.exp2(-cells[:, 1:3] / CELLS), 0.0)
    estimate = np.column_stack([estimate, np.full(len(cells), 1.0 / (types + 1))])

    def fit(rows: np.ndarray, used: np.ndarray) -> np.ndarray:
        weights = used / used.sum()
        for _ in range(ROUNDS):
            share = estimate[rows] * weights
            share *= (cells[rows, 3] / share.sum(axis=1))[:, None]
            weights = used * (share.sum(axis=0) + 1)
            weights /= weights.sum()
        return weights

    out = np.empty((BUCKETS, 3))
    everything = fit(np.arange(len(cells)), np.ones(3))
    for bucket in range(BUCKETS):
        used = np.array([bucket > 0, 1, 1], float)
        rows = np.flatnonzero(cells[:, 0] == bucket)
        out[bucket] = fit(rows, used) if len(rows) else everything * used / (everything * used).sum()
    return out


def _scorer(tokens: int, types: int, weights: np.ndarray, key_type: pa.DataType):
    names = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [key_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        row, opened, one, two = _answered(left, right, "every")
        base = np.log10((one + 0.5) / (tokens + 0.5 * (types + 1)))
        context = one[opened.context]
        share = weights[_bucket(context)]
        bigram = two / np.maximum(context, 1)
        unigram = one[opened.follower] / max(1, tokens)
        model = np.log10(share[:, 0] * bigram + share[:, 1] * unigram + share[:, 2] / (types + 1))
        owner = np.repeat(np.arange(len(opened.lengths)), opened.lengths)
        size = len(opened.lengths)
        columns = [
            row["keys"],
            [row["kind"] == HELD_OUT] * size,
            opened.lengths,
            np.bincount(owner, one[opened.word] > 0, size).astype(np.int64),
            [tokens] * size,
            np.bincount(owner, base[opened.word], size),
            np.bincount(owner, model[opened.pair], size),
        ]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs`.

    Tokens are the words of the whole text, A-Z in lower case, and one end; a null or empty text is the end
    alone. Rows of fold 1 of the key's crc32 are held out, the others train (a null key counts as `null`).
    Scores are log10 probabilities; without training rows every token has probability 1. Repeated rows count
    and are scored each; other columns are not read; an empty table gives an empty one. One text is held by
    one task, in memory in proportion to its length.
    """
    stored = materialize(blocks(docs, key, text), "blocks")
    sums = {r["kind"]: r["n"] for r in stored.groupBy("kind").agg(F.sum("n_tokens").alias("n")).collect()}
    total = sum(sums.values())
    kept_tokens = sums.get(2, 0)
    tokens = kept_tokens + sums.get(DELETED, 0)
    ranges = max(1, -(-total // RANGE_TOKENS))
    questions = _questions(stored, ranges)
    answers = materialize(
        questions.groupBy("range").applyInArrow(_answer, "block string, range bigint, n bigint, every binary, kept binary"),
        "answers",
    )
    types = answers.where(F.col("block").isNull()).agg(F.sum("n")).first()[0] or 0
    answers = answers.where(F.col("block").isNotNull())
    deleted = stored.where(F.col("kind") == DELETED).groupBy("block")
    asked = answers.where(F.col("kept").isNotNull()).select("block", "range", "n", "kept").groupBy("block")
    held = deleted.cogroup(asked).applyInArrow(_histogram(kept_tokens), "bucket bigint, two bigint, one bigint, n bigint")
    cells = held.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).orderBy("bucket", "two", "one").collect()
    weights = learned_weights(np.array(cells, np.int64).reshape(-1, 4), types)
    if not tokens:
        weights = np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    kind = docs.schema[key].dataType
    found = stored.groupBy("block").cogroup(answers.select("block", "range", "n", "every").groupBy("block")).applyInArrow(
        _scorer(tokens, types, weights, _arrow(kind)),
        f"key {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint,"
        " base_score double, score double",
    )
    return found.withColumnRenamed("key", key)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
