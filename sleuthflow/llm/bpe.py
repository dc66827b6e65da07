"""Byte-pair encoding and decoding with the vocabulary file of a public tokenizer.

The file is JSON in the format of the tokenizers library: NFC, white space collapsed, lower case, a split
pattern, byte-level units with an end-of-word suffix, ranked merges, added special tokens. The file is read
on the driver (its size is fixed, a few MB) and broadcast.

Encoding: no split ever crosses white space, so texts are cut there and every distinct piece is encoded once
per slice of rows. Pieces of plain letters, with or without a mark, stay in Arrow's buffers; others are split in
Python and kept in a bounded cache over slices. The distinct words of a slice go through the rank array:
one row per word holds its parts and, beside them, the rank of each pair of neighbours; the row minimum is
found, the boundary there is deleted, and the two ranks next to it are refreshed, until no pair has a rank.
All words of similar length take these steps together. Words above `LONG` bytes, where scanning for the
minimum would cost the square of the length, take the same merges from a heap.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from sleuthflow.llm.common import extended, slices

LONG = 256
CACHED_PIECES = 300_000
CACHED_LENGTH = 48
NO_RANK = np.int32(2**31 - 1)
ROWS_AT_ONCE = 20_000
LATIN_END = "\u0250"
MARKS = ".,;:!?"
#: Pieces of letters that lower to one letter each, the same in every Unicode version, and a mark.
PLAIN = f"^[A-Za-zÀ-ÖØ-öø-ÿ]+[{MARKS}]?$"
#: White space as the split pattern sees it (the Unicode property, without the ASCII separators 1C to 1F).
WIDE_BLANK = r"\x85\xa0  -     　"
BLANK = r"\t\n\x0b\x0c\r " + WIDE_BLANK


def byte_units() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in printable else next(hidden)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        units = byte_units()
        self.inner = np.array([vocab[u] for u in units], np.int32)
        self.final = np.array([vocab[u + suffix] for u in units], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank_of = {k: r for r, k in enumerate(keys.tolist())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k: np.int32(v).tobytes() for k, v in special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.special_start = [s[:2] for s in special]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.blanks = re.compile(f"[{BLANK}]+").split
        self.odd = re.compile(r"[\x1c-\x1f]").search
        wide = re.compile(f"[{WIDE_BLANK}]")
        self.wide, self.wide_blank = wide.search, wide.sub
        tokens = [None] * (max([*vocab.values(), *special.values()]) + 1)
        for token, number in [*vocab.items(), *special.items()]:
            tokens[number] = token
        self.units = {u: b for b, u in enumerate(units)}
        self.library = Tokenizer.from_str(source)
        self.tokens = pa.array(tokens, pa.string())
        self.cache: dict[str, bytes] = dict(self.special)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; a negative part has none."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def _merge_rows(self, parts: np.ndarray, lengths: np.ndarray, starts: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Rank arrays of many words: `parts` has a row per word, padded with -1.

        The ids of a word go to `out` from its start on; their numbers are returned.
        """
        found = np.zeros(len(parts), np.int64)
        rows = np.arange(len(parts))

        def leave(rows: np.ndarray, parts: np.ndarray, lengths: np.ndarray) -> None:
            place = np.arange(parts.shape[1])
            held = place < lengths[:, None]
            out[(starts[rows][:, None] + place)[held]] = parts[held]
            found[rows] = lengths

        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        while len(rows):
            if not ranks.shape[1]:
                leave(rows, parts[:, :1], np.ones(len(rows), np.int64))
                break
            at = ranks.argmin(axis=1)
            best = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            going = best != NO_RANK
            if not going.all():
                done = ~going
                leave(rows[done], parts[done], lengths[done])
                rows, parts, ranks, lengths, at, best = rows[going], parts[going], ranks[going], lengths[going], at[going], best[going]
                if not len(rows):
                    break
            lengths = lengths - 1
            column = np.arange(parts.shape[1] - 1)
            kept = np.take_along_axis(parts, column + (column > at[:, None]), 1)
            every = np.arange(len(rows))
            kept[every, at] = self.merged[best]
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), 1)
            parts = kept
            new = parts[every, at]
            fresh = np.flatnonzero(at < ranks.shape[1])
            if len(fresh):
                ranks[fresh, at[fresh]] = self._ranks(new[fresh], parts[fresh, at[fresh] + 1])
            fresh = np.flatnonzero(at > 0)
            if len(fresh):
                ranks[fresh, at[fresh] - 1] = self._ranks(parts[fresh, at[fresh] - 1], new[fresh])
        return found

    def _merge_long(self, word: bytes) -> bytes:
        """The same merges, least rank and then leftmost first, from a heap over a linked list of parts."""
        parts = self.inner[np.frombuffer(word, np.uint8)].tolist()
        parts[-1] = int(self.final[word[-1]])
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            rank = self.rank_of.get((parts[i] << 32) | parts[j])
            if rank is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else len(parts)
            if j >= len(parts) or parts[j] != right:
                continue
            parts[i], parts[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return np.array([p for p in parts if p >= 0], np.int32).tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word as int32 bytes."""
        found = self._merged(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))
        ends, flat = found.offsets.to_numpy().tolist(), found.values.to_numpy()
        return [flat[low:high].tobytes() for low, high in zip(ends, ends[1:])]

    def _merged(self, data: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
        """Ids of words that stand one behind the other in `data`."""
        starts = lengths.cumsum() - lengths
        out, counts = np.empty(len(data), np.int32), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        ordered = lengths[order]
        low = int((lengths == 0).sum())
        short = int((lengths <= LONG).sum())
        while low < short:
            high = min(low + ROWS_AT_ONCE, short)
            width = int(ordered[low])
            high = min(high, int(np.searchsorted(ordered, max(width + 1, width * 5 // 4), "right")))
            chosen, n = order[low:high], ordered[low:high]
            width = int(n.max())
            flat = data[_ranges(starts[chosen], n)]
            column = np.arange(width)
            parts = np.full((len(chosen), width), -1, np.int32)
            parts[column < n[:, None]] = self.inner[flat]
            parts[np.arange(len(chosen)), n - 1] = self.final[flat[n.cumsum() - 1]]
            counts[chosen] = self._merge_rows(parts, n, starts[chosen], out)
            low = high
        for k in order[short:].tolist():
            ids = np.frombuffer(self._merge_long(data[starts[k] : starts[k] + lengths[k]].tobytes()), np.int32)
            counts[k] = len(ids)
            out[starts[k] : starts[k] + len(ids)] = ids
        return _lists(counts, out[_ranges(starts, counts)])

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces without white space."""
        split = {}
        for p in pieces:
            if p.isalpha() and (p.isascii() or self._latin(p)):
                split[p] = (p.lower(),)
            elif p[:-1].isalpha() and p[-1] in MARKS and (p.isascii() or self._latin(p)):
                split[p] = (p[:-1].lower(), p[-1])
            else:
                split[p] = tuple(self._split(p))
        words = list(set().union(*split.values()))
        ids = dict(zip(words, self.merge([w.encode() for w in words])))
        return {p: b"".join([ids[w] for w in ws]) for p, ws in split.items()}

    @staticmethod
    def _latin(piece: str) -> bool:
        """Letters that lower to one letter each, the same in every Unicode version."""
        return max(piece) < LATIN_END and "\u0130" not in piece

    def _split(self, piece: str) -> list[str]:
        """Words of any piece; letters alone, or letters and one mark, need no pattern.

        Beyond Latin letters the library's own normaliser and splitter decide, as Unicode versions differ.
        """
        if piece.isascii():
            return self.words(piece.lower())
        if self._latin(piece):
            return self.words(unicodedata.normalize("NFC", piece).lower())
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return [bytes([self.units[u] for u in word]).decode() for word, _ in found]

    def _pieces(self, text: str) -> list[str]:
        """The text cut at white space; special tokens stand alone."""
        if not any(s in text for s in self.special_start):
            return self._cut(text)
        out = []
        for part in self.special_split.split(text):
            out += [part] if part in self.special else self._cut(part)
        return out

    def _cut(self, text: str) -> list[str]:
        return self.blanks(text) if self.odd(text) else text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text as int32 bytes; null is an empty text. Equal texts are encoded once."""
        found = dict.fromkeys(texts, b"")
        special = {t for t in found if t and any(s in t for s in self.special_start)}
        plain = [t for t in found if t and t not in special]
        found.update(zip(plain, self._encode_plain(plain)))
        for text in special:
            pieces = self._pieces(text)
            distinct = list(dict.fromkeys(pieces))
            known = dict(zip(distinct, self._known(distinct)))
            found[text] = b"".join([known[p] for p in pieces])
        return [found[t] for t in texts]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Texts without special tokens: Arrow cuts them and numbers the distinct pieces, whose ids are laid out by number.

        A piece is up to two rows of a table of ids: a word of plain letters and its mark, or one row of its own.
        """
        if not texts:
            return []
        blank = [t if t.isascii() or not self.wide(t) else self.wide_blank(" ", t) for t in texts]
        cut = pc.ascii_split_whitespace(pa.array(blank, pa.string()))
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary
        plain = pc.match_substring_regex(pieces, PLAIN)
        some = pieces.filter(plain)
        words = pc.utf8_lower(pc.utf8_rtrim(some, MARKS)).dictionary_encode()
        marks = np.array([MARKS.find(chr(b)) for b in range(256)])[_ends(some)]
        rest = pieces.filter(pc.invert(plain))
        ids = [self._merged(*_flat(words.dictionary)), _list_array([*self.merge([m.encode() for m in MARKS]), b""]), _list_array(self._known(rest.to_pylist()))]
        first, plain = len(ids[0]), plain.to_numpy(zero_copy_only=False)
        none = first + len(MARKS)
        rows = np.full((len(pieces), 2), none)
        rows[plain, 0] = words.indices.to_numpy()
        rows[plain, 1] = np.where(marks < 0, none, first + marks)
        rows[~plain, 0] = none + 1 + np.arange(len(rest))
        found = pa.concat_arrays(ids).take(pa.array(rows[coded.indices.to_numpy()].ravel()))
        ends = found.offsets.to_numpy()[2 * cut.offsets.to_numpy()].tolist()
        flat = found.values.to_numpy()
        return [flat[low:high].tobytes() for low, high in zip(ends, ends[1:])]

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, learned or from the cache."""
        known = self.cache
        new = [p for p in pieces if p not in known]
        known.update(self._learn(new))
        ids = [known[p] for p in pieces]
        if len(known) > CACHED_PIECES:
            self.cache = dict(self.special)
        else:
            for piece in new:
                if len(piece) > CACHED_LENGTH:
                    del known[piece]
        return ids

    def decode(self, ids: pa.Array) -> pa.Array:
        """Tokens of every id list joined by spaces; ids outside the vocabulary are left out."""
        flat = ids.flatten()
        good = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.tokens)))
        tokens = self.tokens.take(pc.if_else(good, flat, pa.scalar(None, flat.type)))
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if tokens.null_count:
            owner = np.repeat(np.arange(len(lengths)), lengths)
            lengths = np.bincount(owner[tokens.is_valid().to_numpy(zero_copy_only=False)], minlength=len(lengths))
            tokens = tokens.drop_null()
        offsets = pa.array(np.concatenate([[0], lengths.cumsum()]).astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), " ")
        return pc.if_else(ids.is_valid(), joined, pa.scalar(None, pa.string()))


_codecs: dict[int, Codec] = {}


def _codec(source) -> Codec:
    """The codec of a broadcast vocabulary, built once per Python worker."""
    key = hash(source.value)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(source.value)
    return _codecs[key]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from every start on, `sizes` of them."""
    return np.repeat(starts - sizes.cumsum() + sizes, sizes) + np.arange(sizes.sum())


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings and the length of each."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def _ends(words: pa.Array) -> np.ndarray:
    """Last byte of every string; none is empty."""
    data, lengths = _flat(words)
    return data[lengths.cumsum() - 1]


def _lists(counts: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], counts.cumsum()]).astype(np.int32)), pa.array(flat))


def _list_array(ids: list[bytes]) -> pa.Array:
    counts = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
    return _lists(counts, np.frombuffer(b"".join(ids), np.int32))


def _replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    clash = {c.lower() for c in columns}
    kept = {n: batch.column(n) for n in batch.schema.names if n.lower() not in clash}
    return pa.RecordBatch.from_pydict({**kept, **columns})


def _shared(df: DataFrame, tokenizer: str):
    return df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """`df` with the token ids of whole texts as `ids`, and with `decoded`, their decoded text.

    A null text counts as empty and gives an empty list; special tokens in the text become their ids, none
    are added. Other columns stay; one named like an output column is replaced. Equal rows give equal rows,
    an empty table an empty one. A very long text is held by one task, in memory in proportion to its length.
    """
    source = _shared(df, tokenizer)
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), True))]
    fields += [T.StructField(decoded, T.StringType())] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source)
        for batch in batches:
            for part in slices(batch, text):
                found = _list_array(codec.encode(part.column(text).to_pylist()))
                yield _replaced(part, {ids: found} | ({decoded: codec.decode(found)} if decoded else {}))

    return df.mapInArrow(run, extended(df, fields))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`df` with the decoded text of `ids`: tokens joined by spaces. Null ids give null; unknown ids vanish."""
    source = _shared(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source)
        for batch in batches:
            yield _replaced(batch, {text: codec.decode(batch.column(ids))})

    return df.mapInArrow(run, extended(df, [T.StructField(text, T.StringType())]))


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Number of tokens and SHA-256 of ids and decoded text."""
    return df.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    )
