"""Secret scans: every rule is a pattern with a least length, found through a trigram index.

Texts are indexed in blocks inside a task: for each trigram that some rule needs, the block's postings are a
bit set over its texts. A rule's Boolean trigram query intersects and unites postings, and only candidates are
verified with the pattern. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sleuthflow.llm.common import extended, slices
from sleuthflow.llm.trigrams import BlockIndex, trigram_query, trigrams_of


@dataclass(frozen=True)
class Rule:
    """`least` characters are asked of group `group`; shorter matches are dropped after matching."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    either_case: bool = False
    base: bool = False


#: The three base rules, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, base=True),
    Rule("hex", r"[0-9a-f]+", 16, base=True),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
)
RULES = BASE + MORE


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = BlockIndex(set().union(*[trigrams_of(q) for q in self.queries]))
        self.find = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.either_case else 0)).finditer for r in rules]
        # A run of one set of characters is found faster when the least length is part of the pattern; runs
        # are maximal either way, so the matches are the same.
        for n, r in enumerate(rules):
            if (run := re.fullmatch(r"(\[[^\]]+\])\+", r.pattern)) and not r.group:
                self.find[n] = _long_runs(run[1], r.least)

    def spans(self, block: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) in code points of every text, by start and then rule."""
        texts = block.to_pylist()
        raw = block.cast(pa.binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        bits = self.index.postings(data, offsets - offsets[0])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for n, (rule, query, find) in enumerate(zip(self.rules, self.queries, self.find)):
            for k in np.flatnonzero(self.index.select(query, bits)).tolist():
                if texts[k]:
                    for m in find(texts[k]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[k].append((m.start(), n, m.end()))
        return [sorted(x) for x in found]


def _long_runs(characters: str, least: int):
    """Runs of `least` or more characters of a set, probed at every `least`-th character only."""
    inside = re.compile(characters).match
    whole = re.compile(f"{characters}+").match

    def find(text: str) -> Iterator[re.Match]:
        at, low = least - 1, 0
        while at < len(text):
            if not inside(text, at):
                at += least
                continue
            start = at
            while start > low and inside(text, start - 1):
                start -= 1
            match = whole(text, start)
            if match.end() - start >= least:
                yield match
            low = match.end()
            at = max(low, at) + least

    return find


_scanners: dict[tuple, Scanner] = {}


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "secrets") -> DataFrame:
    """`df` with `out`: array of (kind, start, end) of every text, by start, then by the rules' order.

    Offsets are code points, end exclusive. Matches of one rule do not overlap, those of different rules may.
    Null and empty texts have none. Other columns stay, one named like `out` is replaced; equal rows give
    equal rows, an empty table an empty one. Whole texts are scanned, one in memory at a time beside its block.
    """
    entry = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in batches:
            for part in slices(batch, text):
                spans = scanner.spans(part.column(text))
                rows = [[{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in x] for x in spans]
                kept = {n: part.column(n) for n in part.schema.names if n.lower() != out.lower()}
                yield pa.RecordBatch.from_pydict({**kept, out: pa.array(rows, pa.list_(kind))})

    return df.mapInArrow(run, extended(df, [T.StructField(out, T.ArrayType(entry))]))


def listed(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined, of all spans or those of some kinds."""
    found = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(scanned: DataFrame, spans: str = "secrets") -> DataFrame:
    """Counts of the base kinds, digest of the base spans, list of all spans."""
    kinds = tuple(r.kind for r in BASE)

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id", *map(count, kinds), F.sha2(listed(spans, kinds).cast("binary"), 256).alias("base_sha256"), listed(spans).alias("spans")
    )


def redacted(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`df` with every secret span, overlapping ones as one, replaced by `mark`; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(text)
                found = [_cut(t, s, mark) for t, s in zip(column.to_pylist(), scanner.spans(column))]
                yield pa.RecordBatch.from_pydict({n: pa.array(found, pa.string()) if n == text else part.column(n) for n in part.schema.names})

    return df.mapInArrow(run, df.schema)


def _cut(text: str | None, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    if not spans:
        return text
    out, low, high = [], 0, None
    for start, _, end in spans:
        if high is None or start >= high:
            if high is not None:
                low = high
            out += [text[low:start], mark]
            high = end
        high = max(high, end)
    return "".join([*out, text[high:]])
