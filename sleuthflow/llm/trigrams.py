"""Boolean trigram queries from regular expressions, and an inverted index over a block of texts."""

from __future__ import annotations

from itertools import product
from re import _constants as op, _parser as parser

import numpy as np

#: Strings followed exactly through a pattern; larger alternatives are given up.
STRINGS = 64
ANY: tuple = ("all",)


def _all_of(*queries: tuple) -> tuple:
    parts = list(dict.fromkeys(q for q in queries if q != ANY))
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any_of(*queries: tuple) -> tuple:
    parts = list(dict.fromkeys(queries))
    return ANY if ANY in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> tuple:
    """Some one of the strings occurs: all trigrams of at least one of them."""
    return _any_of(*[_all_of(*[("has", s[k : k + 3]) for k in range(len(s) - 2)]) for s in sorted(strings)])


def _members(items: list) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < STRINGS:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found


def _exact(kind, value) -> set[str] | None:
    """Every string that a pattern item can match, if they are few."""
    if kind is op.LITERAL:
        return {chr(value)}
    if kind is op.IN:
        return _members(value)
    if kind is op.AT:
        return {""}
    if kind is op.SUBPATTERN:
        return _exact_run(value[3])
    if kind is op.BRANCH:
        found = [_exact_run(branch) for branch in value[1]]
        return None if None in found else set().union(*found)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] != op.MAXREPEAT and value[1] <= 3:
        one = _exact_run(value[2])
        if one is None:
            return None
        counts = range(value[0], value[1] + 1)
        if sum(len(one) ** n for n in counts) > STRINGS:
            return None
        return {"".join(x) for n in counts for x in product(sorted(one), repeat=n)}
    return None


def _exact_run(items) -> set[str] | None:
    found = {""}
    for kind, value in items:
        part = _exact(kind, value)
        if part is None or len(found) * len(part) > STRINGS:
            return None
        found = {a + b for a in found for b in part}
    return found


def _needed(items) -> tuple:
    """Query of a sequence: runs of exactly known items give strings, the others their own query."""
    queries, run = [], {""}

    def close() -> None:
        nonlocal run
        queries.append(_of_strings(run))
        run = {""}

    for kind, value in items:
        part = _exact(kind, value)
        if part is not None and len(run) * len(part) <= STRINGS:
            run = {a + b for a in run for b in part}
            continue
        close()
        if part is not None and len(part) <= STRINGS:
            run = part
        elif kind is op.SUBPATTERN:
            queries.append(_needed(value[3]))
        elif kind is op.BRANCH:
            queries.append(_any_of(*[_needed(branch) for branch in value[1]]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
            queries.append(_needed(value[2]))
    close()
    return _all_of(*queries)


def trigram_query(pattern: str) -> tuple:
    """Trigrams (lower case) that every match contains: nested ("and" | "or", ...), ("has", trigram), or ANY.

    ANY means that the pattern lacks mandatory trigrams and must scan fully.
    """
    return _lowered(_needed(parser.parse(pattern)))


def _lowered(query: tuple) -> tuple:
    if query[0] == "has":
        return ("has", query[1].lower()) if query[1].isascii() else ANY
    if query == ANY:
        return ANY
    return (_all_of if query[0] == "and" else _any_of)(*[_lowered(q) for q in query[1:]])


def trigrams_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "has" else set().union(*[trigrams_of(q) for q in query[1:]]) if query != ANY else set()


class BlockIndex:
    """Postings of the wanted trigrams over a block of texts, one bit set per trigram."""

    def __init__(self, wanted: set[str]) -> None:
        self.wanted = sorted(wanted)
        self.number = {t: n for n, t in enumerate(self.wanted)}
        low = np.arange(256, dtype=np.uint8)
        low[65:91] += 32
        # A byte's class: 0 for bytes in no wanted trigram, so that the lookup table stays small.
        self.classes = np.zeros(256, np.uint32)
        letters = sorted(set("".join(self.wanted).encode()))
        for k, b in enumerate(letters, 1):
            self.classes[low == b] = k
        self.base = len(letters) + 1
        self.table = np.full(self.base**3, len(self.wanted), np.uint16)
        for t, n in self.number.items():
            a, b, c = (int(self.classes[x]) for x in t.encode())
            self.table[(a * self.base + b) * self.base + c] = n

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits (trigram, text); `data` holds the texts' bytes, text k from offsets[k] to offsets[k + 1]."""
        bits = np.zeros((len(self.wanted), len(offsets) - 1), bool)
        if len(data) < 3 or not self.wanted:
            return bits
        kinds = self.classes[data]
        found = self.table[(kinds[:-2] * np.uint32(self.base) + kinds[1:-1]) * np.uint32(self.base) + kinds[2:]]
        at = np.flatnonzero(found < len(self.wanted))
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[text + 1]
        bits[found[at[inside]], text[inside]] = True
        return bits

    def select(self, query: tuple, bits: np.ndarray) -> np.ndarray:
        """Texts that the query leaves as candidates."""
        if query == ANY:
            return np.ones(bits.shape[1], bool)
        if query[0] == "has":
            return bits[self.number[query[1]]]
        parts = [self.select(q, bits) for q in query[1:]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)
