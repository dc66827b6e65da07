"""Cheapest repair of the turn structure of conversations, by Viterbi with coalescing survivors.

A repaired conversation is empty, or pairs of a user and an assistant turn behind at most one system turn. Rows
are kept, given the other role or deleted, and empty turns can be inserted; an automaton of four states follows
the roles, and for each state one survivor is kept: the cheapest edits that lead there, ties to the least text of
edit initials. Survivors are leaves of a tree of back pointers with reference counts. A node that loses its last
child goes; as long as the root has one child only, all survivors share its edits, which are emitted, so that a
conversation of any length is held only from the last common ancestor on.

Ties compare the whole unresolved suffixes. No suffix is read again for that: survivors carry a rank, in which
equal ranks mean equal texts up to a short tail, and ranks are renewed from one row to the next.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sleuthflow.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
USER, ASSISTANT = "user", "assistant"
#: Costs of edits; CUT is added for a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: States: nothing yet, behind a system turn, behind a user turn, behind an assistant turn.
START, SYSTEM, ASKED, ANSWERED = range(4)
NEXT = {(START, "s"): SYSTEM} | {(s, "u"): ASKED for s in (START, SYSTEM, ANSWERED)} | {(ASKED, "a"): ANSWERED}
ALTERNATING = {"su", "ua", "au"}
#: Rows that are handed on together.
ROWS_AT_ONCE = 10_000


def _turn(state: int) -> str:
    """The one role, beside a system turn, that may follow."""
    return ASSISTANT if state == ASKED else USER


def _moves(initial: str, deleted: bool, cut: bool) -> list[list[tuple[int, str, int]]]:
    """(cost, edits, next state) of a row from every state.

    A second insert before a row leads nowhere that the row itself does not reach cheaper, and one before a
    deleted row can as well come behind it, where its text is less.
    """
    out, extra = [], CUT if cut else 0
    for state in range(4):
        found = [(DELETE, "D", state)]
        for inserted in () if deleted else ("", "I"):
            at = NEXT[state, _turn(state)[0]] if inserted else state
            before = INSERT * len(inserted) + extra
            if (at, initial) in NEXT:
                found.append((before + KEEP, inserted + "K", NEXT[at, initial]))
            if _turn(at)[0] != initial:
                found.append((before + REROLE, inserted + "R", NEXT[at, _turn(at)[0]]))
        out.append(found)
    return out


MOVES = {(i, d, c): _moves(i, d, c) for i in ("s", "u", "a", "") for d in (False, True) for c in (False, True)}


#: (state, other): by how much the rest can cost more from a state than from the other. Behind an answer, all goes on as
#: from the start but for a system turn, which is deleted then; an inserted turn leads across the two halves of a pair.
BEHIND = {
    (ANSWERED, START): DELETE, (ANSWERED, SYSTEM): 0, (START, ANSWERED): 0, (START, SYSTEM): 0,
    (ASKED, ANSWERED): INSERT, (ANSWERED, ASKED): INSERT, (START, ASKED): INSERT, (SYSTEM, ASKED): INSERT,
    (ASKED, SYSTEM): INSERT, (ASKED, START): INSERT + DELETE,
}


class Node:
    """Edits of one row on a surviving path."""

    __slots__ = ("parent", "edits", "children", "held")

    def __init__(self, parent: Node | None, edits: str) -> None:
        self.parent, self.edits, self.children, self.held = parent, edits, [], 0
        if parent:
            parent.children.append(self)


class Survivors:
    """The cheapest path to every state, as (cost, rank, tail, node)."""

    def __init__(self) -> None:
        self.root = Node(None, "")
        self.root.held = 1
        self.paths: dict[int, tuple[int, int, str, Node]] = {START: (0, 0, "", self.root)}

    def step(self, moves: list[list[tuple[int, str, int]]]) -> Iterator[str]:
        """Takes a row with its moves; gives the edits of rows, in order, on which all survivors agree from now on."""
        best: dict[int, tuple] = {}
        for state, (cost, rank, tail, node) in self.paths.items():
            for more, edits, following in moves[state]:
                found = (cost + more, rank, tail + edits)
                if following not in best or found < best[following][0]:
                    best[following] = (found, node, edits)
        # A path that another one beats whatever comes is no survivor; without that, all rows deleted would be one forever.
        costs = {state: b[0][0] for state, b in best.items()}
        best = {p: b for p, b in best.items() if not any(costs[q] + BEHIND.get((q, p), math.inf) < b[0][0] for q in costs)}
        ranks: dict[tuple[int, str], tuple[int, str]] = {}
        base = None
        for rank, tail in sorted({b[0][1:] for b in best.values()}):
            if base is None or base[0] != rank or not tail.startswith(base[1]):
                base = (rank, tail, len(ranks))
            ranks[rank, tail] = (base[2], tail[len(base[1]) :])
        before, self.paths = self.paths, {}
        for state, ((cost, rank, tail), node, edits) in best.items():
            child = Node(node, edits)
            child.held = 1
            self.paths[state] = (cost, *ranks[rank, tail], child)
        for *_, node in before.values():
            node.held -= 1
            self._release(node)
        while len(self.root.children) == 1 and not self.root.held:
            self.root = self.root.children.pop()
            self.root.parent = None
            yield self.root.edits

    def _release(self, node: Node) -> None:
        while not node.held and not node.children and node.parent:
            parent, node.parent = node.parent, None
            parent.children.remove(node)
            node = parent

    def finish(self) -> tuple[int, list[str]]:
        """Cost of the best whole path and its edits that were not given yet, row by row, then those behind the last row."""
        ways = []
        for state, (cost, rank, tail, node) in self.paths.items():
            edits = ""
            while True:
                if state in (START, ANSWERED):
                    ways.append((cost, rank, tail + edits, edits, node))
                if len(edits) == 2:
                    break
                state, cost, edits = NEXT[state, _turn(state)[0]], cost + INSERT, edits + "I"
        cost, _, _, last, node = min(ways, key=lambda w: w[:3])
        open_ = [last]
        while node is not self.root:
            open_.append(node.edits)
            node = node.parent
        return cost, open_[::-1]


class Conversation:
    """One conversation row by row; `edited` are (edit, role, text) as soon as they are settled."""

    def __init__(self) -> None:
        self.survivors, self.waiting, self.state = Survivors(), deque(), START
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.turns, self.first, self.last, self.before = 0, None, None, None

    def _settled(self, edits: str, row: tuple[str, str] | None) -> Iterator[tuple[str, str, str]]:
        for edit in edits:
            if edit == "D":
                yield edit, *row
                continue
            role = row[0] if edit == "K" else _turn(self.state)
            yield edit, role, "" if edit == "I" else row[1]
            self.state = NEXT[self.state, role[:1]]

    def add(self, turn: int | None, role: str, text: str, blank: bool, whole: bool, again: bool) -> Iterator[tuple[str, str, str]]:
        if self.before:
            self.illegal += self.before[1][:1] + role[:1] not in ALTERNATING
        again = again or (turn, role, text) == self.before
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        self.before = (turn, role, text)
        self.rows += 1
        duplicate, cut = again and not blank, not whole and not again and not blank
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + cut
        self.waiting.append((role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        for edits in self.survivors.step(MOVES[initial, blank or duplicate, cut]):
            yield from self._settled(edits, self.waiting.popleft())

    def finish(self) -> Iterator[tuple[str, str, str]]:
        self.cost, edits = self.survivors.finish()
        for one in edits[:-1]:
            yield from self._settled(one, self.waiting.popleft())
        yield from self._settled(edits[-1], None)

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`rows` after reproducible damage by crc32(`conv:turn`) % 20, with nulls of role and text as one space.

    0 drops a row (it stays with `gone` set, so that its conversation is not lost), 1 empties its text, 2 takes its
    sentence ends, 3 repeats it, 4 makes its role user.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)]
    kind = F.pmod(F.crc32(F.concat_ws(":", *named).cast("binary")), F.lit(20))
    body = F.coalesce(F.col(text), F.lit(" "))
    marked = rows.select(conv, turn, F.coalesce(F.col(role), F.lit(" ")).alias(role), body.alias(text), kind.alias("_kind"))
    changed = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(F.col(text), ENDS, "")).otherwise(F.col(text))
    who = F.when(F.col("_kind") == 4, USER).otherwise(F.col(role))
    once = marked.select(conv, turn, who.alias(role), changed.alias(text), (F.col("_kind") == 0).alias("gone"), (F.col("_kind") == 3).alias("_twice"))
    copies = F.explode(F.when(F.col("_twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return once.withColumn("_copy", copies).drop("_twice", "_copy")


def ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows of every conversation side by side in order, with `blank`, `whole` and `again` (said at an earlier turn).

    Repeats over several turns are found from hashes, pre-aggregated; only they are joined back. Conversations are
    dealt out whole, as a digest of one conversation is taken in order; their rows are sorted on disk, not held.
    """
    placed = F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"))
    trimmed = F.rtrim(F.col(text), F.lit(BLANKS))
    marks = [(trimmed == "").alias("blank"), F.substring(trimmed, -1, 1).isin(*ENDS).alias("whole")]
    hashes = [F.xxhash64(F.lit(n), role, text).alias(f"h{n}") for n in (1, 2)]
    marked = rows.select(conv, turn, role, text, "gone", *marks, *hashes)
    repeats = materialize(
        marked.where(~F.col("gone")).groupBy(F.col(conv).alias("_conv"), "h1", "h2")
        .agg(F.min(placed).alias("said"), F.max(placed).alias("_last"))
        .where(F.col("said") < F.col("_last")).select("_conv", F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "said"),
        "repeats",
    )
    same = F.col(conv).eqNullSafe(F.col("_conv")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    return (
        marked.join(repeats, same, "left")
        .select(conv, turn, role, text, "gone", "blank", "whole", F.coalesce(placed > F.col("said"), F.lit(False)).alias("again"))
        .repartition(conv)
        .sortWithinPartitions(F.asc_nulls_first(conv), F.asc_nulls_first(turn), role, text)
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Conversation, Iterator[tuple[str, str, str]], bool]]:
    """(key, conversation, settled edits, whether that was the end) along sorted rows."""
    key, open_ = None, None
    for batch in batches:
        for conv, turn, role, text, gone, *marks in zip(*(c.to_pylist() for c in batch.columns)):
            if open_ is None or conv != key:
                if open_ is not None:
                    yield key, open_, open_.finish(), True
                key, open_ = conv, Conversation()
            if not gone:
                yield key, open_, open_.add(turn, role, text, *marks), False
    if open_ is not None:
        yield key, open_, open_.finish(), True


def edits(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None
) -> DataFrame:
    """(conv, place, edit, role, text): every edit in order, deleted rows included, with the role after it.

    `rows` as for `repairs`. Those without edit D, by place, are the repaired conversation.
    """
    fields = [rows.schema[conv], T.StructField("place", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edit", role, text)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, types = [], 0, None

        def packed() -> pa.RecordBatch:
            columns = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.name for f in fields])

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal types
            for batch in batches:
                types = [batch.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield batch

        for key, _, settled, ended in _walk(watched()):
            for one in settled:
                held.append((key, place, *one))
                place += 1
            place = 0 if ended else place
            if len(held) >= ROWS_AT_ONCE:
                yield packed()
                held.clear()
        if held:
            yield packed()

    return _marked(rows, conv, turn, role, text, gone).mapInArrow(run, T.StructType(fields))


def _marked(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    present: list[Column | str] = [conv, turn, *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in (role, text)]]
    absent = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    return ordered(rows.select(*present, absent.alias("gone")), conv, turn, role, text)


def repairs(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None
) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Rows are taken by turn (nulls first), then role and text. A row's first fault counts: blank, duplicate (same
    role and text earlier), truncated (does not end a sentence). illegal counts neighbours that do not alternate,
    gaps missing turns. audit holds the initials of the cheapest edits (Keep, Rerole, Delete, Insert), ties to the
    least text; repaired_sha256 is that of the repaired `role:text` lines. Blanks and duplicates are always deleted.

    Null roles and texts count as one space, so that a null text is blank; a null key is a conversation like any
    other. Rows whose column `gone` is true only keep their conversation: without other rows it has zeros, an empty audit and
    the hash of nothing. Equal rows of a turn are duplicates of the first. Other columns are not read; an empty
    table gives an empty one. Memory holds what survivors disagree on, which few patterns make long, and the audit.
    """
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    fields = [rows.schema[conv], *[T.StructField(c, T.LongType()) for c in numbers]]
    fields += [T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types = [], None
        audit, digest, lines = [], hashlib.sha256(), 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], [f.name for f in fields])

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal types
            for batch in batches:
                types = [batch.column(0).type, *[pa.int64()] * len(numbers), pa.string(), pa.string()]
                yield batch

        for key, c, settled, ended in _walk(watched()):
            for edit, who, said in settled:
                audit.append(edit)
                if edit != "D":
                    digest.update(f"\n{who}:{said}".encode() if lines else f"{who}:{said}".encode())
                    lines += 1
            if ended:
                held.append((key, c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, c.cost, "".join(audit), digest.hexdigest()))
                audit, digest, lines = [], hashlib.sha256(), 0
                if len(held) >= ROWS_AT_ONCE:
                    yield packed()
                    held.clear()
        if held:
            yield packed()

    return _marked(rows, conv, turn, role, text, gone).mapInArrow(run, T.StructType(fields))
