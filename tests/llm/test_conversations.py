import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sleuthflow.llm import conversations

LEGAL = re.compile(r"(s?(ua)+)?\Z")
EMPTY = hashlib.sha256(b"").hexdigest()


def best_edits(rows):
    """Every list of edits with at most two inserts in a row: (cost, audit, repaired rows)."""
    best = None

    def go(i, cost, audit, initials, out):
        nonlocal best
        if best and cost > best[0]:
            return
        for k in range(3):
            for inserted in itertools.product("ua", repeat=k):
                now = (cost + 5 * k, audit + "I" * k, initials + "".join(inserted))
                made = out + [("user" if x == "u" else "assistant", "") for x in inserted]
                if i == len(rows):
                    if LEGAL.match(now[2]) and (best is None or now[:2] < best[:2]):
                        best = (*now[:2], made)
                    continue
                role, text, fault = rows[i]
                go(i + 1, now[0] + 2, now[1] + "D", now[2], made)
                if fault in ("blank", "duplicate"):
                    continue
                more = now[0] + (5 if fault == "truncated" else 0)
                go(i + 1, more, now[1] + "K", now[2] + (role[:1] or "?"), made + [(role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, more + 1, now[1] + "R", now[2] + other[0], made + [(other, text)])

    go(0, 0, "", "", [])
    return best


def plain(rows):
    """Report of ordered (turn, role, text)."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", EMPTY)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append((role, text, fault))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, repaired = best_edits(faults)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    counts = [sum(f == kind for *_, f in faults) for kind in ("blank", "duplicate", "truncated")]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def conversation(rng, length):
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant"]
    texts = ["Yes.", "No", "", " \t", "Why?", "É!", "Go on. ", "Hm.\n", "Yes.", "a.b"]
    turns = [None, *range(length + 1)]
    return [(rng.choice(turns), rng.choice(roles), rng.choice(texts)) for _ in range(length)]


@pytest.fixture(scope="module")
def table():
    rng = random.Random(11)
    found = {c: conversation(rng, rng.randint(1, 5)) for c in range(220)}
    found[None] = [(0, "user", "Hi."), (1, "assistant", "Ho.")]
    found[900] = [(0, "user", "One.")] * 4
    return found


def frame(spark, table):
    rows = [(c, *r) for c, rs in table.items() for r in rs]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_repairs_equal_all_edits_tried(spark, table):
    got = {r[0]: tuple(r)[1:] for r in conversations.repairs(frame(spark, table).repartition(3)).collect()}
    assert got == {c: plain(rows) for c, rows in table.items()}


def test_edits_spell_the_repaired_conversation(spark, table):
    told = {r.conv_id: r for r in conversations.repairs(frame(spark, table)).collect()}
    rows = {}
    for r in conversations.edits(frame(spark, table)).collect():
        rows.setdefault(r.conv_id, []).append(r)
    for c, report in told.items():
        mine = sorted(rows.get(c, []), key=lambda r: r.place)
        assert "".join(r.edit for r in mine) == report.audit
        kept = "\n".join(f"{r.role}:{r.text}" for r in mine if r.edit != "D")
        assert hashlib.sha256(kept.encode()).hexdigest() == report.repaired_sha256


def kind(conv, turn):
    return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20


def test_damage(spark, table):
    shown = frame(spark, table).withColumns({c: F.lit("clash") for c in ("gone", "blank", "whole", "again", "h1", "said")})
    damaged = conversations.damaged(shown)
    expected = {}
    for c, rows in table.items():
        expected[c] = []
        for turn, role, text in rows:
            k = kind(c, turn)
            body = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            expected[c] += [(turn, "user" if k == 4 else role, body)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = {r[0]: tuple(r)[1:] for r in conversations.repairs(damaged, gone="gone").collect()}
    assert got == {c: plain(rows) for c, rows in expected.items()}
    assert {kind(c, r[0]) for c, rows in table.items() for r in rows} >= {0, 1, 2, 3, 4}


def test_nulls_and_dropped_rows(spark):
    rows = spark.createDataFrame(
        [(1, None, None, None, False), (1, 0, "user", "Hi.", False), (2, 0, "user", "Hi.", True), (3, None, "user", None, None)],
        "conv_id long, turn long, role string, text string, away boolean",
    )
    got = {r[0]: tuple(r)[1:] for r in conversations.repairs(rows, gone="away").collect()}
    assert got == {1: plain([(None, " ", " "), (0, "user", "Hi.")]), 2: plain([]), 3: plain([(None, "user", " ")])}
    assert conversations.repairs(rows.limit(0)).count() == 0
    assert conversations.edits(rows.limit(0)).count() == 0


def test_long_conversation_is_settled_on_the_way(spark):
    """Survivors meet again after a few rows, so what is held stays short however long the conversation is."""
    held, longest, settled = conversations.Conversation(), 0, 0
    for n in range(20_000):
        role = "user" if n % 2 == 0 or n % 97 == 0 else "assistant"
        settled += len(list(held.add(n, role, f"Row {n}.", False, True, False)))
        longest = max(longest, len(held.waiting))
    settled += len(list(held.finish()))
    assert settled >= 20_000 and longest < 300 and held.gaps() == 0


def test_one_hot_conversation(spark):
    """A third of all rows in one conversation, and one text said over and over."""
    rows = [(7, n, "user" if n % 2 == 0 else "assistant", "Same again." if n % 3 == 0 else f"Row {n}.") for n in range(3000)]
    rows += [(100 + n, t, ("user", "assistant")[t], f"{n}.") for n in range(3000) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r.conv_id: r for r in conversations.repairs(df).collect()}
    assert len(got) == 3001 and got[7].duplicate == 1000 - 2 and got[7].gaps == 0
    assert all(got[100 + n].audit == "KK" and got[100 + n].cost == 0 for n in range(3000))


def test_unlike_tied_suffixes_are_compared_whole():
    """Both ways to drop one of two runs cost the same; the least text wins though they part at the start."""
    rows = [("user", f"{n}.", "") for n in range(6)]
    c = conversations.Conversation()
    told = [e for n, (role, text, _) in enumerate(rows) for e in c.add(n, role, text, False, True, False)] + list(c.finish())
    assert (c.cost, "".join(e for e, _, _ in told)) == best_edits(rows)[:2]
