import json
from datetime import timedelta

import pytest
from samples import NOON, event
from test_stream import source, write

from sleuthflow.operators import cases
from sleuthflow.streaming import case_state
from sleuthflow.streaming.results import CaseResults

HOURS = 3
COLUMNS = ["case_id", "n_events", "start_ts", "end_ts", "window_hours"]


def windows(rows):
    """Plain windows: each event of a case once, back from its latest."""
    seen, found = set(), {}
    for r in rows:
        if r["sender_id"] != r["receiver_id"] and (r["case_id"], r["event_id"]) not in seen:
            seen.add((r["case_id"], r["event_id"]))
            found.setdefault(r["case_id"], []).append(r["ts"])
    out = []
    for case, times in found.items():
        inside = [t for t in times if t >= max(times) - timedelta(hours=HOURS)]
        out.append((case, len(inside), min(inside), max(inside), HOURS))
    return sorted(out)


@pytest.fixture
def stream(spark, tmp_path):
    """Feeds parts one by one; every part is a restart of the query from its checkpoint."""

    def run(parts, lateness="1 hour"):
        progress = []
        for part in parts:
            write(spark, tmp_path / "feed", part)
            query = case_state.start(
                spark, source(spark, tmp_path / "feed"), str(tmp_path / "results"), str(tmp_path / "checkpoint"), HOURS, lateness, available_now=True
            )
            query.awaitTermination()
            progress += [json.loads(p.json) for p in query.recentProgress]
        return CaseResults(spark, str(tmp_path / "results"), case_state.WINDOW_SCHEMA).latest(), progress

    return run


def test_state_equals_the_batch_result_over_restarts(stream):
    first = [event("a", i, NOON + timedelta(minutes=40 * i), f"S{i}", "R") for i in range(5)]
    late = [event("a", 9, NOON + timedelta(minutes=110), "L", "R"), event("b", 0, NOON + timedelta(hours=2), "S", "R")]
    same_ids = [{**event("b", i, NOON + timedelta(hours=2, minutes=i), f"T{i}", "R"), "event_id": first[i]["event_id"]} for i in range(3)]
    repeated = [first[-1], event("b", 11, NOON + timedelta(hours=4), "S", "R"), event("b", 12, NOON + timedelta(hours=4), "S", "S"), *same_ids]
    jump = [event("a", 20, NOON + timedelta(hours=5, minutes=40, microseconds=1), "S", "R"), event("c", 1, NOON + timedelta(hours=5), "S", "R")]
    parts = [first, late, repeated, jump]
    found, _ = stream(parts, "4 hours")
    assert sorted(tuple(r) for r in found.select(COLUMNS).collect()) == windows([r for part in parts for r in part])


def test_state_equals_case_windows(spark, stream):
    rows = [event(f"c{i % 3}", i, NOON + timedelta(minutes=17 * i), f"S{i}", "R") for i in range(60)]
    found, _ = stream([rows[:20], rows[20:40], rows[40:]])
    from samples import events_frame

    batch = cases.case_windows(cases.window_events(events_frame(spark, rows), HOURS))
    assert sorted(tuple(r) for r in found.select(COLUMNS).collect()) == sorted(tuple(r) for r in batch.select(COLUMNS).collect())


def test_state_is_bounded_and_cases_expire(stream):
    """200 hours of one event a minute and a case of its own each day: state holds hours of the window, not the past."""
    days = []
    for day in range(8):
        start = NOON + timedelta(days=day)
        days.append([event("busy", day * 1000 + i, start + timedelta(minutes=6 * i), f"S{i}", "R") for i in range(240)])
        days[-1] += [event(f"day-{day}", i, start + timedelta(minutes=i), f"S{i}", "R") for i in range(3)]
    found, progress = stream(days)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    # At most two cases are alive: hours of the window and two more, an end and a timer with its index each.
    assert max(kept[3:]) <= 2 * (HOURS + 2 + 4) and max(kept[3:]) <= max(kept[:3]) + HOURS
    rows = [r for part in days for r in part]
    assert sorted(tuple(r) for r in found.select(COLUMNS).collect()) == windows(rows)


def test_late_events_are_counted_and_left_out(stream):
    first = [event("a", 0, NOON, "S", "R"), event("z", 1, NOON + timedelta(hours=9), "S", "R")]
    late = [event("a", 2, NOON + timedelta(minutes=1), "S", "R")]
    found, progress = stream([first, late])
    assert {r.case_id: r.n_events for r in found.collect()} == {"a": 1, "z": 1}
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress if p["stateOperators"]) == 1


def test_results_keep_few_folders(spark, tmp_path):
    store = CaseResults(spark, str(tmp_path / "r"), "case_id string, n long, end_ts timestamp", merge_every=4, keep_hours=10)
    assert store.latest().count() == 0
    counts = []
    for n in range(50):
        rows = [(f"c{n % 5}", n, NOON + timedelta(hours=n)), (f"once{n}", n, NOON + timedelta(hours=n))]
        store.put(spark.createDataFrame(rows, store.schema).coalesce(1), n)
        counts.append(len(store.folders("batch")) + len(store.folders("merged")))
    assert max(counts) <= 2 * 4 + 2
    found = {r.case_id: r.n for r in store.latest().collect()}
    assert all(found[f"c{n % 5}"] == n for n in range(45, 50)) and found["once49"] == 49
    assert "once30" not in found and "once40" in found
    # A batch that runs again changes nothing.
    store.put(spark.createDataFrame([("c0", 45, NOON + timedelta(hours=45)), ("once45", 45, NOON + timedelta(hours=45))], store.schema), 45)
    assert {r.case_id: r.n for r in store.latest().collect()} == found
