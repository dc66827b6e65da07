from datetime import timedelta

from samples import EVENT_SCHEMA, NOON, event, events_frame

from sleuthflow.operators import cases
from sleuthflow.streaming.case_stream import TrailingCases, bad_events, good_events, hopping_case_windows


def source(spark, folder):
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def write(spark, folder, rows):
    events_frame(spark, rows).coalesce(1).write.mode("append").parquet(str(folder))


def test_trailing_windows_equal_the_batch_result(spark, tmp_path):
    feed = tmp_path / "feed"
    first = [event("a", i, NOON + timedelta(hours=i), f"S{i}", "R") for i in range(5)]
    late = [event("a", 9, NOON + timedelta(hours=1, minutes=30), "L", "R"), event("b", 0, NOON, "S", "R")]
    same_ids = [{**event("b", i, NOON + timedelta(hours=i), f"T{i}", "R"), "event_id": first[i]["event_id"]} for i in range(3)]
    repeated = [first[-1], event("b", 11, NOON + timedelta(hours=3), "S", "R"), event("b", 12, NOON, "S", "S"), *same_ids]
    parts = [first, late, repeated]

    def compute(events):
        return cases.case_windows(cases.window_events(events, 3))

    trailing = TrailingCases(spark, str(tmp_path / "state"), compute, 3)
    for part in parts:
        write(spark, feed, part)
        run = trailing.start(good_events(source(spark, feed), "2 days"), str(tmp_path / "checkpoint"), available_now=True)
        run.awaitTermination()
    rows = {(r["case_id"], r["event_id"]): r for part in parts for r in part if r["sender_id"] != r["receiver_id"]}
    batch = compute(events_frame(spark, list(rows.values())))
    assert sorted(trailing.latest().select(batch.columns).collect()) == sorted(batch.collect())


def test_hopping_windows(spark, tmp_path):
    feed = tmp_path / "feed"
    rows = [event("a", i, NOON + timedelta(hours=i), "S", "R", channel="crypto") for i in range(3)]
    write(spark, feed, [*rows, rows[0], event("z", 99, NOON + timedelta(days=9))])
    live = hopping_case_windows(source(spark, feed), "2 hours", "1 hour", "1 hour")
    run = live.writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    found = {r.window_start: r.n_events for r in spark.table("live").where("case_id = 'a'").collect()}
    assert found == {NOON - timedelta(hours=1): 1, NOON: 2, NOON + timedelta(hours=1): 2, NOON + timedelta(hours=2): 1}


def test_bad_events_fail_their_case_and_other_days_are_not_listed(spark, tmp_path):
    feed = tmp_path / "feed"
    parts = [
        [event(c, i, NOON + timedelta(days=10 * i, hours=c == "b"), f"S{i}", "R") for c in ("a", "b")] for i in range(3)
    ]
    parts[1].append(event("b", 9, NOON, "S", "S"))

    def compute(events):
        return cases.case_windows(cases.window_events(events, 3))

    trailing = TrailingCases(spark, str(tmp_path / "state"), compute, 3)
    listed = []
    plain = trailing._log

    def log(first, last):
        listed.append((last - first).days + 1)
        return plain(first, last)

    trailing._log = log
    for part in parts:
        write(spark, feed, part)
        stream = source(spark, feed)
        trailing.start(good_events(stream, "40 days"), str(tmp_path / "c1"), available_now=True).awaitTermination()
        trailing.start_quarantine(bad_events(stream), str(tmp_path / "c2"), available_now=True).awaitTermination()
    assert [r.case_id for r in trailing.latest().collect()] == ["a"]
    assert [tuple(r) for r in trailing.failures().collect()] == [("b", "sender_id and receiver_id must be different.")]
    assert max(listed) <= 2
    # A new process finds the newest event again.
    assert TrailingCases(spark, str(tmp_path / "state"), compute, 3).newest == NOON + timedelta(days=20, hours=1)


def test_log_keeps_few_folders_and_late_events_count(spark, tmp_path):
    """One event an hour of one case and a case a day; now and then a late one, a batch again, and a restart."""

    def compute(events):
        return cases.case_windows(cases.window_events(events, 6))

    def made():
        return TrailingCases(spark, str(tmp_path / "state"), compute, 6, keep_hours=12, merge_every=3)

    trailing, rows, counts = made(), [], []
    for n in range(20):
        now = NOON + timedelta(hours=4 * n)
        part = [event("busy", n, now, f"S{n}", "R"), event(f"d{n // 3}", n, now, f"T{n}", "R")]
        if n % 4 == 3:
            part.append(event("busy", 100 + n, now - timedelta(hours=5), "late", "R"))
        rows += part
        trailing._batch(events_frame(spark, part), n)
        if n in (5, 11):
            trailing = made()
            trailing._batch(events_frame(spark, part), n)
        counts.append([len(trailing.log.folders(k)) for k in ("batch", "merged")])
    assert max(b + m for b, m in counts) <= 2 * 3 + 2
    days = {p.name for p in (tmp_path / "state" / "log" / f"merged={trailing.log.folders('merged')[-1]}").glob("event_date=*")}
    assert len(days) <= 2
    batch = compute(events_frame(spark, rows))
    assert sorted(trailing.latest().select(batch.columns).collect()) == sorted(batch.collect())
