"""Exact trailing windows by keyed state: what a case can still need is held per case and nothing else.

A trailing window ends at the latest event of its case and only moves forward, so an event older than the window
can never come back into it. State therefore holds the window alone, in one entry per hour: a batch reads at most
window + 2 entries of a case, rewrites the hours it touches and drops those that left the window. Event ids are
held beside their times, so a repeated event is known without a separate state for it. Once the watermark is past
the end of a case by more than the window, no event still to come can share a window with what is held; a timer
then drops the case.

A case is handled by one task at a time, batch by batch of its rows and never as a whole; a single case with a
large part of all traffic is better served by `case_stream.TrailingCases`, which splits it, and which can compute
anything the batch operators can.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sleuthflow.functions.columns import require_columns
from sleuthflow.streaming.case_stream import checked_events
from sleuthflow.streaming.results import CaseResults

HOUR_US = 3_600_000_000
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WINDOW_SCHEMA = "case_id string, n_events long, start_ts timestamp, end_ts timestamp, window_hours int"


def window_of_case(window_hours: int) -> StatefulProcessor:
    """Processor of one case. Its class is local, so that it travels whole: Spark's streaming helper on the driver does
    not see the modules that were given to the workers."""

    class WindowOfCase(StatefulProcessor):
        """Events of the trailing window of a case by hour; gives the window as it stands after each batch."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.hours = handle.getMapState("hours", "hour long", "ids array<string>, us array<long>")
            self.end = handle.getValueState("end", "us long")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            held = {hour[0]: (list(ids), list(us)) for hour, (ids, us) in self.hours.iterator()}
            seen = {i for ids, _ in held.values() for i in ids}
            before = self.end.get()[0] if self.end.exists() else None
            end, touched = before, set()
            for frame in rows:
                times = frame["ts"].to_numpy().astype("datetime64[us]").astype("int64")
                end = int(times.max()) if end is None else max(end, int(times.max()))
                inside = times >= end - window_hours * HOUR_US
                for name, us in zip(frame["event_id"].to_numpy()[inside].tolist(), times[inside].tolist()):
                    if name not in seen:
                        seen.add(name)
                        ids, at = held.setdefault(us // HOUR_US, ([], []))
                        ids.append(name)
                        at.append(us)
                        touched.add(us // HOUR_US)
            start = end - window_hours * HOUR_US
            first = start // HOUR_US
            for hour in [h for h in held if h <= first]:
                kept = [(n, us) for n, us in zip(*held[hour]) if us >= start]
                if hour < first or not kept:
                    del held[hour]
                    touched.discard(hour)
                    self.hours.removeKey((hour,))
                elif len(kept) < len(held[hour][0]):
                    held[hour] = tuple(map(list, zip(*kept)))
                    touched.add(hour)
            for hour in touched:
                self.hours.updateValue((hour,), held[hour])
            if end != before:
                self.end.update((end,))
                if before is not None:
                    self.handle.deleteTimer(self._expiry(before))
                self.handle.registerTimer(self._expiry(end))
            times = pd.to_datetime([min(us for _, at in held.values() for us in at), end], unit="us")
            count = sum(len(at) for _, at in held.values())
            yield pd.DataFrame(
                {"case_id": [key[0]], "n_events": [count], "start_ts": times[:1], "end_ts": times[1:], "window_hours": pd.array([window_hours], "int32")}
            )

        def _expiry(self, end_us: int) -> int:
            """Milliseconds at which a watermark leaves nothing that could meet the window."""
            return (end_us + window_hours * HOUR_US) // 1000 + 1

        def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            if self.end.exists() and self._expiry(self.end.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
                self.hours.clear()
                self.end.clear()
            return iter(())

        def close(self) -> None:
            pass

    return WindowOfCase()


def windows_of(stream: DataFrame, window_hours: int = 24, lateness: str = "1 hour") -> DataFrame:
    """Stream of windows, one row per case that a batch touched; the newest row of a case counts.

    Events that break the contract are left out (see `bad_events`); those older than the watermark are dropped
    and counted by the query's progress.
    """
    require_columns(stream, ["case_id", "event_id", "ts"], "event stream")
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    narrow = checked_events(stream).select("case_id", "event_id", "ts").withWatermark("ts", lateness)
    return narrow.groupBy("case_id").transformWithStateInPandas(
        statefulProcessor=window_of_case(window_hours), outputStructType=WINDOW_SCHEMA, outputMode="Update", timeMode="EventTime"
    )


def start(
    spark: SparkSession, stream: DataFrame, folder: str, checkpoint: str, window_hours: int = 24, lateness: str = "1 hour",
    available_now: bool = False,
) -> StreamingQuery:
    """Keep the windows of all cases in the result store at `folder`; a restart goes on from `checkpoint`."""
    results = CaseResults(spark, folder, WINDOW_SCHEMA)
    writer = windows_of(stream, window_hours, lateness).writeStream.outputMode("update")
    writer = writer.foreachBatch(results.put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
