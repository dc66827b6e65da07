"""Structured Streaming: hopping case windows, and trailing windows kept exact batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sleuthflow.functions.columns import require_columns
from sleuthflow.operators.contracts import check_events
from sleuthflow.streaming.results import MERGE_EVERY, BatchTable, CaseResults


def checked_events(stream: DataFrame) -> DataFrame:
    """Events of a stream that keep the contract."""
    return check_events(stream).where(F.col("reason").isNull()).drop("reason")


def good_events(stream: DataFrame, lateness: str) -> DataFrame:
    """Checked events of a stream, each event id of a case once within the lateness allowed.

    Cases number their events alike, so the event id alone does not name an event.

    An event older than the watermark is late and is dropped; the progress of the query counts them
    (`numRowsDroppedByWatermark`).
    """
    checked = checked_events(stream)
    named = [c for c in ("case_id", "event_id") if c in checked.columns]
    return checked.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(named)


def bad_events(stream: DataFrame) -> DataFrame:
    """Events of a stream that break the contract, with the reason; they fail their case as in a batch.

    `pos`, the place of an event in its input, is kept if there is one: the first error of a case is the first by it.
    """
    checked = check_events(stream)
    place = F.col("pos") if "pos" in checked.columns else F.lit(None)
    return checked.where(F.col("reason").isNotNull()).select("case_id", place.cast("bigint").alias("pos"), "event_id", "reason")


def hopping_case_windows(
    stream: DataFrame, window: str = "24 hours", hop: str = "1 hour", lateness: str = "1 hour"
) -> DataFrame:
    """Live view per case and hopping window. Windows stand on the clock, not on the latest event of a case."""
    require_columns(stream, ["case_id", "event_id", "ts", "amount"], "event stream")
    return (
        good_events(stream, lateness)
        .groupBy("case_id", F.window("ts", window, hop))
        .agg(
            F.count("*").alias("n_events"),
            F.sum("amount").alias("amount_total"),
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
            F.count_if(F.col("channel") == "crypto").alias("crypto_events"),
        )
        .select("case_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "n_events", "amount_total", "start_ts", "end_ts", "crypto_events")
    )


class TrailingCases:
    """Exact trailing windows on a stream.

    Each micro-batch adds its events to a log by batch and day, then recomputes the cases it touched
    from that log with the batch operators, so hot cases are split as they are there. A trailing window
    reaches back `window_hours` from the latest event of its case, so only days from `window_hours`
    before the oldest event of the batch are read. An event later than everything in the batch is already in
    the log and is read too; late events simply recompute their case.

    With `keep_hours`, the log is merged every few batches and holds events no older than that before the newest one:
    a trigger then lists the days that are kept in a bounded number of folders. It must cover the window and
    the lateness allowed, or late events lose what their window needs. Without it, the log keeps everything.

    A batch writes to folders named after its number and overwrites them if it runs again, so a restart
    after a lost executor or driver does not count anything twice.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        compute: Callable[[DataFrame], DataFrame],
        window_hours: int = 24,
        keep_hours: int | None = None,
        merge_every: int = MERGE_EVERY,
    ) -> None:
        if keep_hours is not None and keep_hours < window_hours:
            raise ValueError("keep_hours must cover window_hours.")
        self.spark, self.folder, self.compute, self.window_hours = spark, folder, compute, window_hours
        self.results = CaseResults(spark, f"{folder}/cases", merge_every=merge_every)

        def kept(rows: DataFrame) -> DataFrame:
            return rows.where(F.col("event_date") >= F.lit((self.newest - timedelta(hours=keep_hours)).date()))

        self.log = BatchTable(spark, f"{folder}/log", None, kept if keep_hours is not None else None, merge_every, ["event_date"])
        self.newest = self._newest_day()

    def _newest_day(self) -> datetime | None:
        """Latest event of an earlier run, so that a restart reads as far as it has to."""
        rows = self.log.read()
        return rows.agg(F.max("ts")).first()[0] if rows is not None else None

    def _log(self, first: date, last: date) -> DataFrame:
        """Events of the days from `first` to `last`; the files of other days are not read."""
        return self.log.read().where(F.col("event_date").between(F.lit(first), F.lit(last)))

    def _batch(self, batch: DataFrame, number: int) -> None:
        # A batch that runs again overwrites its own folder only.
        self.log.add(batch.withColumn("event_date", F.to_date("ts")), number)
        if self.log.holds(number):
            return
        added = self.log.one("batch", number)
        oldest, newest = added.agg(F.min("ts"), F.max("ts")).first()
        if oldest is None:
            return
        self.newest = max(newest, self.newest or newest)
        log = self._log((oldest - timedelta(hours=self.window_hours)).date(), self.newest.date())
        touched = log.join(added.select("case_id").distinct(), "case_id", "left_semi").drop("event_date", "_batch")
        self.results.put(self.compute(touched), number)
        self.log.tidy(number)

    def start(self, events: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
        return writer.start()

    def start_quarantine(self, bad: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """Keep events that break the contract; their cases leave `latest` and appear in `failures`."""

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.folder}/bad/batch={number}")

        writer = bad.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
        return writer.start()

    def failures(self) -> DataFrame:
        """One row per case with a bad event: the first of its reasons by input place, then event id."""
        path = f"{self.folder}/bad"
        try:
            bad = self.spark.read.option("basePath", path).parquet(path)
        except AnalysisException:
            return self.spark.createDataFrame([], "case_id string, error string")
        first = F.min(F.struct(F.col("pos").isNull().alias("unplaced"), "pos", "event_id", "reason"))["reason"]
        return bad.groupBy("case_id").agg(first.alias("error"))

    def latest(self) -> DataFrame:
        """Newest result of every case without bad events."""
        return self.results.latest().join(self.failures(), "case_id", "left_anti")
