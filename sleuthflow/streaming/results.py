"""Tables that grow by micro-batches and stay a few folders: a merged table and the batches since."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Batches that are read beside the merged table before they are merged into it.
MERGE_EVERY = 8


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


class BatchTable:
    """Rows of micro-batches in one folder per batch, merged now and then.

    Every `merge_every` batches, what `merge` makes of the merged table and the batches since becomes a new merged
    table, named after the last of them; it counts once it is complete. Folders are removed one merge after they
    were replaced, so that a reader of the table before can finish. A batch that runs again after a failure
    overwrites its folder, and is not read if a merged table holds it already, so that nothing counts twice, and
    at most 2 * merge_every + 2 folders are listed.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        schema: str | None,
        merge: Callable[[DataFrame], DataFrame] | None,
        merge_every: int = MERGE_EVERY,
        partition_by: list[str] = (),
    ) -> None:
        self.spark, self.folder, self.schema, self.merge = spark, folder, schema, merge
        self.merge_every, self.partition_by = merge_every, list(partition_by)

    def _path(self, path: str):
        held = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return held, held.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folders(self, kind: str) -> list[int]:
        """Numbers of complete folders of a kind, rising."""
        root, files = self._path(self.folder)
        if not files.exists(root):
            return []
        names = [s.getPath().getName() for s in files.listStatus(root) if s.isDirectory()]
        numbers = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
        return sorted(n for n in numbers if files.exists(self._path(f"{self.folder}/{kind}={n}/_SUCCESS")[0]))

    def _remove(self, kind: str, number: int) -> None:
        path, files = self._path(f"{self.folder}/{kind}={number}")
        files.delete(path, True)

    def read(self) -> DataFrame | None:
        """Rows of the last merged table and the batches behind it, with `_batch`; None before the first batch."""
        merged = self.folders("merged")
        base = merged[-1] if merged else -1
        parts = ([("merged", base)] if merged else []) + [("batch", n) for n in self.folders("batch") if n > base]
        self.schema = self.schema or self._found_schema(parts)
        return reduce(DataFrame.unionByName, [self.one(kind, n) for kind, n in parts]) if self.schema and parts else None

    def _found_schema(self, parts: list[tuple[str, int]]) -> str | None:
        """Schema that an earlier run wrote; a folder without rows may not tell it."""
        for kind, n in reversed(parts):
            try:
                return _ddl(self.spark.read.parquet(f"{self.folder}/{kind}={n}"))
            except AnalysisException:
                continue
        return None

    def one(self, kind: str, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{kind}={number}").withColumn("_batch", F.lit(number))

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.write.mode("overwrite").partitionBy(*self.partition_by).parquet(f"{self.folder}/{kind}={number}")

    def holds(self, number: int) -> bool:
        """Whether a merged table holds this batch."""
        merged = self.folders("merged")
        return bool(merged) and number <= merged[-1]

    def add(self, batch: DataFrame, number: int) -> None:
        if not self.holds(number):
            self._write(batch, "batch", number)
            self.schema = self.schema or _ddl(batch)

    def tidy(self, number: int) -> None:
        """Merge if enough batches have come since the last time."""
        merged = self.folders("merged")
        if self.merge is None or number - (merged[-1] if merged else -1) < self.merge_every:
            return
        self._write(self.merge(self.read()).drop("_batch"), "merged", number)
        for n in merged[:-1]:
            self._remove("merged", n)
        for n in [n for n in self.folders("batch") if merged and n <= merged[-1]]:
            self._remove("batch", n)


def newest(rows: DataFrame, key: str = "case_id") -> DataFrame:
    """Row of the highest `_batch` of every case."""
    columns = [c for c in rows.columns if c not in (key, "_batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_batch").alias("_row")).select(key, "_row.*")


class CaseResults(BatchTable):
    """Newest result of every case. With `keep_hours`, cases that ended so long before the newest end are dropped."""

    def __init__(
        self, spark: SparkSession, folder: str, schema: str | None = None, merge_every: int = MERGE_EVERY, keep_hours: int | None = None
    ) -> None:
        def merge(rows: DataFrame) -> DataFrame:
            found = newest(rows)
            last = found.agg(F.max("end_ts")).first()[0] if keep_hours is not None else None
            if last is None:
                return found
            return found.where(F.col("end_ts") >= F.lit(last) - F.expr(f"INTERVAL {int(keep_hours)} HOURS"))

        super().__init__(spark, folder, schema, merge, merge_every)

    def put(self, batch: DataFrame, number: int) -> None:
        self.add(batch, number)
        self.tidy(number)

    def latest(self) -> DataFrame:
        """Newest row of every case; no rows before the first batch."""
        rows = self.read()
        return newest(rows) if rows is not None else self.spark.createDataFrame([], self.schema or "case_id string")
