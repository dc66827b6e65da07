"""Sinks: datasets, reports and fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_dataset(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Write as CSV (with header), JSON lines or Parquet, chosen by the suffix of `path`."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    name = path.rstrip("/").lower()
    if name.endswith(".csv"):
        writer.option("header", True).csv(path)
    elif name.endswith(".json"):
        writer.json(path)
    elif name.endswith(".parquet"):
        writer.parquet(path)
    else:
        raise ValueError(f"Unsupported file format: {path}. Expected .csv, .json or .parquet")


def write_by_date(df: DataFrame, path: str, ts: str, mode: str = "append") -> None:
    """Parquet partitioned by day, so later readers prune by date.

    Rows of a day are brought together first, and a long day is split again, so that files follow the data and
    not the number of tasks.
    """
    dated = df.withColumn("event_date", F.to_date(ts)).hint("rebalance", "event_date")
    dated.write.mode(mode).partitionBy("event_date").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_order(model: PipelineModel) -> list[str]:
    """Feature names in the order the model was fitted with (kept in its assembler stage)."""
    return model.stages[0].getInputCols()


def save_report(spark: SparkSession, report: DataFrame, path: str) -> None:
    """Metrics or importances as JSON lines."""
    report.write.mode("overwrite").json(path)
