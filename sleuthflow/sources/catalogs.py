"""Catalogs as small tables, and the state of the scoring engine."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from sleuthflow import catalog


def bounds_table(spark: SparkSession) -> DataFrame:
    """Bounds of the features and of the operational facts, in catalog order."""
    kinds = {"feature": catalog.FEATURE_BOUNDS, "operational": catalog.OPERATIONAL_BOUNDS}
    rows = [
        (kind, place, name, low, high)
        for kind, bounds in kinds.items()
        for place, (name, (low, high)) in enumerate(bounds.items())
    ]
    return spark.createDataFrame(rows, "kind string, place int, name string, low double, high double")


def thresholds_table(spark: SparkSession) -> DataFrame:
    """Lowest score of every band of the three scales."""
    scales = {"model": catalog.MODEL_BANDS, "company": catalog.COMPANY_BANDS, "case": catalog.CASE_BANDS}
    rows = [(scale, name, limit) for scale, bands in scales.items() for limit, name in bands]
    return spark.createDataFrame(rows, "scale string, band string, at_least double")


def typologies_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(catalog.TYPOLOGIES)), "place int, typology string")


def seen_ranges(df: DataFrame, kind: str) -> DataFrame:
    """Catalog rows of `kind` next to the smallest and largest value of their column in `df`."""
    bounds = bounds_table(df.sparkSession).where(F.col("kind") == kind)
    names = catalog.FEATURES if kind == "feature" else catalog.OPERATIONAL
    long = df.select(*[F.col(c).cast("double") for c in names]).unpivot([], names, "name", "value")
    seen = long.groupBy("name").agg(F.min("value").alias("seen_low"), F.max("value").alias("seen_high"))
    # A catalog has at most a dozen rows.
    return seen.join(F.broadcast(bounds), "name").select("kind", "name", "low", "high", "seen_low", "seen_high")


def engine_status(
    model: PipelineModel | None,
    model_version: str = catalog.MODEL_VERSION,
    calibration_version: str = catalog.CALIBRATION_VERSION,
) -> dict[str, object]:
    return {
        "status": "ok",
        "tabular_model_loaded": model is not None,
        "model_version": model_version,
        "calibration_version": calibration_version,
    }
