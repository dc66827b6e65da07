"""Dataset checks: quality gate, class overlap, report, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sleuthflow import catalog
from sleuthflow.functions.columns import is_finite, require_columns
from sleuthflow.functions.ranking import exact_quantiles

LABEL_COLUMNS = ("label", "is_borderline")
LOW_P, HIGH_P = 0.05, 0.95


def class_overlap(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Overlap of the 5%..95% ranges of the two classes over their joint span, per feature.

    Quantiles are exact with linear interpolation; `approximate` takes sketches instead.
    """
    require_columns(df, [*catalog.FEATURES, "label"], "dataset")
    long = df.select("label", *[F.col(c).cast("double") for c in catalog.FEATURES]).unpivot(
        "label", catalog.FEATURES, "feature", "value"
    )
    finite = long.where(is_finite(F.col("value")))
    if approximate:
        sketch = F.percentile_approx("value", [LOW_P, HIGH_P])
        quantiles = finite.groupBy("feature", "label").agg(sketch.alias("q")).select(
            "feature", "label", F.posexplode("q").alias("_at", "q")
        ).withColumn("p", F.when(F.col("_at") == 0, F.lit(LOW_P)).otherwise(F.lit(HIGH_P)))
    else:
        quantiles = exact_quantiles(finite, ["feature", "label"], "value", [LOW_P, HIGH_P])

    def at(label: int, p: float) -> Column:
        return F.max(F.when((F.col("label") == label) & (F.col("p") == p), F.col("q")))

    wide = quantiles.groupBy("feature").agg(
        at(0, LOW_P).alias("low0"), at(0, HIGH_P).alias("high0"), at(1, LOW_P).alias("low1"), at(1, HIGH_P).alias("high1")
    )
    shared = F.greatest(F.lit(0.0), F.least("high0", "high1") - F.greatest("low0", "low1"))
    span = F.greatest("high0", "high1") - F.least("low0", "low1")
    return wide.withColumn("overlap_ratio", F.when(span == 0, F.lit(0.0)).otherwise(shared / span))


def dataset_report(df: DataFrame) -> DataFrame:
    """Rows, class and borderline shares and the two watched correlations, in one pass."""
    borderline = F.col("is_borderline").cast("double") if "is_borderline" in df.columns else F.lit(None).cast("double")
    return df.agg(
        F.count("*").cast("double").alias("rows"),
        F.avg(F.col("label").cast("double")).alias("pyramid_share"),
        F.avg(borderline).alias("borderline_share"),
        F.corr("referral_ratio", "growth_rate").alias("corr_referral_growth"),
        F.corr("centralization_index", "gini_coefficient").alias("corr_centralization_gini"),
    )


def quality_gate(
    df: DataFrame,
    borderline_target: float = catalog.BORDERLINE_TARGET,
    borderline_tolerance: float = catalog.BORDERLINE_TOLERANCE,
    min_correlation: float = catalog.MIN_CORRELATION,
    min_overlap: float = catalog.MIN_OVERLAP,
) -> DataFrame:
    """Report rows (check, value, ok). The borderline check runs only where the column exists."""
    require_columns(df, [*catalog.FEATURES, "label"], "dataset")
    numbers = [F.col(name).cast("double") for name in catalog.FEATURES]
    broken = [~is_finite(n) for n in numbers]
    any_broken = broken[0]
    for one in broken[1:]:
        any_broken = any_broken | one
    outside = [
        F.count_if((n < F.lit(low)) | (n > F.lit(high))).cast("double").alias(f"out_of_bounds:{name}")
        for n, (name, (low, high)) in zip(numbers, catalog.FEATURE_BOUNDS.items())
    ]
    checks = {"non_finite_rows": F.count_if(any_broken).cast("double")}
    aggregates = [column.alias(name) for name, column in checks.items()] + outside
    aggregates += [
        F.corr("referral_ratio", "growth_rate").alias("corr_referral_growth"),
        F.corr("centralization_index", "gini_coefficient").alias("corr_centralization_gini"),
        F.avg(F.col("label").cast("double")).alias("label_share"),
    ]
    if "is_borderline" in df.columns:
        aggregates.append(F.avg(F.col("is_borderline").cast("double")).alias("borderline_share"))
    whole = df.agg(*aggregates)
    rows = whole.select(
        F.inline(
            F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"`{name}`").alias("value")) for name in whole.columns])
        )
    )
    overlaps = class_overlap(df).select(
        F.concat(F.lit("overlap:"), "feature").alias("check"), F.col("overlap_ratio").alias("value")
    )
    name, value = F.col("check"), F.col("value")
    low, high = catalog.LABEL_SHARE_RANGE
    passed = (
        F.when(name.startswith("corr_"), value > F.lit(min_correlation))
        .when(name == "label_share", value.between(low, high))
        .when(name == "borderline_share", F.abs(value - F.lit(borderline_target)) <= F.lit(borderline_tolerance))
        .when(name.startswith("overlap:"), value > F.lit(min_overlap))
        .otherwise(value == 0)
    )
    return rows.unionByName(overlaps).withColumn("ok", F.coalesce(passed, F.lit(False)))


def assert_no_leakage(feature_names: list[str]) -> None:
    leaked = [name for name in feature_names if name in LABEL_COLUMNS]
    if leaked:
        raise ValueError(f"Data leakage: label columns among the features: {leaked}")


def leakage_check(train: DataFrame, test: DataFrame, key: str, feature_names: list[str]) -> DataFrame:
    """Report rows (check, value, ok): shared keys, non-finite features and label columns in the features."""
    shared = train.select(key).join(test.select(key), key, "left_semi").agg(F.count("*").cast("double").alias("value"))
    flags = [~is_finite(F.col(name)) for name in feature_names] + [F.col("label").isNull()]
    broken = flags[0]
    for flag in flags[1:]:
        broken = broken | flag
    both = train.unionByName(test)
    leaked = float(len([name for name in feature_names if name in LABEL_COLUMNS]))
    bad = both.agg(F.count_if(broken).cast("double").alias("value"), F.lit(leaked).alias("leaked"))
    rows = (
        shared.select(F.lit("shared_keys").alias("check"), "value")
        .unionByName(bad.select(F.lit("non_finite_rows").alias("check"), "value"))
        .unionByName(bad.select(F.lit("label_in_features").alias("check"), F.col("leaked").alias("value")))
    )
    return rows.withColumn("ok", F.col("value") == 0)
