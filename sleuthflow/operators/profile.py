"""Profiles with mergeable sketches: one row per group and day is stored, and any range of days is merged from it.

Rows, missing values, sums and bounds merge exactly. Distinct values are HyperLogLog sketches, whose relative
standard error is about 1.04 / sqrt(2 ** lg_k); quantiles are KLL sketches, whose rank error is about
2.3 / k ** 0.9 of the rows. Neither reads the rows again, and a stored day is small whatever its traffic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

LG_K, K = 12, 800


def distinct_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a number of distinct values."""
    return 1.04 / 2 ** (lg_k / 2)


def rank_error(k: int = K) -> float:
    """Share of the rows by which the rank of a quantile may be off, with 99 % confidence."""
    return 2.296 / k**0.9021


def daily_profile(
    rows: DataFrame, keys: list[str], time: str, distinct: list[str] = (), values: list[str] = (), lg_k: int = LG_K, k: int = K
) -> DataFrame:
    """One row per group of `keys` and day, to be stored.

    Per column of `distinct`: `_missing` and a sketch `_hll`. Per column of `values`: `_missing` (null or NaN),
    `_sum`, `_min`, `_max` and a sketch `_kll`. Sketches are partial aggregates, so a hot group is combined before
    the shuffle. Rows without a time belong to a day of their own, null.
    """
    found = {"n_rows": F.count("*")}
    for c in distinct:
        found |= {f"{c}_missing": F.count_if(F.col(c).isNull()), f"{c}_hll": F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k))}
    for c in values:
        x = F.col(c).cast("double")
        known = F.when(~F.isnan(x), x)
        found |= {
            f"{c}_missing": F.count_if(known.isNull()), f"{c}_sum": F.sum(known), f"{c}_min": F.min(known), f"{c}_max": F.max(known),
            f"{c}_kll": F.kll_sketch_agg_double(known, k),
        }
    return rows.groupBy(*keys, F.to_date(time).alias("day")).agg(*[column.alias(name) for name, column in found.items()])


def merged(
    profile: DataFrame, keys: list[str], distinct: list[str] = (), values: list[str] = (), quantiles: dict[str, float] | None = None
) -> DataFrame:
    """Days merged per group of `keys`, which may be columns or parts of a day that the caller adds.

    Per column of `distinct`: `_distinct`, the estimated number. Per column of `values`: its sum, bounds, and the
    named quantiles, by default `_median`. Groups without a known value have nulls there.
    """
    quantiles = {"median": 0.5} if quantiles is None else quantiles
    found = {"n_rows": F.sum("n_rows")}
    for c in distinct:
        found |= {f"{c}_missing": F.sum(f"{c}_missing"), f"{c}_distinct": F.hll_sketch_estimate(F.hll_union_agg(f"{c}_hll"))}
    for c in values:
        found |= {f"{c}_missing": F.sum(f"{c}_missing"), f"{c}_sum": F.sum(f"{c}_sum"), f"{c}_min": F.min(f"{c}_min"), f"{c}_max": F.max(f"{c}_max")}
        found[f"{c}_kll"] = F.kll_merge_agg_double(f"{c}_kll")
    whole = profile.groupBy(*keys).agg(*[column.alias(name) for name, column in found.items()])
    for c in values:
        known = F.col("n_rows") > F.col(f"{c}_missing")
        for name, p in quantiles.items():
            whole = whole.withColumn(f"{c}_{name}", F.when(known, F.kll_sketch_get_quantile_double(F.col(f"{c}_kll"), F.lit(p))))
        whole = whole.drop(f"{c}_kll")
    return whole
