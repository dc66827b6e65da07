"""Exact and cheap sums of money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def minor_units(df: DataFrame, name: str) -> tuple[Column, float]:
    """(`name` in whole minor units, units per 1) for an exact decimal; other types stay as they are.

    Sums of longs are exact like those of decimals, do not depend on row order, and cost a fraction of
    sums of decimals wider than 18 digits. An overflow raises an error under the default ANSI mode.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.DecimalType) and kind.scale <= 4 and kind.precision <= 18:
        return (F.col(name) * F.lit(10**kind.scale)).cast("bigint"), float(10**kind.scale)
    return F.col(name), 1.0


def in_money(units: Column, per_one: float) -> Column:
    """Units as a double amount; the division rounds once."""
    return units.cast("double") / F.lit(per_one)
