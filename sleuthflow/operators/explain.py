"""Case explanations: strongest features, sequence and graph factors, summary and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sleuthflow import catalog
from sleuthflow.functions.columns import clip01
from sleuthflow.operators.scoring import PROB_COLUMNS


def strongest_features(features: Column, k: int = 5) -> Column:
    """k entries with the largest absolute value; ties in catalog order, unknown names last by name."""
    names = F.array(*[F.lit(n) for n in catalog.FEATURES])

    def keyed(entry: Column) -> Column:
        at = F.array_position(names, entry["key"])
        return F.struct(
            (-F.abs(entry["value"])).alias("size"),
            F.when(at > 0, at).otherwise(F.lit(len(catalog.FEATURES) + 1)).alias("at"),
            entry["key"].alias("name"),
            entry["value"].alias("value"),
        )

    ranked = F.slice(F.sort_array(F.transform(F.map_entries(features), keyed)), 1, k)
    return F.transform(ranked, lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value")))


def strongest_typology() -> Column:
    """Most probable typology; the first in catalog order on a tie."""
    scored = [
        F.struct(F.col(PROB_COLUMNS[n]).alias("p"), F.lit(-i).alias("order"), F.lit(n).alias("name"))
        for i, n in enumerate(catalog.TYPOLOGIES)
    ]
    return F.array_max(F.array(*scored))["name"]


def _factors(pairs: dict[str, Column]) -> Column:
    return F.array(
        *[F.struct(F.lit(name).alias("name"), value.cast("double").alias("value")) for name, value in pairs.items()]
    )


def explain_cases(scored: DataFrame) -> DataFrame:
    """One explanation per wide score row (see `score_rollup`)."""
    c = F.col
    pattern = "Case %s has global risk %.3f (%s). Strongest typology: %s."
    return scored.select(
        *[name for name in ("request_id",) if name in scored.columns],
        "case_id",
        F.format_string(pattern, c("case_id"), c("global_risk"), c("risk_band"), strongest_typology()).alias("summary"),
        strongest_features(c("features")).alias("tabular_factors"),
        _factors(
            {
                "event_count": c("n_events"),
                "avg_delta_minutes": c("avg_delta_minutes"),
                "window_hours": c("window_hours"),
            }
        ).alias("sequence_factors"),
        _factors({"nodes": c("nodes"), "edges": c("edges"), "density": c("density")}).alias("graph_factors"),
        clip01(F.lit(0.55) + F.lit(0.35) * c("global_risk")).alias("confidence"),
    )
