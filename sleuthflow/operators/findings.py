"""Company findings: five banded statements and a conclusion, as bands and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sleuthflow.functions.columns import band, printed

# Band limits of the findings and of the conclusion.
RISING_LIMITS = {"physical": (60.0, 35.0), "crypto": (30.0, 10.0), "dependency": (0.8, 0.5), "concentration": (40.0, 25.0)}
HOLDING_LIMITS = (30.0, 60.0)
CONCLUSION_LIMITS = [(0.75, "priority_check"), (0.55, "deep_analysis"), (0.30, "monitoring")]

# Wording per finding: printf pattern of the value, then the sentence tail for red, yellow and green.
WORDING = {
    "physical": ("%.0f%% of inflow comes from private persons: ", "typical of deposit collecting", "above usual for a business", "normal for a business"),
    "crypto": ("%.1f%% of turnover passes through crypto exchanges: ", "heavy use of digital assets", "worth attention", "minimal"),
    "dependency": ("Payouts are %.2f of inflow: ", "they live off new money", "a notable dependency", "within limits"),
    "holding": ("Money stays %.0f active days: ", "fast pass-through", "shorter than usual", "ordinary turnover"),
    "concentration": ("The five largest counterparties carry %.0f%% of turnover: ", "a narrow circle", "somewhat concentrated", "well spread"),
}
CONCLUSIONS = {
    "priority_check": "structural signs of a crypto redistribution scheme; check first",
    "deep_analysis": "marked anomalies of a high-risk investment structure; analyse in depth",
    "monitoring": "moderate signs of risk; keep under monitoring",
    "no_action": "ordinary business activity; no priority check needed",
}


def _values() -> dict[str, Column]:
    return {
        "physical": F.col("physical_inflow_ratio") * 100,
        "crypto": F.col("crypto_exposure_ratio") * 100,
        "dependency": F.col("dependency_ratio"),
        "holding": F.col("avg_holding_time"),
        "concentration": F.col("concentration_index") * 100,
    }


def company_findings(
    metrics: DataFrame,
    risk: DataFrame,
    wording: dict[str, tuple[str, str, str, str]] = WORDING,
    conclusions: dict[str, str] = CONCLUSIONS,
) -> DataFrame:
    """One row per company: a band per finding, the conclusion and the narrative.

    `wording` and `conclusions` can be replaced to give the text in another language.
    """
    values = _values()
    bands = {
        name: band(values[name], [(red, "red"), (yellow, "yellow")], "green")
        for name, (red, yellow) in RISING_LIMITS.items()
    }
    red, yellow = HOLDING_LIMITS
    bands["holding"] = (
        F.when(values["holding"] < red, "red").when(values["holding"] < yellow, "yellow").otherwise("green")
    )
    ordered = list(values)
    lines = [
        F.concat(
            printed(wording[name][0], values[name]),
            F.when(bands[name] == "red", wording[name][1])
            .when(bands[name] == "yellow", wording[name][2])
            .otherwise(wording[name][3]),
        )
        for name in ordered
    ]
    verdict = band(F.col("probability"), CONCLUSION_LIMITS, "no_action")
    closing = F.coalesce(*[F.when(verdict == key, F.lit(text)) for key, text in conclusions.items()])
    head = F.concat(F.lit("Risk level "), F.col("risk_level"), printed(" (%.1f%%)", F.col("probability") * 100))
    subject = F.concat(F.lit("Company "), F.col("company_id").cast("string"), F.lit(": "), closing)
    return metrics.join(risk.select("company_id", "probability", "risk_level"), "company_id").select(
        "company_id",
        "probability",
        "risk_level",
        *[bands[name].alias(f"{name}_band") for name in ordered],
        verdict.alias("conclusion"),
        F.concat_ws("\n\n", head, *lines, subject).alias("narrative"),
    )
