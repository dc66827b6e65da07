"""Case scores: three branches, their fusion, typologies, and the batch run with failure isolation."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from sleuthflow import catalog
from sleuthflow.functions.columns import at_least, band, clip01, sigmoid, strip
from sleuthflow.operators.cases import (
    case_bounds,
    case_facts,
    case_rollup,
    edges_of,
    small_parts,
    window_events,
    with_operational,
    within,
)
from sleuthflow.operators.contracts import check_events, check_features
from sleuthflow.operators.entity import feature_columns
from sleuthflow.operators.graph import case_shape, graph_columns
from sleuthflow.operators.ml import predict_risk
from sleuthflow.session import materialize

PROB_COLUMNS = {name: f"p_{name.lower()}" for name in catalog.TYPOLOGIES}
LABEL_COLUMNS = {name: f"is_{name.lower()}" for name in catalog.TYPOLOGIES}


def tabular_proxy(features: dict[str, Column] | None = None) -> Column:
    """Stand-in for a fitted model: a weighted sum of three features, missing ones counted as 0."""
    get = (lambda name: features[name]) if features else F.col
    weights = {"growth_rate": 0.35, "payout_dependency": 0.35, "centralization_index": 0.30}
    terms = [F.coalesce(get(name), F.lit(0.0)) * F.lit(w) for name, w in weights.items()]
    return clip01(terms[0] + terms[1] + terms[2])


def sequence_score() -> Column:
    """From events per hour and the share of short gaps."""
    rate = F.col("n_events").cast("double") / F.col("span_hours")
    return clip01(sigmoid(F.lit(0.55) * rate + F.lit(2.1) * F.col("gap_density") - F.lit(1.8)))


def graph_score() -> Column:
    """From hub share, density and the number of components; 0 for a case without nodes."""
    joined = F.when(F.col("components") <= 2, F.lit(0.3)).otherwise(F.lit(-0.1))
    raw = F.lit(1.8) * F.col("hub_share") + F.lit(1.1) * F.col("density") + joined
    return F.when(F.col("nodes") > 0, clip01(sigmoid(raw))).otherwise(F.lit(0.0))


def fused_risk() -> Column:
    return clip01(
        F.lit(0.58) * F.col("tabular_score")
        + F.lit(0.22) * F.col("sequence_score")
        + F.lit(0.20) * F.col("graph_score")
    )


def typology_labels() -> dict[str, Column]:
    """0/1 per typology, over the per-case facts, small parts and walk depth."""
    c = F.col
    legal_events = c("events") - c("crypto_events")
    paid_share = c("amount_paid") / at_least(c("amount_total"), 1.0)
    third = F.floor(c("events") / F.lit(3))
    rules = {
        "LEGAL_LAYERING": (c("walk_depth") >= 4) & (legal_events >= 3),
        "LEGAL_TO_CRYPTO_BRIDGE": (legal_events > 0) & (c("crypto_events") > 0),
        "CRYPTO_MIXING": (c("crypto_events") >= 6) & (c("crypto_receivers") >= 4),
        "STRUCTURED_SPLITTING": (c("receivers") >= 5) & (c("small_parts") >= F.greatest(F.lit(4), third)),
        "CASH_OUT": (paid_share >= F.lit(0.62)) & (c("events") >= 6),
    }
    return {name: rules[name].cast("int") for name in catalog.TYPOLOGIES}


def typology_probs() -> dict[str, Column]:
    """Probability per typology: base plus weighted branch scores plus a boost where the label is set."""
    # Branch weights (tabular, sequence, graph) of each typology.
    weights = {
        "LEGAL_LAYERING": (0.25, 0.0, 0.55),
        "LEGAL_TO_CRYPTO_BRIDGE": (0.35, 0.45, 0.0),
        "CRYPTO_MIXING": (0.0, 0.25, 0.55),
        "STRUCTURED_SPLITTING": (0.35, 0.40, 0.0),
        "CASH_OUT": (0.45, 0.25, 0.0),
    }
    branches = [F.col("tabular_score"), F.col("sequence_score"), F.col("graph_score")]
    probs = {}
    for name in catalog.TYPOLOGIES:
        score = F.lit(0.20) + F.lit(0.35) * F.col(LABEL_COLUMNS[name])
        for weight, branch in zip(weights[name], branches):
            if weight:
                score = score + F.lit(weight) * branch
        probs[name] = clip01(score)
    return probs


def rollup_of(
    events: DataFrame, window_hours: int = 24, cases: DataFrame | None = None
) -> DataFrame:
    """Window the events and aggregate them once; every branch reads the result."""
    return materialize(case_rollup(window_events(events, window_hours, cases)), "case-rollup")


def labeled_cases(rollup: DataFrame) -> DataFrame:
    """All per-case facts plus the five typology labels."""
    facts = (
        case_facts(rollup)
        .join(small_parts(rollup), "case_id")
        .join(case_shape(edges_of(rollup)), "case_id")
    )
    return facts.withColumns({LABEL_COLUMNS[n]: column for n, column in typology_labels().items()})


def with_features(facts: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Per-case facts plus a feature map: the supplied one if it has entries, else the derived features."""
    entries = [part for name, column in feature_columns().items() for part in (F.lit(name), column)]
    derived = with_operational(facts).withColumn("features", F.create_map(*entries))
    if cases is None or "tabular_features" not in cases.columns:
        return derived
    own = cases.select("case_id", "tabular_features").dropDuplicates(["case_id"])
    supplied = F.when(F.size("tabular_features") > 0, F.col("tabular_features"))
    return (
        derived.join(own, "case_id", "left")
        .withColumn("features", F.coalesce(supplied, F.col("features")))
        .drop("tabular_features")
    )


def _with_tabular(featured: DataFrame, model: PipelineModel | None) -> DataFrame:
    values = {name: F.col("features")[name] for name in catalog.FEATURES}
    if model is None:
        return featured.withColumn("tabular_score", tabular_proxy(values))
    scored = predict_risk(model, featured.withColumns(values))
    bad = F.raise_error(F.concat(F.lit("case "), F.col("case_id"), F.lit(": "), F.col("reason")))
    score = F.when(F.col("reason").isNull(), F.col("probability")).otherwise(bad)
    return scored.withColumn("tabular_score", score).drop(
        "reason", "probability", "label_text", "threshold_policy", "threshold_values", *catalog.FEATURES
    )


def score_rollup(
    rollup: DataFrame, cases: DataFrame | None = None, model: PipelineModel | None = None
) -> DataFrame:
    """Branch scores, fused risk, band, labels and typology probabilities, one wide row per case."""
    featured = with_features(labeled_cases(rollup), cases)
    return (
        _with_tabular(featured, model)
        .withColumns(graph_columns())
        .withColumns({"sequence_score": sequence_score(), "graph_score": graph_score()})
        .withColumn("global_risk", fused_risk())
        .withColumns({PROB_COLUMNS[n]: column for n, column in typology_probs().items()})
        .withColumn("risk_band", band(F.col("global_risk"), catalog.CASE_BANDS, "LOW"))
    )


def as_output(
    wide: DataFrame,
    model_version: str = catalog.MODEL_VERSION,
    calibration_version: str = catalog.CALIBRATION_VERSION,
) -> DataFrame:
    entries = [part for name in catalog.TYPOLOGIES for part in (F.lit(name), F.col(PROB_COLUMNS[name]))]
    return wide.select(
        "case_id",
        "global_risk",
        F.create_map(*entries).alias("typology_probs"),
        "risk_band",
        F.lit(model_version).alias("model_version"),
        F.lit(calibration_version).alias("calibration_version"),
        F.lit(True).alias("explanation_ready"),
    )


def score_cases(
    events: DataFrame,
    window_hours: int = 24,
    cases: DataFrame | None = None,
    model: PipelineModel | None = None,
    **versions: str,
) -> DataFrame:
    """Score every case of already checked events. Without a model the tabular branch uses the proxy."""
    return as_output(score_rollup(rollup_of(events, window_hours, cases), cases, model), **versions)


def _bad_features(cases: DataFrame) -> DataFrame:
    """Cases whose supplied features a model would refuse, with the reason."""
    given = cases.where(F.size("tabular_features") > 0).dropDuplicates(["case_id"])
    wide = given.select("case_id", *[F.col("tabular_features")[n].alias(n) for n in catalog.FEATURES])
    bad = check_features(wide).where(F.col("reason").isNotNull())
    return bad.select("case_id", F.col("reason").alias("feature_error"))


def score_batch(
    events: DataFrame,
    window_hours: int = 24,
    cases: DataFrame | None = None,
    model: PipelineModel | None = None,
    order_by: str = "pos",
    detail: bool = False,
    **versions: str,
) -> tuple[DataFrame, DataFrame]:
    """(scores, failures): a bad event fails its case only, all others are scored.

    The error of a case is that of its first bad event in input order. It is found in the same
    aggregate as the end of the case, so failed cases leave with the window join and the raw events
    are shuffled once.

    With a `request_id` in `events` and `cases` every request is a case of its own, whatever its case id; both
    results then have the column too. With `detail` the scores are the wide rows that `explain_cases` takes, so
    that a batch is scored once for both.
    """
    if "request_id" in events.columns and cases is not None and "request_id" in cases.columns:
        names = cases.select("request_id", "case_id")
        apart = [
            df.select(F.col("request_id").alias("case_id"), *[c for c in df.columns if c not in ("case_id", "request_id")])
            for df in (events, cases)
        ]
        scores, failures = score_batch(apart[0], window_hours, apart[1], model, order_by, detail, **versions)
        by_request = [r.withColumnRenamed("case_id", "request_id").join(names, "request_id") for r in (scores, failures)]
        return by_request[0], by_request[1]
    trimmed = strip("case_id")
    named = events.withColumn("case_id", F.when(trimmed != "", trimmed).otherwise(F.lit("unknown-case")))
    checked = check_events(named)
    bounds = case_bounds(checked, window_hours, cases, error_order=order_by)
    hours = F.col("window_hours")
    bad_window = F.when(hours <= 0, "window_hours must be > 0.").when(
        hours > catalog.MAX_WINDOW_HOURS, f"window_hours must be <= {catalog.MAX_WINDOW_HOURS}."
    )
    judged = bounds.withColumn("error", F.coalesce(bad_window, F.col("error")))
    if model is not None and cases is not None and "tabular_features" in cases.columns:
        judged = (
            judged.join(_bad_features(cases), "case_id", "left")
            .withColumn("error", F.coalesce("error", "feature_error"))
            .drop("feature_error")
        )
    failures = judged.where(F.col("error").isNotNull()).select("case_id", "error")
    if cases is not None:
        empty = cases.select("case_id").distinct().join(bounds, "case_id", "left_anti")
        failures = failures.unionByName(empty.withColumn("error", F.lit("events cannot be empty.")))
    good = judged.where(F.col("error").isNull()).drop("error")
    rollup = materialize(case_rollup(within(checked.drop("reason"), good)), "case-rollup")
    wide = score_rollup(rollup, cases, model)
    return (wide if detail else as_output(wide, **versions)), failures


def alert_queue(scored: DataFrame, key: str, risk: str, k: int, dossier: DataFrame | None = None) -> DataFrame:
    """The k riskiest subjects in order, with their dossier columns if given."""
    top = scored.orderBy(F.desc(risk), F.asc(key)).limit(k)
    if dossier is None:
        return top
    return top.join(dossier, key, "left").orderBy(F.desc(risk), F.asc(key))
