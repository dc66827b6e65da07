import pytest
from pyspark.sql import functions as F
from samples import chain_case, events_frame, features_frame, ops_frame
from test_quality import population

from sleuthflow import catalog
from sleuthflow.operators import ml, scoring
from sleuthflow.sources import sinks


@pytest.fixture(scope="module")
def model(spark):
    return ml.train_risk_model(population(spark, 300), trees=4)


def test_predictions_and_quarantine(spark, model):
    rows = features_frame(spark).union(features_frame(spark, "bad", growth_rate=9.0))
    found = {r.entity_id: r for r in ml.predict_risk(model, rows).collect()}
    assert 0 <= found["k"].probability <= 1
    assert found["k"].label_text in {"Low", "Medium", "High"}
    assert found["k"].threshold_policy == "fixed_0.4_0.7"
    assert found["k"].threshold_values == {"medium": 0.4, "high": 0.7}
    assert (found["bad"].probability, found["bad"].label_text, found["bad"].growth_rate) == (None, None, 9.0)
    assert found["bad"].reason.startswith("Feature 'growth_rate' out of range")


def test_predict_from_operational_facts(spark, model):
    ops = ops_frame(spark).withColumn("id", F.lit("a")).union(ops_frame(spark, tx_count_total=1.0).withColumn("id", F.lit("b")))
    scored, rejected = ml.predict_from_ops(model, ops, "id")
    assert [r.id for r in scored.collect()] == ["a"]
    assert scored.first().gini_coefficient == pytest.approx(0.535)
    assert [r.id for r in rejected.collect()] == ["b"]


def test_importances(spark, model):
    table = ml.feature_importances(model)
    assert table.count() == 9
    assert table.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    top = [r.importance for r in ml.feature_importances(model, 3).collect()]
    assert len(top) == 3 and top == sorted(top, reverse=True)
    with pytest.raises(ValueError):
        ml.feature_importances(model, 10)


def test_model_round_trip_keeps_feature_order(spark, model, tmp_path):
    sinks.save_model(model, str(tmp_path / "model"))
    again = sinks.load_model(str(tmp_path / "model"))
    assert sinks.feature_order(again) == catalog.FEATURES
    rows = features_frame(spark)
    assert ml.predict_risk(again, rows).first().probability == ml.predict_risk(model, rows).first().probability


def test_cases_scored_with_a_model(spark, model):
    wide = scoring.score_rollup(scoring.rollup_of(events_frame(spark, chain_case())), model=model).first()
    assert wide.features["payout_dependency"] == 1.0
    values = {n: wide.features[n] for n in catalog.FEATURES}
    expected = ml.predict_risk(model, features_frame(spark, **values)).first().probability
    assert wide.tabular_score == pytest.approx(expected)


def test_leaking_features_stop_the_fit(spark):
    with pytest.raises(ValueError, match="leakage"):
        ml.train_risk_model(population(spark, 50), [*catalog.FEATURES, "label"], trees=1)


def test_population_map(spark):
    rows = population(spark, 200)
    fitted = ml.fit_population_map(rows)
    projected = fitted.project(rows)
    assert {"PCA1", "PCA2", "label", "is_borderline"} <= set(projected.columns)
    stats = projected.agg(F.avg("PCA1").alias("m"), F.var_pop("PCA1").alias("v1"), F.var_pop("PCA2").alias("v2")).first()
    assert stats.m == pytest.approx(0, abs=1e-9)
    assert stats.v1 >= stats.v2 > 0
    # Standardised by the population deviation, each axis varies by its share of the nine units of variance.
    assert stats.v1 == pytest.approx(9 * float(fitted.model.stages[-1].explainedVariance[0]))
    new = fitted.project(features_frame(spark)).first()
    assert new.PCA1 is not None
    layers = {r.layer: r.n for r in ml.layer_summary(ml.population_layers(projected)).collect()}
    assert layers == {"legit": 100, "pyramid": 100, "borderline": 30}
    with pytest.raises(ValueError):
        ml.fit_population_map(rows, catalog.FEATURES[::-1])
