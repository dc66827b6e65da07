"""Queries on the fitted model, over transfers of our own."""

from datetime import timedelta

import pytest
from samples import NOON

from sleuthflow import catalog
from sleuthflow.operators import ml
from sleuthflow.plans import registry, views


def log(spark):
    links = [(f"C{c}", f"S{(c * 7 + k) % 23}", float(10 + c * k % 90), NOON + timedelta(days=k)) for c in range(60) for k in range(1, 13)]
    links += [(receiver, sender, amount / 2, at) for sender, receiver, amount, at in links if amount > 60]
    rows = spark.createDataFrame(links, "sender_id string, receiver_id string, amount double, timestamp timestamp")
    return rows.withColumn("amount", rows.amount.cast(views.MONEY))


@pytest.fixture
def reads(spark, monkeypatch):
    """Number of times that a query derived the transfers; fits take two trees."""
    counted, fit = [], ml.train_risk_model

    def transfers(spark, sf_dir):
        counted.append(sf_dir)
        return log(spark)

    monkeypatch.setattr(views, "transfers", transfers)
    monkeypatch.setattr(ml, "train_risk_model", lambda train: fit(train, trees=2))
    monkeypatch.setattr(registry, "_fitted", {})
    return counted


@pytest.mark.parametrize("name", ["train_risk_model", "predict_risk", "predict_from_ops", "risk_contributions", "risk_from_nodes"])
def test_the_log_is_read_once(spark, reads, name):
    found = getattr(registry, name)(spark, "any").collect()
    assert len(reads) == 1
    assert len(found) >= 1
    if name in ("predict_risk", "risk_from_nodes"):
        assert len(found) == views.features(spark, "any").count()
        assert all(0 <= r.probability <= 1 for r in found)


def test_facts_for_scores_and_fit_agree(spark, reads):
    """The model on facts at hand is the one on facts derived anew."""
    by_ops = {r.entity_id: r.probability for r in registry.predict_from_ops(spark, "any").collect()}
    assert {r.entity_id: r.probability for r in registry.predict_risk(spark, "any").collect()} == by_ops
    assert len(registry._fitted) == 1
    features = views.features(spark, "any")
    assert set(features.columns) == {"entity_id", *catalog.FEATURES}
