import pytest
from samples import NOON, OPERATIONAL_ROW, features_frame, log_frame, ops_frame

from sleuthflow import catalog
from sleuthflow.operators import contracts, entity


def test_entity_facts_of_the_three_row_log(spark):
    row = entity.entity_operational(log_frame(spark)).where("entity_id = 'B'").first().asDict()
    expected = {
        "tx_count_total": 3,
        "unique_counterparties": 4,
        "new_clients_current": 2,
        "new_clients_previous": 1,
        "referred_clients_current": 0,
        "incoming_funds": 350,
        "payouts_total": 80,
        "top1_wallet_share": 250 / 350,
        "top10_wallet_share": 1,
        "avg_holding_days": 30,
        "repeat_investor_share": 0.2,
        "max_referral_depth": 3,
    }
    assert row["entity_id"] == "B"
    for name, value in expected.items():
        assert row[name] == pytest.approx(value), name


def test_entity_without_inflow_gets_default_clients(spark):
    row = entity.entity_operational(log_frame(spark)).where("entity_id = 'A'").first()
    assert (row.new_clients_current, row.new_clients_previous, row.incoming_funds) == (10, 8, 0)


def test_self_transfer_is_one_transfer_but_two_flows(spark):
    log = log_frame(spark).limit(0).union(
        spark.createDataFrame([("E", "E", 5.0, None)], log_frame(spark).schema)
    )
    row = entity.entity_operational(log).first()
    assert (row.tx_count_total, row.unique_counterparties, row.incoming_funds, row.payouts_total) == (1, 1, 5, 5)


def test_whole_log_counts_everything_as_inflow(spark):
    row = entity.log_operational(log_frame(spark)).first()
    assert (row.tx_count_total, row.unique_counterparties, row.incoming_funds, row.payouts_total) == (3, 4, 430, 0)
    assert row.new_clients_current == 3
    assert row.top1_wallet_share == pytest.approx(250 / 430)


def test_missing_columns_fail_at_plan_time(spark):
    with pytest.raises(ValueError, match="Missing columns"):
        entity.entity_operational(log_frame(spark).drop("timestamp"))


def test_features_of_the_operational_row(spark):
    row = entity.operational_to_features(ops_frame(spark), keep=[]).first()
    expected = [0.25, 0.2, 0.25, 0.25, 30, 0.4, 0.535, 3.309447, 4]
    assert [row[n] for n in catalog.FEATURES] == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize(
    ("changes", "reason"),
    [
        ({}, None),
        ({"tx_count_total": 3.0}, "Operational field 'tx_count_total' out of range [10.0, 2000000.0]: 3.0"),
        ({"payouts_total": float("nan")}, "Operational field 'payouts_total' out of range [0.0, 10000000000.0]: nan"),
        ({"referred_clients_current": 91.0}, "referred_clients_current cannot exceed new_clients_current."),
        ({"top1_wallet_share": 0.6}, "top1_wallet_share cannot exceed top10_wallet_share."),
    ],
)
def test_operational_contract(spark, changes, reason):
    assert contracts.check_ops(ops_frame(spark, **changes)).first().reason == reason


def test_clamp_policy_keeps_the_row(spark):
    row = contracts.clamp_ops(ops_frame(spark, tx_count_total=3.0, avg_holding_days=900.0)).first()
    assert (row.tx_count_total, row.avg_holding_days) == (10, 365)
    assert row.incoming_funds == OPERATIONAL_ROW["incoming_funds"]


def test_feature_contract(spark):
    assert contracts.check_features(features_frame(spark)).first().reason is None
    bad = contracts.check_features(features_frame(spark, growth_rate=float("nan"))).first()
    assert bad.reason == "Feature 'growth_rate' out of range [0.0, 1.2]: nan"


def test_both_directions_of_a_pair_are_one_shuffled_row(spark):
    rows = [("A", "B", 10.0), ("B", "A", 4.0), ("A", "B", 1.0), ("A", "A", 5.0), ("A", "A", 2.0), (None, "A", 3.0), ("A", None, 7.0), (None, None, 9.0), ("B", "C", None)]
    log = spark.createDataFrame([(*r, NOON) for r in rows], "sender_id string, receiver_id string, amount double, timestamp timestamp")
    totals = entity.counterparty_totals(log)
    found = {(r.entity_id, r.counterparty_id): (r.inflow, r.outflow, r.n_tx, r.n_in) for r in totals.collect()}
    assert found == {
        ("A", "B"): (4.0, 11.0, 3, 1),
        ("B", "A"): (11.0, 4.0, 3, 2),
        ("A", "A"): (7.0, 7.0, 2, 2),
        ("A", None): (3.0, 7.0, 2, 1),
        ("B", "C"): (0.0, 0.0, 1, 0),
        ("C", "B"): (0.0, 0.0, 1, 1),
    }
    assert totals.count() == 6
    # Legs are made after the only shuffle, not before it.
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")
