import random
from datetime import date, datetime, timedelta
from decimal import Decimal
from math import log2

import pytest
from pyspark.sql import functions as F

from sleuthflow import catalog
from sleuthflow.operators import company
from sleuthflow.operators.findings import company_findings

SCHEMA = (
    "company_id string, timestamp timestamp, amount decimal(18,2), direction string, counterparty_type string, "
    "counterparty_name string"
)


def random_ledger(seed, companies=8):
    rng = random.Random(seed)
    rows = []
    for c in range(companies):
        for _ in range(rng.randrange(1, 60)):
            at = datetime(2025, 1, 1) + timedelta(days=rng.randrange(40), hours=rng.randrange(24))
            amount = Decimal(rng.randrange(100, 100_000)) / 100
            direction = "out" if rng.random() < 0.45 else "in"
            kind = rng.choice(("physical", "legal", "exchange"))
            rows.append((f"co{c}", at, amount, direction, kind, f"p{rng.randrange(9)}"))
    return rows


def queue_holding_time(rows):
    """First in, first out with an explicit queue over active days."""
    days = sorted({r[1].date() for r in rows})
    queue, weighted, matched = [], 0.0, 0.0
    for i, day in enumerate(days):
        flows = {d: sum((r[2] for r in rows if r[1].date() == day and r[3] == d), Decimal(0)) for d in ("in", "out")}
        if flows["in"] > 0:
            queue.append([i, flows["in"]])
        left = flows["out"]
        while left > 0 and queue:
            take = min(left, queue[0][1])
            weighted += float(take) * max(1, i - queue[0][0])
            matched += float(take)
            left -= take
            queue[0][1] -= take
            if queue[0][1] == 0:
                queue.pop(0)
    return round(max(1.0, weighted / matched), 1) if matched else 90.0


@pytest.mark.parametrize("money", ["decimal(18,2)", "double"])
def test_holding_time_matches_a_queue(spark, money):
    rows = random_ledger(11, companies=25)
    ledger = spark.createDataFrame(rows, SCHEMA).withColumn("amount", F.col("amount").cast(money))
    found = {r.company_id: r.avg_holding_time for r in company.fifo_holding_time(company.ledger_days(ledger)).collect()}
    for c in {r[0] for r in rows}:
        assert found[c] == pytest.approx(queue_holding_time([r for r in rows if r[0] == c]), abs=0.1001), c


def test_metrics_match_plain_sums(spark):
    rows = random_ledger(12)
    found = {r.company_id: r for r in company.company_metrics(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(found) == {r[0] for r in rows}
    for c, metrics in found.items():
        mine = [r for r in rows if r[0] == c]
        inflow = float(sum(r[2] for r in mine if r[3] == "in"))
        outflow = float(sum(r[2] for r in mine if r[3] == "out"))
        physical = float(sum(r[2] for r in mine if r[3] == "in" and r[4] == "physical"))
        exchange = float(sum(r[2] for r in mine if r[4] == "exchange"))
        names, days = {}, {}
        for r in mine:
            names[r[5]] = names.get(r[5], 0) + float(r[2])
            days[r[1].date()] = days.get(r[1].date(), 0) + float(r[2])
        whole = inflow + outflow
        shares = [v / whole for v in days.values()]
        assert metrics.total_volume == pytest.approx(whole)
        assert metrics.physical_inflow_ratio == pytest.approx(physical / max(inflow, 1))
        assert metrics.crypto_exposure_ratio == pytest.approx(exchange / max(whole, 1))
        assert metrics.dependency_ratio == pytest.approx(outflow / max(inflow, 1))
        assert metrics.concentration_index == pytest.approx(sum(sorted(names.values())[-5:]) / whole)
        assert metrics.entropy_of_flows == pytest.approx(
            -sum(p * log2(p) for p in shares) / log2(max(len(shares), 2)), abs=1e-4
        )
        assert (metrics.total_transactions, metrics.unique_counterparties) == (len(mine), len(names))


def test_company_without_outflow(spark):
    rows = [("solo", datetime(2025, 1, 1), Decimal("10.00"), "in", "legal", None)]
    metrics = company.company_metrics(spark.createDataFrame(rows, SCHEMA)).first()
    assert metrics.avg_holding_time == 90.0
    assert (metrics.concentration_index, metrics.entropy_of_flows, metrics.unique_counterparties) == (0, 0, 0)


def test_contributions_sum_to_the_score(spark):
    metrics = company.company_metrics(spark.createDataFrame(random_ledger(13), SCHEMA))
    risk = company.company_risk(metrics)
    sums = company.factor_contributions(risk).groupBy("company_id").sum("contribution")
    for row in risk.join(sums, "company_id").collect():
        assert row.probability == pytest.approx(row["sum(contribution)"], abs=1e-4)
    labels = company.with_level_labels(risk)
    assert labels.where("risk_label is null").count() == 0


def test_missing_metrics_take_defaults(spark):
    risk = company.company_risk(spark.createDataFrame([("x", 1.5)], "company_id string, dependency_ratio double")).first()
    assert risk.probability == pytest.approx(0.25 + 0.15 * 0.5)
    assert risk.risk_level == "Medium"


@pytest.mark.parametrize(("score", "level"), [(0.70, "Critical"), (0.69, "High"), (0.5, "High"), (0.3, "Medium"), (0.29, "Low")])
def test_level_limits(spark, score, level):
    from sleuthflow.functions.columns import band

    assert spark.range(1).select(band(F.lit(score), catalog.COMPANY_BANDS, "Low").alias("l")).first().l == level


def test_findings_have_bands_and_text(spark):
    metrics = spark.createDataFrame(
        [("x", 0.61, 0.31, 0.81, 29.0, 0.41, 0.2), ("y", 0.1, 0.01, 0.1, 80.0, 0.1, 1.0)],
        "company_id string, physical_inflow_ratio double, crypto_exposure_ratio double, dependency_ratio double, "
        "avg_holding_time double, concentration_index double, entropy_of_flows double",
    )
    found = {r.company_id: r for r in company_findings(metrics, company.company_risk(metrics)).collect()}
    bands = ("physical_band", "crypto_band", "dependency_band", "holding_band", "concentration_band")
    assert {found["x"][b] for b in bands} == {"red"}
    assert {found["y"][b] for b in bands} == {"green"}
    assert found["y"].conclusion == "no_action"
    assert "61%" in found["x"].narrative and "0.81" in found["x"].narrative


def test_network_can_merge_types(spark):
    day = datetime(2025, 1, 1)
    rows = [("c", day, Decimal(n), "in", kind, "p") for n, kind in ((5, "exchange"), (7, "legal"))]
    ledger = spark.createDataFrame(rows, SCHEMA)
    assert company.counterparty_network(ledger).count() == 2
    edge = company.counterparty_network(ledger, merge_types=True).first()
    assert (edge.counterparty_type, edge.volume, edge.width, edge.src, edge.dst) == ("legal", 7.0, 3.5, "p", "c")


def test_daily_flow_fills_missing_directions(spark):
    rows = [("c", datetime(2025, 1, 1), Decimal(5), "in", "legal", "p")]
    row = company.daily_flow(spark.createDataFrame(rows, SCHEMA)).first()
    assert (row.day, row.inflow, row.outflow) == (date(2025, 1, 1), 5, 0)


def test_numbers_print_as_python_prints_them(spark):
    from pyspark.sql import functions as F

    from sleuthflow.functions.columns import printed

    values = [0.485, 0.495, 0.125, 0.375, 2.5, 3.5, 4.5, 0.15, 0.25, 1.005, -0.485, 0.0, 123456.785, 1e-9, 0.0049999]
    row = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3):
        pattern = f"%.{digits}f"
        found = [r[0] for r in row.select(printed(pattern, F.col("v"))).collect()]
        assert found == [pattern % v for v in values]
