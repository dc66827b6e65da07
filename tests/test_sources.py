import json

import pytest
from pyspark.sql import functions as F
from samples import OPERATIONAL_ROW, NOON, event, features_frame
from test_quality import population

from sleuthflow import catalog
from sleuthflow.operators import entity, explain, scoring
from sleuthflow.sources import readers, sinks

ROWS = [("A", "B", 100.0), ("C", "B", 250.0), ("B", "D", 80.0)]


def transfers():
    return [
        {"sender_id": s, "receiver_id": r, "amount": a, "timestamp": f"2026-01-0{i + 1}T10:00:00", "memo": "x"}
        for i, (s, r, a) in enumerate(ROWS)
    ]


@pytest.mark.parametrize("kind", ["csv", "json", "json-array", "parquet"])
def test_transfers_from_every_format(spark, tmp_path, kind):
    path = str(tmp_path / f"log.{kind.split('-')[0]}")
    if kind == "json-array":
        (tmp_path / "log.json").write_text(json.dumps(transfers()))
    else:
        sinks.write_dataset(spark.createDataFrame(transfers()), path)
    log = readers.load_transactions(spark, path, multiline=kind == "json-array")
    assert dict(log.dtypes)["timestamp"] == "timestamp"
    assert log.where("memo = 'x'").count() == 3
    assert entity.entity_operational(log).where("entity_id = 'B'").first().incoming_funds == 350


def test_bad_inputs_are_refused(spark, tmp_path):
    path = str(tmp_path / "log.csv")
    sinks.write_dataset(spark.createDataFrame(ROWS, "sender_id string, receiver_id string, amount double").drop("receiver_id"), path)
    with pytest.raises(ValueError, match="Missing columns"):
        readers.load_transactions(spark, path)
    with pytest.raises(ValueError, match="Unsupported file format"):
        readers.load_transactions(spark, str(tmp_path / "log.xlsx"))
    with pytest.raises(ValueError, match="Unsupported file format"):
        sinks.write_dataset(spark.range(1), str(tmp_path / "out.txt"))


def test_nan_amounts_become_null(spark, tmp_path):
    path = str(tmp_path / "log.json")
    rows = transfers()
    rows[0]["amount"] = float("nan")
    sinks.write_dataset(spark.createDataFrame(rows), path)
    assert readers.load_transactions(spark, path).where("amount is null").count() == 1


def test_dataset_with_features_passes_through(spark, tmp_path):
    path = str(tmp_path / "set.csv")
    sinks.write_dataset(population(spark, 10).drop("entity_id"), path)
    loaded = readers.load_dataset(spark, path)
    assert loaded.count() == 10 and set(catalog.FEATURES) <= set(loaded.columns)
    assert readers.load_population(spark, path).schema["is_borderline"].dataType.typeName() == "boolean"


def test_operational_dataset_is_converted(spark, tmp_path):
    path = str(tmp_path / "ops.json")
    sinks.write_dataset(spark.createDataFrame([{**OPERATIONAL_ROW, "label": 1, "id": "x"}]), path)
    row = readers.load_dataset(spark, path).first()
    assert (row.label, row.id) == (1, "x")
    assert row.gini_coefficient == pytest.approx(0.535)
    bad = spark.createDataFrame([{**OPERATIONAL_ROW, "label": 1, "tx_count_total": 1.0}])
    with pytest.raises(Exception, match="out of range"):
        readers.to_labeled_features(bad).collect()
    with pytest.raises(ValueError, match="must contain"):
        readers.to_labeled_features(features_frame(spark))


def test_nested_requests_score_as_a_batch(spark, tmp_path):
    def request(case, rows, **more):
        events = [{k: (v.isoformat() + "Z" if k == "ts" else v) for k, v in r.items() if k not in ("case_id", "pos")} for r in rows]
        return {"case_id": case, "events": events, **more}

    good = [event("x", i, NOON, f"S{i}", f"R{i}") for i in range(3)]
    bad = [event("x", 0, NOON, "S", "S")]
    lines = [request(" case-ok ", good, tabular_features={"growth_rate": 1.0}), request("case-fail", bad, window_hours=5)]
    (tmp_path / "requests.json").write_text("\n".join(json.dumps(line) for line in lines))
    events, cases = readers.explode_requests(readers.load_case_requests(spark, str(tmp_path / "requests.json")))
    assert {r.case_id: r.window_hours for r in cases.collect()} == {"case-ok": 24, "case-fail": 5}
    scores, failures = scoring.score_batch(events, cases=cases)
    assert [r.case_id for r in scores.collect()] == ["case-ok"]
    assert failures.first().error == "sender_id and receiver_id must be different."


def test_ledger_source(spark, tmp_path):
    path = str(tmp_path / "ledger.csv")
    row = ("c1", "2026-01-01 10:00:00", "12.50", "in", "legal", "p")
    names = ["company_id", "timestamp", "amount", "direction", "counterparty_type", "counterparty_name"]
    sinks.write_dataset(spark.createDataFrame([row], names), path)
    loaded = readers.load_ledger(spark, path)
    assert loaded.first().company_id == "c1"
    assert dict(readers.load_ledger(spark, path, amount_type="decimal(18,2)").dtypes)["amount"] == "decimal(18,2)"


def test_small_ledger_amounts_are_kept(spark, tmp_path):
    names = ["company_id", "timestamp", "amount", "direction", "counterparty_type", "counterparty_name"]
    rows = [("c1", "2026-01-01 10:00:00", amount, "in", "legal", "p") for amount in ("0.00412345", "12.3456")]
    path = str(tmp_path / "ledger.csv")
    sinks.write_dataset(spark.createDataFrame(rows, names), path)
    assert sorted(r.amount for r in readers.load_ledger(spark, path).collect()) == [0.00412345, 12.3456]


def test_a_key_of_a_late_line_is_a_column(spark, tmp_path):
    lines = [dict(row, sender_id=f"S{k}") for k in range(2000) for row in transfers()[:3]]
    for line in lines[:5000]:
        del line["memo"]
    (tmp_path / "log.json").write_text("\n".join(map(json.dumps, lines)))
    log = readers.load_transactions(spark, str(tmp_path / "log.json"))
    assert log.where("memo = 'x'").count() == 1000
    named = ["sender_id", "receiver_id", "amount", "timestamp"]
    assert readers.load_transactions(spark, str(tmp_path / "log.json"), columns=named).columns == named


def test_unreadable_rows_get_a_reason_and_stop_a_load(spark, tmp_path):
    rows = [("A", "B", "12x", "2026-01-01"), ("A", "B", " 5.5\t", "2026-01-02"), ("A", "B", "", "2026-01-03"), ("A", "B", "1", "soon")]
    path = str(tmp_path / "log.csv")
    sinks.write_dataset(spark.createDataFrame(rows, ["sender_id", "receiver_id", "amount", "timestamp"]), path)
    checked = readers.check_transactions(spark, path).collect()
    assert sorted(filter(None, (r.reason for r in checked))) == ["Unreadable amount: 12x", "Unreadable timestamp: soon"]
    assert sorted(r.amount for r in checked if r.amount is not None) == [1.0, 5.5]
    with pytest.raises(Exception, match="Unreadable (amount: 12x|timestamp: soon)"):
        readers.load_transactions(spark, path).agg({"amount": "sum"}).collect()


def test_a_batch_envelope_and_equal_case_ids(spark, tmp_path):
    def request(case, rows, **more):
        events = [{k: (v.isoformat() + "Z" if k == "ts" else v) for k, v in r.items() if k not in ("case_id", "pos")} for r in rows]
        return {"case_id": case, "events": events, **more}

    small = [event("x", i, NOON, f"S{i}", f"R{i}") for i in range(2)]
    large = [event("x", i, NOON, f"S{i}", "R") for i in range(4)]
    bad = [event("x", 0, NOON, "S", "S")]
    batch = {"cases": [request("k", small), request("k", large, window_hours=5), request(" ", bad)]}
    (tmp_path / "batch.json").write_text(json.dumps(batch) + "\n" + json.dumps(request("k", small)))
    events, asked = readers.explode_requests(readers.load_case_requests(spark, str(tmp_path / "batch.json")))
    assert events.groupBy("request_id").count().count() == 4
    scores, failures = scoring.score_batch(events, cases=asked)
    found = scores.collect()
    assert [r.case_id for r in found] == ["k"] * 3 and len({r.request_id for r in found}) == 3
    assert len({r.global_risk for r in found}) == 2
    assert [(r.case_id, r.error) for r in failures.collect()] == [("unknown-case", "sender_id and receiver_id must be different.")]
    wide, _ = scoring.score_batch(events, cases=asked, detail=True)
    told = {r.request_id: r.summary for r in explain.explain_cases(wide).collect()}
    assert told.keys() == {r.request_id for r in found} and all(s.startswith("Case k has") for s in told.values())


def test_dated_sink_prunes(spark, tmp_path):
    path = str(tmp_path / "events")
    frame = spark.createDataFrame([(1, NOON)], "id int, ts timestamp")
    sinks.write_by_date(frame, path, "ts")
    assert spark.read.parquet(path).where("event_date = date'2026-03-21'").count() == 1


def test_dated_sink_writes_few_files(spark, tmp_path):
    path = str(tmp_path / "days")
    frame = spark.range(400).repartition(16).select("id", F.timestamp_seconds(F.col("id") % 5 * 86_400).alias("ts"))
    sinks.write_by_date(frame, path, "ts")
    sinks.write_by_date(frame.limit(0), path, "ts")
    assert len(list((tmp_path / "days").glob("event_date=*/*.parquet"))) == 5
    assert spark.read.parquet(path).groupBy("event_date").count().select("count").distinct().collect() == [(80,)]


def test_scratch_follows_the_session_setting(spark, tmp_path, monkeypatch):
    from sleuthflow import session

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    monkeypatch.setattr(session, "CHECKPOINT_KEY", "sleuthflow.test.dir")
    spark.conf.set("sleuthflow.test.dir", str(tmp_path))
    assert session.scratch_path(spark, "t").startswith(str(tmp_path))
    session.materialize(spark.range(3), "t")
    assert any(p.name.startswith("t-") for p in tmp_path.glob("*/*"))
    assert session.clear_scratch(spark) and not list(tmp_path.glob("*/*"))
    spark.conf.unset("sleuthflow.test.dir")


def test_catalog_tables(spark):
    from sleuthflow.sources import catalogs

    assert catalogs.bounds_table(spark).count() == 21
    assert [r.typology for r in catalogs.typologies_table(spark).orderBy("place").collect()] == catalog.TYPOLOGIES
    assert catalogs.thresholds_table(spark).where("scale = 'case' and band = 'HIGH'").first().at_least == 0.7
    assert catalogs.engine_status(None)["tabular_model_loaded"] is False


def test_workers_get_the_package(tmp_path):
    """A driver that runs elsewhere and finds the package by sys.path alone."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    script = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
from sleuthflow.session import configure
spark = configure(SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate())
def run(batches):
    import sleuthflow.catalog
    yield from batches
print("rows", spark.range(3).mapInArrow(run, "id long").count())
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert "rows 3" in done.stdout, done.stderr[-2000:]
