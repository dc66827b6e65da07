import random
from datetime import timedelta

import pytest
from samples import NOON, chain_case, event, events_frame

from sleuthflow import catalog
from sleuthflow.operators import cases, contracts, explain, scoring

CASE_OK = [event("case-ok", i, NOON + timedelta(minutes=i), f"S{i}", f"R{i}") for i in range(4)]


def test_normalisation_and_first_failure(spark):
    rows = [
        event("c", 0, NOON, currency=" usd ", channel=" Crypto "),
        event("c", 1, NOON, channel="wire", currency=" "),
        event("c", 2, NOON, receiver="A"),
        event("c", 3, NOON, amount=-1.0, receiver="A"),
        event("c", 4, NOON, event_id="  "),
        event("c", 5, NOON, sender=None),
        event("c", 6, NOON, amount=float("nan")),
    ]
    found = {r.pos: r for r in contracts.check_events(events_frame(spark, rows)).collect()}
    assert (found[0].currency, found[0].channel, found[0].reason) == ("USD", "crypto", None)
    assert [found[i].reason for i in range(1, 7)] == [
        "channel must be one of ['crypto', 'legal'].",
        "sender_id and receiver_id must be different.",
        "amount must be > 0.",
        "event_id must be non-empty.",
        "Missing event fields: ['sender_id']",
        "amount must be > 0.",
    ]
    good, bad = contracts.split(contracts.check_events(events_frame(spark, rows)))
    assert good.count() + bad.count() == len(rows)


def test_iso_timestamps_with_zone(spark):
    frame = events_frame(spark, [event("c", 0, NOON)]).selectExpr("* except (ts)", "' 2026-03-21T12:00:00Z ' as ts")
    assert contracts.normalize_events(frame).first().ts == NOON


def test_window_keeps_its_border(spark):
    hours = (10, 1, 30, 25)
    rows = [event("c", i, NOON - timedelta(hours=h)) for i, h in enumerate(hours)]
    windowed = cases.window_events(events_frame(spark, rows), 24)
    assert sorted(r.pos for r in windowed.collect()) == [0, 1, 3]
    assert cases.case_windows(windowed).first().n_events == 3


def test_window_length_per_case(spark):
    rows = [event(c, i, NOON - timedelta(hours=h)) for c in ("a", "b") for i, h in enumerate((0, 5, 50))]
    own = spark.createDataFrame([("a", 2)], "case_id string, window_hours int")
    windows = cases.case_windows(cases.window_events(events_frame(spark, rows), 60, own))
    assert {r.case_id: r.n_events for r in windows.collect()} == {"a": 1, "b": 3}
    with pytest.raises(ValueError):
        cases.window_events(events_frame(spark, rows), 0)


def test_case_id_falls_back_to_events_then_to_the_end(spark):
    rows = [
        {**event("r1", 0, NOON), "asset_type": " "},
        {**event("r1", 1, NOON - timedelta(hours=1)), "asset_type": "own"},
        {**event("r2", 2, NOON), "asset_type": ""},
    ]
    frame = events_frame(spark, rows).withColumnsRenamed({"case_id": "request", "asset_type": "case_id"})
    windows = cases.case_windows(cases.window_events(frame, 24, key="request"), "request", "case_id")
    assert {r.request: r.resolved_case_id for r in windows.collect()} == {"r1": "own", "r2": "case-20260321120000"}


def random_events(seed, n=300):
    rng = random.Random(seed)
    rows, at = [], NOON
    for i in range(n):
        at += timedelta(seconds=rng.choice((0, 5, 60, 89.5, 90, 90.9, 400)))
        case = "hot" if rng.random() < 0.7 else f"c{rng.randrange(6)}"
        sender, receiver = rng.sample("ABCDEFGH", 2)
        rows.append(event(case, i, at, sender, receiver, float(rng.randrange(1, 500)), rng.choice(("legal", "crypto"))))
    return rows


def test_gaps_match_a_plain_loop(spark):
    rows = random_events(3)
    rollup = cases.case_rollup(cases.window_events(events_frame(spark, rows), 720))
    found = {r.case_id: r for r in cases.event_gaps(rollup).collect()}
    for case in {r["case_id"] for r in rows}:
        times = sorted(r["ts"] for r in rows if r["case_id"] == case)
        gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:])]
        assert found[case].short_gaps == sum(g <= 90 for g in gaps)
        assert found[case].avg_delta_minutes == pytest.approx(sum(gaps) / 60 / max(len(gaps), 1))


def test_hot_case_in_slices_gives_the_same_windows(spark):
    frame = events_frame(spark, random_events(4))
    whole = cases.window_events(frame, 1)
    sliced = cases.window_events(frame, 1, rows_per_slice=7)
    assert sorted(whole.collect()) == sorted(sliced.select(whole.columns).collect())


def test_small_parts_match_a_plain_loop(spark):
    rows = random_events(5)
    rollup = cases.case_rollup(cases.window_events(events_frame(spark, rows), 720))
    for found in cases.small_parts(rollup).collect():
        amounts = [r["amount"] for r in rows if r["case_id"] == found.case_id]
        mean = sum(amounts) / len(amounts)
        assert found.small_parts == sum(a < mean * 0.35 for a in amounts)


def test_chain_case_scores(spark):
    frame = events_frame(spark, chain_case())
    wide = scoring.score_rollup(scoring.rollup_of(frame)).first().asDict()
    expected = {
        "tabular_score": 0.555952,
        "sequence_score": 0.598688,
        "graph_score": 0.725119,
        "global_risk": 0.599187,
        "p_legal_layering": 0.737804,
        "p_legal_to_crypto_bridge": 1.0,
        "p_crypto_mixing": 0.748488,
        "p_structured_splitting": 0.634058,
        "p_cash_out": 0.599850,
    }
    for name, value in expected.items():
        assert wide[name] == pytest.approx(value, abs=1e-6), name
    assert wide["risk_band"] == "MEDIUM"
    assert [wide[c] for c in scoring.LABEL_COLUMNS.values()] == [0, 1, 0, 0, 0]
    score = scoring.score_cases(frame, model_version="m1").first()
    assert (score.case_id, score.model_version, score.explanation_ready) == ("case-v2", "m1", True)
    assert set(score.typology_probs) == set(scoring.PROB_COLUMNS)


def test_chain_case_explanation(spark):
    told = explain.explain_cases(scoring.score_rollup(scoring.rollup_of(events_frame(spark, chain_case())))).first()
    assert told.summary == (
        "Case case-v2 has global risk 0.599 (MEDIUM). Strongest typology: LEGAL_TO_CRYPTO_BRIDGE."
    )
    assert [f.name for f in told.tabular_factors] == [
        "structural_depth",
        "transaction_entropy",
        "avg_holding_time",
        "payout_dependency",
        "reinvestment_rate",
    ]
    assert {f.name: f.value for f in told.sequence_factors} == pytest.approx(
        {"event_count": 4, "avg_delta_minutes": 23 / 3, "window_hours": 24}
    )
    assert {f.name: f.value for f in told.graph_factors} == pytest.approx({"nodes": 5, "edges": 4, "density": 0.2})
    assert told.confidence == pytest.approx(0.759716, abs=1e-6)


def test_supplied_features_replace_the_derived_ones(spark):
    frame = events_frame(spark, chain_case() + CASE_OK)
    own = spark.createDataFrame(
        [("case-v2", {"growth_rate": 1.0, "custom": -7.0}), ("case-ok", {})],
        "case_id string, tabular_features map<string, double>",
    )
    wide = scoring.score_rollup(scoring.rollup_of(frame), own)
    found = {r.case_id: r for r in wide.collect()}
    assert found["case-v2"].tabular_score == pytest.approx(0.35)
    assert found["case-ok"].tabular_score > 0
    told = {r.case_id: r for r in explain.explain_cases(wide).collect()}
    assert [(f.name, f.value) for f in told["case-v2"].tabular_factors] == [("custom", -7.0), ("growth_rate", 1.0)]


def test_batch_isolates_bad_supplied_features(spark):
    from test_quality import population

    from sleuthflow.operators import ml

    model = ml.train_risk_model(population(spark, 60), trees=1)
    rows = [event(c, i, NOON + timedelta(minutes=i), f"S{i}", f"R{i}") for c in ("a", "b", "c") for i in range(2)]
    legal = {n: low for n, (low, _) in catalog.FEATURE_BOUNDS.items()}
    given = [("a", legal), ("b", {**legal, "growth_rate": 7.0}), ("c", {"growth_rate": 1.0})]
    requested = spark.createDataFrame(given, "case_id string, tabular_features map<string, double>")
    scores, failures = scoring.score_batch(events_frame(spark, rows), cases=requested, model=model)
    assert [r.case_id for r in scores.collect()] == ["a"]
    errors = {r.case_id: r.error for r in failures.collect()}
    assert errors["b"] == "Feature 'growth_rate' out of range [0.0, 1.2]: 7.0"
    assert errors["c"].startswith("Missing features: ['referral_ratio', ")


def test_batch_isolates_failures(spark):
    bad = [
        event("case-fail", 0, NOON, "A", "B"),
        event("case-fail", 1, NOON, "A", "A"),
        event("case-fail", 2, NOON, "A", "B", channel="wire"),
        event(" ", 3, NOON, "A", "B", amount=0.0),
        event("short", 4, NOON),
    ]
    requested = spark.createDataFrame(
        [("case-ok", 24), ("case-fail", 24), ("short", 0), ("void", 24)], "case_id string, window_hours int"
    )
    scores, failures = scoring.score_batch(events_frame(spark, CASE_OK + bad), cases=requested)
    assert [r.case_id for r in scores.collect()] == ["case-ok"]
    assert {r.case_id: r.error for r in failures.collect()} == {
        "case-fail": "sender_id and receiver_id must be different.",
        "unknown-case": "amount must be > 0.",
        "short": "window_hours must be > 0.",
        "void": "events cannot be empty.",
    }


def test_a_rollup_stores_no_more_rows_than_events(spark, sf_dir):
    from sleuthflow.plans import views

    events = views.good_events(spark, sf_dir)
    windowed = cases.window_events(events, views.WINDOW_HOURS)
    assert scoring.rollup_of(events, views.WINDOW_HOURS).count() <= windowed.count()
