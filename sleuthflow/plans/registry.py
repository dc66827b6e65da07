"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from sleuthflow import catalog
from sleuthflow.operators import calibration, cases, company, contracts, drift, ensemble, entity, evaluation, explain, graph, ml, profile, quality, resampling, scoring
from sleuthflow.operators.findings import company_findings
from sleuthflow.plans import views
from sleuthflow.session import configure, materialize, scratch_path
from sleuthflow.sources import catalogs, readers, sinks
from sleuthflow.streaming import case_state
from sleuthflow.streaming.case_stream import TrailingCases, good_events, hopping_case_windows
from sleuthflow.streaming.results import CaseResults

DIGITS = 6
# Digits to which eigenvectors of different solvers agree.
PCA_DIGITS = 4
HOURS = views.WINDOW_HOURS
# A fit gets no more partitions than it has this many rows for.
FIT_ROWS = 20_000
# Micro-batches of the feed of the stream queries, files of each, and how late an event may be.
STREAM_PARTS, STREAM_FILES, STREAM_LATENESS = 3, 4, "1 hour"


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded, so that engines with another last digit of exp or log compare equal."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({name: F.round(F.col(f"`{name}`"), DIGITS) for name in doubles}) if doubles else df


def _micros(ts: str) -> Column:
    return F.unix_micros(ts).alias(f"{ts.removesuffix('_ts')}_us")


# Sources


def read_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the transfers as CSV, load them with the source, and total them per sender."""
    path = scratch_path(spark, "transfers") + ".csv"
    sinks.write_dataset(views.transfers(spark, sf_dir), path)
    loaded = readers.load_transactions(spark, path)
    return loaded.groupBy("sender_id").agg(
        F.count("*").alias("n_tx"),
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"),
        F.unix_micros(F.min("timestamp")).alias("first_us"),
        F.unix_micros(F.max("timestamp")).alias("last_us"),
    )


def labeled_dataset_from_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.to_labeled_features(views.labeled_operational(spark, sf_dir))


def explode_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "requests") + ".json"
    sinks.write_dataset(views.case_requests(spark, sf_dir).drop("part"), path)
    events, _ = readers.explode_requests(readers.load_case_requests(spark, path))
    return events.select("case_id", "pos", "event_id", "sender_id", "receiver_id", "amount", "channel")


# Contracts


def normalize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = contracts.normalize_events(views.dirty_events(spark, sf_dir))
    texts = [c for c in catalog.EVENT_FIELDS if c not in ("ts", "amount")]
    return clean.select(*texts, F.col("amount").cast("double").alias("amount"), _micros("ts"), "case_id")


def event_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = contracts.split(contracts.check_events(views.dirty_events(spark, sf_dir)))
    return bad.select("event_id", "case_id", "reason")


def ops_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = contracts.split(contracts.check_ops(entity.entity_operational(views.transfers(spark, sf_dir))))
    return bad.select("entity_id", "tx_count_total", "incoming_funds", "reason")


def feature_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unclipped features against their bounds: growth and payout ratios of all entities."""
    ops = entity.entity_operational(views.transfers(spark, sf_dir))
    wide = entity.operational_to_features(ops, keep=["entity_id", "payouts_total", "incoming_funds"])
    raw = wide.withColumn("payout_dependency", F.col("payouts_total") / F.greatest("incoming_funds", F.lit(1.0)))
    _, bad = contracts.split(contracts.check_features(raw))
    return bad.select("entity_id", "payout_dependency", "reason")


# Quality


def dataset_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_gate(views.labeled(spark, sf_dir))


def class_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.class_overlap(views.labeled(spark, sf_dir))


def dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dataset_report(views.labeled(spark, sf_dir))


def _stratified(labeled: DataFrame) -> DataFrame:
    return materialize(evaluation.stratified_split(labeled, "entity_id"), "split")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stratified(views.labeled(spark, sf_dir))


def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _split(spark, sf_dir)
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    return quality.leakage_check(train, test, "entity_id", catalog.FEATURES)


# Entities


def entity_operational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.entity_operational(views.transfers(spark, sf_dir))


def log_operational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity.log_operational(views.transfers(spark, sf_dir))


def sender_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = materialize(entity.counterparty_totals(views.transfers(spark, sf_dir)), "counterparty-totals")
    return entity.sender_concentration(totals)


def entity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.features(spark, sf_dir)


def tabular_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.features(spark, sf_dir).select("entity_id", scoring.tabular_proxy().alias("tabular_score"))


# Companies


def company_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.company_metrics(views.ledger(spark, sf_dir))


def fifo_holding_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.fifo_holding_time(company.ledger_days(views.ledger(spark, sf_dir)))


def company_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = materialize(company.ledger_rollup(views.ledger(spark, sf_dir)), "ledger-rollup")
    return company.concentration(company.counterparties_of(rollup))


def flow_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.flow_entropy(company.ledger_days(views.ledger(spark, sf_dir)))


def daily_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = company.daily_flow(views.ledger(spark, sf_dir))
    return flows.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def inflow_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.inflow_structure(company.core_metrics(_counterparties(spark, sf_dir)))


def _counterparties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.counterparties_of(company.ledger_rollup(views.ledger(spark, sf_dir)))


def counterparty_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.counterparty_network(views.ledger(spark, sf_dir))


def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.metrics_long(company_metrics(spark, sf_dir)).select("company_id", "metric", "value", "display")


def _company_risk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    metrics = materialize(company_metrics(spark, sf_dir), "company-metrics")
    return metrics, company.company_risk(metrics)


def company_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.with_level_labels(_company_risk(spark, sf_dir)[1])


def factor_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company.factor_contributions(_company_risk(spark, sf_dir)[1])


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company_findings(*_company_risk(spark, sf_dir))


# Cases


def case_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of requests of which a third carries no case id on its events."""
    events = views.good_events(spark, sf_dir)
    anonymous = F.regexp_extract("case_id", r"^c(\d+)-", 1).cast("int") % 3 == 0
    requests = events.select(
        F.col("case_id").alias("request_id"),
        "event_id",
        "ts",
        F.when(anonymous, F.lit(" ")).otherwise(F.col("case_id")).alias("case_id"),
    )
    windowed = cases.window_events(requests, HOURS, key="request_id")
    return cases.case_windows(windowed, "request_id", "case_id").select(
        "request_id", "resolved_case_id", "n_events", _micros("start_ts"), _micros("end_ts")
    )


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rollup_of(views.good_events(spark, sf_dir), HOURS)


def case_operational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.case_operational(cases.case_facts(_rollup(spark, sf_dir)))


def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.event_gaps(_rollup(spark, sf_dir)).drop("window_hours")


def sequence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = cases.event_gaps(_rollup(spark, sf_dir))
    return gaps.select("case_id", scoring.sequence_score().alias("sequence_score"))


def _edges_and_parties(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = cases.edges_of(_rollup(spark, sf_dir))
    return edges, cases.parties_of(edges)


def case_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, parties = _edges_and_parties(spark, sf_dir)
    return graph.case_graph_stats(cases.case_totals(parties))


def case_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = _edges_and_parties(spark, sf_dir)
    return graph.case_components(edges)


def case_walk_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = _edges_and_parties(spark, sf_dir)
    return graph.case_walk_depth(edges)


def case_hub_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.case_hub_metrics(*_edges_and_parties(spark, sf_dir))


def graph_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, parties = _edges_and_parties(spark, sf_dir)
    stats = graph.case_graph_stats(cases.case_totals(parties))
    joined = stats.join(graph.case_components(edges), "case_id")
    return joined.select("case_id", scoring.graph_score().alias("graph_score"))


def typology_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labeled = scoring.labeled_cases(_rollup(spark, sf_dir))
    return labeled.select("case_id", *scoring.LABEL_COLUMNS.values())


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_rollup(_rollup(spark, sf_dir))


def typology_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("case_id", *scoring.PROB_COLUMNS.values())


def _flat(scores: DataFrame) -> DataFrame:
    probs = [F.col("typology_probs")[name].alias(column) for name, column in scoring.PROB_COLUMNS.items()]
    return scores.select("case_id", "global_risk", "risk_band", *probs)


def score_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(scoring.score_cases(views.good_events(spark, sf_dir), HOURS))


def score_batch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures with their error and scores of the cases left, in one table."""
    scores, failures = scoring.score_batch(views.raw_events(spark, sf_dir), HOURS)
    none = F.lit(None)
    return scores.select("case_id", none.cast("string").alias("error"), "global_risk").unionByName(
        failures.select("case_id", "error", none.cast("double").alias("global_risk"))
    )


def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of request payloads, some with features of their own or with a window that no case may have."""
    path = scratch_path(spark, "payloads") + ".json"
    sinks.write_dataset(views.request_payloads(spark, sf_dir), path)
    events, requests = readers.explode_requests(readers.load_case_requests(spark, path))
    scores, failures = scoring.score_batch(events, cases=requests)
    none = F.lit(None)
    return scores.select("case_id", none.cast("string").alias("error"), "global_risk").unionByName(
        failures.select("case_id", "error", none.cast("double").alias("global_risk"))
    )


def explain_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = explain.explain_cases(_scored(spark, sf_dir))

    def value(factors: str, position: int) -> Column:
        return F.col(factors)[position]["value"]

    return told.select(
        "case_id",
        "summary",
        F.concat_ws(",", F.transform("tabular_factors", lambda e: e["name"])).alias("top_features"),
        F.col("tabular_factors")[0]["value"].alias("top_value"),
        value("sequence_factors", 0).alias("event_count"),
        value("sequence_factors", 1).alias("avg_delta_minutes"),
        value("sequence_factors", 2).alias("window_hours"),
        value("graph_factors", 0).alias("nodes"),
        value("graph_factors", 1).alias("edges"),
        value("graph_factors", 2).alias("density"),
        "confidence",
    )


def case_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases in every band of the catalog, empty ones too, with the lowest score of the band."""
    counted = _scored(spark, sf_dir).groupBy(F.col("risk_band").alias("band")).agg(F.count("*").alias("n_cases"))
    scale = catalogs.thresholds_table(spark).where("scale = 'case'").select("band", "at_least")
    return scale.join(counted, "band", "full").select("band", "at_least", F.coalesce("n_cases", F.lit(0)).alias("n_cases"))


def typology_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probability of every typology of the catalog, and the cases in which it is likelier than not."""
    wide = _scored(spark, sf_dir).select(*[F.col(column).alias(name) for name, column in scoring.PROB_COLUMNS.items()])
    long = wide.unpivot([], list(scoring.PROB_COLUMNS), "typology", "p")
    told = long.groupBy("typology").agg(F.avg("p").alias("mean_prob"), F.count_if(F.col("p") >= 0.5).alias("n_likely"))
    return catalogs.typologies_table(spark).join(told, "typology", "left")


def events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the events by day, read the folders back and total them."""
    path = scratch_path(spark, "events-by-day")
    sinks.write_by_date(views.raw_events(spark, sf_dir), path, "ts")
    days = spark.read.parquet(path).groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("event_day"))
    return days.agg(F.count("*").alias("n_events"), F.round(F.sum("amount").cast("double"), 2).alias("amount"))


def alert_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = materialize(_scored(spark, sf_dir), "scored-cases")
    dossier = explain.explain_cases(scored).select("case_id", "summary", "confidence")
    subjects = scored.select("case_id", "global_risk", "risk_band")
    return scoring.alert_queue(subjects, "case_id", "global_risk", 100, dossier)


def _event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of micro-batches that follow each other in time."""
    events = materialize(views.raw_events(spark, sf_dir), "case-events")
    feed = scratch_path(spark, "feed")
    cuts = events.agg(F.percentile_approx(F.unix_micros("ts"), [k / STREAM_PARTS for k in range(1, STREAM_PARTS)]).alias("c")).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges, edges[1:]):
        us = F.unix_micros("ts")
        after = us > low if low is not None else F.lit(True)
        until = us <= high if high is not None else F.lit(True)
        # A part is a number of files, and files are taken in the order of their writing.
        events.where(after & until).repartition(STREAM_FILES).write.mode("append").parquet(feed)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", STREAM_FILES).parquet(feed)


def stream_case_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing windows recomputed from the log after every micro-batch must equal the batch result."""
    stream = good_events(_event_feed(spark, sf_dir), STREAM_LATENESS)

    def compute(events: DataFrame) -> DataFrame:
        windows = cases.case_windows(cases.window_events(events, HOURS))
        return windows.select("case_id", "n_events", _micros("start_ts"), _micros("end_ts"))

    trailing = TrailingCases(spark, scratch_path(spark, "stream"), compute, HOURS)
    run = trailing.start(stream, scratch_path(spark, "stream-checkpoint"), available_now=True)
    run.awaitTermination()
    return trailing.latest()


def stream_hopping_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hopping windows of the event stream that the watermark has closed."""
    live = hopping_case_windows(_event_feed(spark, sf_dir), f"{HOURS} hours", "4 hours", STREAM_LATENESS)
    out = scratch_path(spark, "hopping")
    writer = live.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "hopping-checkpoint"))
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.schema(live.schema).parquet(out)
    amount = F.col("amount_total").cast("double").alias("amount_total")
    return closed.select("case_id", _micros("window_start"), "n_events", amount, _micros("start_ts"), _micros("end_ts"), "crypto_events")


def stream_case_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing windows held in keyed state must equal the batch result."""
    folder = scratch_path(spark, "state-results")
    run = case_state.start(
        spark, _event_feed(spark, sf_dir), folder, scratch_path(spark, "state-checkpoint"), HOURS, STREAM_LATENESS, available_now=True
    )
    run.awaitTermination()
    found = CaseResults(spark, folder, case_state.WINDOW_SCHEMA).latest()
    return found.select("case_id", "n_events", _micros("start_ts"), _micros("end_ts"))


# Models

_fitted: dict[tuple[str, int, str], object] = {}


def _model(spark: SparkSession, split: DataFrame):
    """Model of full size on the training rows of a split.

    Queries over the same rows share one fit: the key is a digest of the rows themselves, so changed data are
    fitted anew. A fresh session fits again.
    """
    train = materialize(split.where(~F.col("is_test")), "train")
    digest = F.sum(F.xxhash64(*sorted(train.columns)).cast("decimal(38,0)")).cast("string")
    rows, mark = train.agg(F.count("*"), digest).first()
    key = (spark.sparkContext.applicationId, rows, mark)
    if key not in _fitted:
        # Every level of every tree reads all rows: a pass lasts as long as its largest task.
        parts = min(spark.sparkContext.defaultParallelism, rows // FIT_ROWS)
        _fitted[key] = ml.train_risk_model(train.repartition(parts) if parts > train.rdd.getNumPartitions() else train)
    return _fitted[key]


def _model_and_features(spark: SparkSession, sf_dir: str):
    """The model and the features of every entity, derived once for the fit and for the scores."""
    features = materialize(views.features(spark, sf_dir), "features")
    return _model(spark, _stratified(views.planted(features))), features


def train_risk_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the model on the held-out rows."""
    split = _split(spark, sf_dir)
    scored = ml.predict_risk(_model(spark, split), split.where("is_test"))
    return evaluation.binary_metrics(scored, "probability", "label")


def predict_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, features = _model_and_features(spark, sf_dir)
    scored = ml.predict_risk(model, features)
    return scored.select("entity_id", "probability", "label_text", "threshold_policy", "reason")


def predict_from_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts are derived once; those that pass the contract give the training rows."""
    ops = materialize(entity.entity_operational(views.transfers(spark, sf_dir)), "operational")
    model = _model(spark, _stratified(views.planted(views.features_of(ops))))
    scored, _ = ml.predict_from_ops(model, ops, "entity_id")
    return scored.select("entity_id", "probability", "label_text", *catalog.FEATURES)


def score_cases_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose tabular branch is the fitted model."""
    model = _model(spark, _split(spark, sf_dir))
    return _flat(scoring.score_cases(views.good_events(spark, sf_dir), HOURS, model=model))


def risk_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature adds to the score of every entity, from the node table of the model."""
    model, features = _model_and_features(spark, sf_dir)
    nodes = materialize(ensemble.node_table(model), "nodes")
    return ensemble.contributions(features, nodes, catalog.FEATURES, "entity_id")


def risk_from_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every entity from the node table alone."""
    model, features = _model_and_features(spark, sf_dir)
    nodes = materialize(ensemble.node_table(model), "nodes")
    found = ensemble.predict(features, nodes, catalog.FEATURES, model.stages[-1].getMaxDepth())
    return found.select("entity_id", "margin", "probability")


def feature_importance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.feature_importances(_model(spark, _split(spark, sf_dir)), 5)


def _population(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(views.labeled(spark, sf_dir), "population")
    return ml.fit_population_map(rows).project(rows)


def population_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = [F.round(c, PCA_DIGITS).alias(c) for c in ("PCA1", "PCA2")]
    return _population(spark, sf_dir).select("entity_id", *axes, "label", "is_borderline")


def population_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = [F.round(c, PCA_DIGITS).alias(c) for c in ("center_pca1", "center_pca2")]
    return ml.layer_summary(ml.population_layers(_population(spark, sf_dir))).select("layer", "n", *centers)


def population_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows on a map that was fitted to the training rows and read back from its files."""
    split = _split(spark, sf_dir)
    fitted = ml.fit_population_map(split.where(~F.col("is_test")))
    path = scratch_path(spark, "map")
    sinks.save_model(fitted.model, path)
    stored = ml.PopulationMap(sinks.load_model(path), fitted.factors)
    axes = [F.round(c, PCA_DIGITS).alias(c) for c in ("PCA1", "PCA2")]
    return stored.project(split.where("is_test")).select("entity_id", *axes)


def load_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled features written as CSV, loaded as a population and counted by class and strip."""
    path = scratch_path(spark, "population") + ".csv"
    rows = views.labeled(spark, sf_dir).select(*catalog.FEATURES, "label", "is_borderline")
    sinks.write_dataset(rows, path)
    loaded = readers.load_population(spark, path)
    return loaded.groupBy("label", "is_borderline").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in catalog.FEATURES])


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("entity_id", "label", "is_test")


def _proxy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proxy scores to four digits with the planted label."""
    return views.labeled(spark, sf_dir).select("label", F.round(scoring.tabular_proxy(), 4).alias("score"))


def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.binary_metrics(_proxy_scores(spark, sf_dir), threshold=0.25)


def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = evaluation.roc_curve(_proxy_scores(spark, sf_dir))
    return curve.withColumn("threshold", F.least("threshold", F.lit(2.0)))


def _coarse_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(training, held-out) proxy scores to three digits with the planted label."""
    rows = _split(spark, sf_dir).select("label", "is_test", F.round(scoring.tabular_proxy(), 3).alias("score"))
    rows = materialize(rows, "coarse-scores")
    return rows.where(~F.col("is_test")), rows.where("is_test")


def isotonic_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.isotonic_curve(_coarse_scores(spark, sf_dir)[0])


def platt_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    slope, offset = calibration.platt_curve(_coarse_scores(spark, sf_dir)[0])
    return spark.createDataFrame([(slope, offset)], "slope double, offset double")


def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out error of the raw score and of both calibrations, fitted on the training rows."""
    train, test = _coarse_scores(spark, sf_dir)
    slope, offset = calibration.platt_curve(train)
    ways = {
        "raw": test.withColumn("p", F.col("score")),
        "isotonic": calibration.apply_curve(test, calibration.isotonic_curve(train), out="p"),
        "platt": test.withColumn("p", calibration.platt(slope, offset)),
    }
    found = [calibration.calibration_report(rows, "p").withColumn("method", F.lit(name)) for name, rows in ways.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def feature_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the held-out rows against those of the training rows."""
    split = _split(spark, sf_dir)
    return drift.drift(split.where(~F.col("is_test")), split.where("is_test"), catalog.FEATURES)


def compare_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proxy score against its strongest feature, by their areas under the curve."""
    rows = views.labeled(spark, sf_dir).select(
        "label", F.round(scoring.tabular_proxy(), 4).alias("proxy"), F.round("centralization_index", 4).alias("single")
    )
    return evaluation.compare_auc(rows, "proxy", "single")


def _keyed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.labeled(spark, sf_dir).select(
        "entity_id", "label", F.round(scoring.tabular_proxy(), 4).alias("proxy"), F.round("centralization_index", 4).alias("single")
    )


def bootstrap_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the proxy score's metrics from 200 Poisson resamplings of the entities."""
    return resampling.bootstrap_metrics(_keyed_scores(spark, sf_dir), "entity_id", "proxy", threshold=0.25)


def bootstrap_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proxy score against its strongest feature, both on the same resamplings."""
    return resampling.bootstrap_difference(_keyed_scores(spark, sf_dir), "entity_id", "proxy", "single", thresholds=(0.25, 0.5))


def profile_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers by year and side, merged from stored days, with exact counts beside the sketches.

    A distinct count may be off by three standard errors, the rank of the median by twice its error.
    """
    rows = materialize(views.transfers(spark, sf_dir).withColumn("side", F.substring("receiver_id", 1, 1)), "transfers")
    days = materialize(profile.daily_profile(rows, ["side"], "timestamp", ["sender_id"], ["amount"]), "days")
    years = days.withColumn("year", F.year("day"))
    told = materialize(profile.merged(years, ["side", "year"], ["sender_id"], ["amount"]), "years")
    exact = (
        rows.withColumn("year", F.year("timestamp")).join(F.broadcast(told.select("side", "year", "amount_median")), ["side", "year"])
        .groupBy("side", "year").agg(
            F.count_distinct("sender_id").alias("senders"),
            F.count_if(F.col("amount") < F.col("amount_median")).alias("below"),
            F.count_if(F.col("amount") <= F.col("amount_median")).alias("upto"),
        )
    )
    off = F.abs(F.col("sender_id_distinct") - F.col("senders"))
    slack, half = F.lit(2 * profile.rank_error()) * F.col("n_rows") + 1, F.col("n_rows") / 2
    return told.join(exact, ["side", "year"]).select(
        "side", "year", "n_rows", "senders", F.col("amount_sum").alias("amount"),
        (off <= F.lit(3 * profile.distinct_error()) * F.col("senders")).alias("senders_near"),
        ((F.col("below") - slack <= half) & (F.col("upto") + slack >= half)).alias("median_near"),
    )


def risk_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of facts and features next to the range seen in the data."""
    ops = materialize(views.operational(spark, sf_dir), "operational")
    wide = entity.operational_to_features(ops, keep=[])
    return catalogs.seen_ranges(ops, "operational").unionByName(catalogs.seen_ranges(wide, "feature"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        read_transactions,
        labeled_dataset_from_ops,
        explode_cases,
        normalize_events,
        event_violations,
        ops_quarantine,
        feature_quarantine,
        dataset_quality_gate,
        class_overlap,
        dataset_report,
        leakage_check,
        entity_operational,
        log_operational,
        sender_concentration,
        entity_features,
        tabular_proxy,
        company_metrics,
        fifo_holding_time,
        company_concentration,
        flow_entropy,
        daily_flow,
        inflow_structure,
        counterparty_network,
        metrics_long,
        company_risk,
        factor_contributions,
        case_window,
        case_operational,
        event_gaps,
        sequence_score,
        case_graph_stats,
        case_components,
        case_walk_depth,
        case_hub_metrics,
        graph_score,
        typology_labels,
        typology_probs,
        score_cases,
        score_batch_failures,
        score_requests,
        explain_cases,
        alert_queue,
        case_bands,
        typology_levels,
        events_by_day,
        stream_case_windows,
        stream_case_state,
        stream_hopping_windows,
        train_risk_model,
        predict_risk,
        predict_from_ops,
        score_cases_model,
        risk_from_nodes,
        risk_contributions,
        feature_importance_topk,
        population_pca,
        population_layers,
        population_project,
        load_population,
        stratified_split,
        binary_metrics,
        roc_curve,
        isotonic_curve,
        platt_curve,
        calibration_report,
        feature_drift,
        compare_scores,
        bootstrap_metrics,
        bootstrap_difference,
        profile_ranges,
        risk_catalog,
    )
} | {"company_findings": findings}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: _rounded(query(configure(spark), sf_dir))

    return {name: ready(query) for name, query in QUERIES.items()}
