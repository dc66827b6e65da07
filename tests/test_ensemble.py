import duckdb
import pytest
from pyspark.sql import functions as F
from test_quality import population

from sleuthflow import catalog
from sleuthflow.operators import ensemble, ml

DEPTH = 6


@pytest.fixture(scope="module")
def fitted(spark):
    rows = population(spark, 300)
    model = ml.train_risk_model(rows, trees=7)
    return model, rows.withColumn("id", F.monotonically_increasing_id()), ensemble.node_table(model).cache()


def test_node_table_is_the_model(fitted):
    model, _, nodes = fitted
    booster = model.stages[-1]
    assert nodes.count() == booster.totalNumNodes
    assert nodes.select("tree").distinct().count() == booster.getNumTrees
    assert [r.weight for r in nodes.where("node = 0").orderBy("tree").collect()] == list(booster.treeWeights)
    found = {r["feature"] for r in nodes.where("feature is not null").select("feature").distinct().collect()}
    assert found <= set(catalog.FEATURES)
    children = nodes.where("feature is null").agg(F.count("left") + F.count("right")).first()[0]
    assert children == 0


def test_expressions_and_sql_give_the_model_scores(spark, fitted):
    model, rows, nodes = fitted
    expected = {r.id: r.probability[1] for r in model.transform(rows).collect()}
    by_expression = ensemble.predict(rows, nodes, catalog.FEATURES, DEPTH)
    assert "PythonUDF" not in by_expression._jdf.queryExecution().toString()
    found = {r.id: r.probability for r in by_expression.collect()}
    assert found == pytest.approx(expected, abs=1e-12)
    db = duckdb.connect()
    db.register("rows_", rows.select("id", *catalog.FEATURES).toArrow())
    db.register("nodes_", nodes.toArrow())
    told = db.execute(ensemble.predict_sql("rows_", "nodes_", "id", catalog.FEATURES, DEPTH)).fetchall()
    assert {k: p for k, _, p in told} == pytest.approx(expected, abs=1e-12)


def test_contributions_sum_to_the_margin(fitted):
    _, rows, nodes = fitted
    margins = {r.id: r.margin for r in ensemble.predict(rows, nodes, catalog.FEATURES, DEPTH).collect()}
    told = ensemble.contributions(rows, nodes, catalog.FEATURES, "id").collect()
    assert len(told) == len(margins)
    for r in told:
        assert r.margin == pytest.approx(margins[r.id], abs=1e-12)
        assert r.base + sum(r[n] for n in catalog.FEATURES) == pytest.approx(r.margin, abs=1e-9)


def test_contributions_follow_the_path(fitted):
    """One row walked by hand over the collected nodes."""
    _, rows, nodes = fitted
    table = {(n.tree, n.node): n for n in nodes.collect()}
    row = rows.where("id % 50 = 3").first()
    expected = dict.fromkeys(catalog.FEATURES, 0.0)
    for tree in {t for t, _ in table}:
        node = table[tree, 0]
        while node.feature is not None:
            after = table[tree, node["left"] if row[node.feature] <= node.threshold else node["right"]]
            expected[node.feature] += node.weight * (after.value - node.value)
            node = after
    told = ensemble.contributions(rows.where(F.col("id") == row.id), nodes, catalog.FEATURES, "id").first()
    assert {n: told[n] for n in catalog.FEATURES} == pytest.approx(expected, abs=1e-12)


def test_missing_features_and_no_rows(spark, fitted):
    model, rows, nodes = fitted
    holes = rows.limit(20).withColumn("growth_rate", F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(float("nan")).cast("double"))
    found = {r.id: r.margin for r in ensemble.predict(holes, nodes, catalog.FEATURES, DEPTH).collect()}
    told = {r.id: r.margin for r in ensemble.contributions(holes, nodes, catalog.FEATURES, "id").collect()}
    assert found == pytest.approx(told, abs=1e-12)
    assert ensemble.predict(rows.limit(0), nodes, catalog.FEATURES, DEPTH).count() == 0
    assert ensemble.contributions(rows.limit(0), nodes, catalog.FEATURES, "id").count() == 0


def test_features_are_bound_once_for_all_trees(fitted):
    _, rows, nodes = fitted
    derived = rows.select("id", *[F.log1p(F.expm1(F.col(n))).alias(n) for n in catalog.FEATURES])
    plan = ensemble.predict(derived, nodes, catalog.FEATURES, DEPTH)._jdf.queryExecution().optimizedPlan().toString()
    step = plan[plan.index("lambdafunction"):].split("\n")[0]
    assert "array(" not in step and "EXPM1" not in step


def test_a_tree_that_is_one_leaf(spark):
    nodes = spark.createDataFrame(
        [(0, 1.0, 0, None, None, None, None, 0.25, 9), (1, 0.5, 0, "a", 1.0, 1, 2, 0.0, 9), (1, 0.5, 1, None, None, None, None, -1.0, 5), (1, 0.5, 2, None, None, None, None, 3.0, 4)],
        "tree int, weight double, node int, feature string, threshold double, left int, right int, value double, rows long",
    )
    rows = spark.createDataFrame([(1, 1.0), (2, 1.5), (3, None), (4, float("nan"))], "id long, a double")
    found = {r.id: r.margin for r in ensemble.predict(rows, nodes, ["a"], 3).collect()}
    assert found == {1: -0.25, 2: 1.75, 3: 1.75, 4: 1.75}
