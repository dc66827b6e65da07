"""A fitted tree ensemble as a table of nodes: scores by built-in expressions or in SQL, and contributions per row.

The table comes from the files in which Spark saves a model, so a score needs neither the model object nor the
machine learning library: it can be kept, compared between versions, joined, or evaluated in another engine. Its
size is bounded by the model, trees * (2 ** (depth + 1) - 1) rows, and does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sleuthflow.session import scratch_path

#: Node that is not there.
NONE = -1


def node_table(model: PipelineModel) -> DataFrame:
    """(tree, weight, node, feature, threshold, left, right, value, rows): one row per node of every tree.

    A row goes left if its feature is at most the threshold. Leaves have no feature; `value` of an inner node is
    the mean of what the rows in it were fitted to, and `rows` their number. Nodes of a tree are numbered from its
    root, 0, on without gaps.
    """
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    path = scratch_path(spark, "ensemble")
    model.stages[-1].write().save(path)
    names = F.array(*[F.lit(n) for n in model.stages[0].getInputCols()])
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").drop("metadata")
    node, inner = F.col("nodeData"), F.col("nodeData.leftChild") >= 0
    return (
        spark.read.parquet(f"{path}/data")
        .select(
            F.col("treeID").alias("tree"),
            node["id"].alias("node"),
            F.when(inner, names[node["split"]["featureIndex"]]).alias("feature"),
            F.when(inner, node["split"]["leftCategoriesOrThreshold"][0]).alias("threshold"),
            F.when(inner, node["leftChild"]).alias("left"),
            F.when(inner, node["rightChild"]).alias("right"),
            node["prediction"].alias("value"),
            node["rawCount"].alias("rows"),
        )
        .join(F.broadcast(weights), "tree")
        .select("tree", "weight", "node", "feature", "threshold", "left", "right", "value", "rows")
    )


def _packed(nodes: DataFrame, names: list[str]) -> DataFrame:
    """One row of arrays over all nodes: as long as the model, whatever the data. A leaf is its own child."""
    place = F.row_number().over(Window.orderBy("tree", "node")) - 1
    first = F.min("place").over(Window.partitionBy("tree"))
    index = F.coalesce(*[F.when(F.col("feature") == n, F.lit(k)) for k, n in enumerate(names)], F.lit(NONE))
    placed = nodes.withColumn("place", place).withColumn("first", first)
    entry = F.struct(
        "place", index.alias("feature"), F.coalesce("threshold", F.lit(0.0)).alias("threshold"),
        *[F.coalesce(F.col("first") + F.col(side), F.col("place")).alias(side) for side in ("left", "right")],
        "value", "weight", (F.col("node") == 0).alias("root"),
    )
    return placed.agg(F.sort_array(F.collect_list(entry)).alias("nodes")).select(
        *[F.col(f"nodes.{c}").alias(c) for c in ("feature", "threshold", "left", "right", "value")],
        F.transform(F.filter("nodes", lambda n: n["root"]), lambda n: F.struct(n["place"].alias("at"), n["weight"].alias("weight"))).alias("roots"),
    )


def probability_of(margin: Column) -> Column:
    """Probability that the booster's log loss gives a margin."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def predict(rows: DataFrame, nodes: DataFrame, names: list[str], depth: int) -> DataFrame:
    """`rows` with `margin` and `probability`, from built-in expressions alone.

    The arrays of the nodes are one constant of the plan. `depth` is the greatest depth of a tree. A null or NaN
    feature is above every threshold, as in the model.
    """
    packed = _packed(nodes, names)
    held = F.from_json(F.lit(packed.select(F.to_json(F.struct("*"))).first()[0]), packed.schema.simpleString())
    x = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) for n in names])
    feature, threshold, left, right, value = (held[c] for c in ("feature", "threshold", "left", "right", "value"))

    def margin_of(x: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            # A leaf asks for no feature: the comparison is null and the step stays.
            return F.when(F.get(x, feature[at]) <= threshold[at], left[at]).otherwise(right[at])

        def leaf(root: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, step)

        return F.aggregate(held["roots"], F.lit(0.0), lambda total, r: total + r["weight"] * value[leaf(r["at"])])

    # The features of a row are bound once. As plain columns they would be computed anew in every step of every tree.
    margin = F.transform(F.array(x), margin_of)[0]
    return rows.withColumn("margin", margin).withColumn("probability", probability_of(F.col("margin")))


def predict_sql(rows: str, nodes: str, key: str, names: list[str], depth: int) -> str:
    """The same scores as plain SQL over a table of rows and the node table: (key, margin, probability)."""
    x = " ".join(f"WHEN '{n}' THEN r.{n}" for n in names)
    steps = [f"s0 AS (SELECT DISTINCT r.{key}, n.tree, 0 AS node FROM {rows} r JOIN {nodes} n ON n.node = 0)"]
    for k in range(depth):
        steps.append(
            f"""s{k + 1} AS (SELECT s.{key}, s.tree, CASE WHEN n.feature IS NULL THEN s.node
            WHEN (CASE n.feature {x} END) <= n.threshold THEN n."left" ELSE n."right" END AS node
            FROM s{k} s JOIN {nodes} n ON n.tree = s.tree AND n.node = s.node JOIN {rows} r ON r.{key} = s.{key})"""
        )
    return f"""WITH {", ".join(steps)}
        SELECT {key}, margin, 1 / (1 + exp(-2 * margin)) AS probability
        FROM (SELECT s.{key}, sum(n.weight * n.value) AS margin FROM s{depth} s JOIN {nodes} n ON n.tree = s.tree AND n.node = s.node GROUP BY s.{key})"""


def contributions(rows: DataFrame, nodes: DataFrame, names: list[str], key: str) -> DataFrame:
    """(key, base, margin, and one column per feature): what every feature adds to the margin of a row.

    On its way down a tree, each step changes the mean of the node by an amount that is put to the feature asked
    there. `base` is the weighted sum of the root means; base and contributions sum to the margin. All trees of
    an Arrow batch take each step together.
    """
    held = _packed(nodes, names).first()
    feature, left, right = (np.array([NONE if v is None else v for v in held[c]], np.int64) for c in ("feature", "left", "right"))
    threshold, value = (np.array(held[c], np.float64) for c in ("threshold", "value"))
    roots, weight = (np.array(c) for c in zip(*held["roots"]))
    model = rows.sparkSession.sparkContext.broadcast((feature, left, right, threshold, value, roots.astype(np.int64), weight))
    kind = rows.schema[key].dataType.simpleString()
    fields = ", ".join([f"`{key}` {kind}", "base double", "margin double", *[f"`{n}` double" for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, left, right, threshold, value, roots, weight = model.value
        base = float(weight @ value[roots])
        for batch in batches:
            for part in (batch.slice(low, 4096) for low in range(0, batch.num_rows, 4096)):
                x = np.stack([part.column(n).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for n in names], axis=1)
                added = np.zeros((part.num_rows, len(names)))
                at = np.repeat(roots[None], part.num_rows, axis=0)
                while True:
                    row, tree = np.nonzero(feature[at] >= 0)
                    if not len(row):
                        break
                    here = at[row, tree]
                    asked = feature[here]
                    below = x[row, asked] <= threshold[here]
                    after = np.where(below, left[here], right[here])
                    np.add.at(added, (row, asked), weight[tree] * (value[after] - value[here]))
                    at[row, tree] = after
                margin = value[at] @ weight
                columns = [part.column(key), pa.array(np.full(part.num_rows, base)), pa.array(margin), *[pa.array(c) for c in added.T]]
                yield pa.RecordBatch.from_arrays(columns, [key, "base", "margin", *names])

    return rows.select(key, *names).mapInArrow(run, fields)
