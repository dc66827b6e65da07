import random

import pytest

from sleuthflow.llm import components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in list(root)}


def test_components_of_random_links(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(5, 5), (7, 8), (8, 7), (7, 8)]
    edges += [(1000 + n, 1001 + n) for n in range(60)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "u long, v long").repartition(3)
    expected = {n: r for n, r in plain([e for e in edges if e[0] != e[1]]).items() if n != r}
    assert {r.node: r.root for r in components.components(df, "u", "v").collect()} == expected
    assert components.components(df.limit(0), "u", "v").count() == 0


@pytest.fixture
def small_partitions(spark):
    """Sizes at which a few thousand rows of one key count as skewed."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "12",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rows_of_a_hub_are_split(spark, small_partitions):
    """A third of the links at one node: the join with its least neighbour deals its rows out."""
    hub = spark.range(1, 20_000).selectExpr("0L AS u", "id AS v")
    others = spark.range(0, 40_000).selectExpr("id + 100000 AS u", "id + 200000 AS v")
    starred = components._starred(hub.unionByName(others).repartition(8))
    assert len(starred.collect()) == 59_999
    assert "skew=true" in starred._jdf.queryExecution().executedPlan().toString()
