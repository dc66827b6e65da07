import random
from itertools import permutations

import numpy as np
import pytest

from sleuthflow.operators import graph


def random_edges(seed, cases=12):
    rng = random.Random(seed)
    rows = set()
    for c in range(cases):
        nodes = [f"n{i}" for i in range(rng.randrange(2, 9))]
        pairs = list(permutations(nodes, 2))
        for src, dst in rng.sample(pairs, min(len(pairs), rng.randrange(1, 13))):
            rows.add((f"c{c}", src, dst))
    return sorted(rows)


def by_case(rows):
    grouped = {}
    for case, src, dst in rows:
        grouped.setdefault(case, []).append((src, dst))
    return grouped


def frames(spark, rows):
    edges = spark.createDataFrame(rows, "case_id string, sender_id string, receiver_id string")
    parties = edges.selectExpr("case_id", "inline(array(struct(sender_id as node, 0 as d), struct(receiver_id as node, 1 as d)))")
    parties = parties.groupBy("case_id", "node").sum("d").withColumnRenamed("sum(d)", "in_degree")
    return edges, parties


def components(links):
    groups = []
    for src, dst in links:
        touched = [g for g in groups if src in g or dst in g]
        groups = [g for g in groups if g not in touched] + [set().union({src, dst}, *touched)]
    return len(groups)


def walk_depth(links):
    front, depth = {v for link in links for v in link}, 0
    for _ in range(8):
        front = {dst for src, dst in links if src in front}
        depth += bool(front)
    return max(depth, 1)


def shortest_paths(links, source, target):
    """All shortest paths, by trying every longer walk in turn."""
    paths = [[source]]
    nodes = {v for link in links for v in link}
    for _ in nodes:
        paths = [p + [dst] for p in paths for src, dst in links if src == p[-1] and dst not in p]
        ended = [p for p in paths if p[-1] == target]
        if ended:
            return ended
    return []


def hub_metrics(links):
    nodes = sorted({v for link in links for v in link})
    degree = {v: sum(dst == v for _, dst in links) for v in nodes}
    hub = max(nodes, key=lambda v: degree[v])
    total = 0.0
    for s, t in permutations(nodes, 2):
        if hub not in (s, t):
            paths = shortest_paths(links, s, t)
            total += sum(hub in p for p in paths) / len(paths) if paths else 0.0
    norm = (len(nodes) - 1) * (len(nodes) - 2)
    return hub, degree[hub] / len(links), total / norm if norm else 0.0


@pytest.mark.parametrize("limit", [256, 0, 5])
def test_components_and_depth(spark, limit):
    rows = random_edges(1)
    edges, _ = frames(spark, rows)
    found = {r.case_id: (r.components, r.walk_depth) for r in graph.case_shape(edges, limit=limit).collect()}
    assert found == {c: (components(links), walk_depth(links)) for c, links in by_case(rows).items()}


@pytest.mark.parametrize("limit", [256, 0])
def test_self_loops_count_the_same_on_both_ways(spark, limit):
    rows = [("a", "A", "A"), ("a", "B", "C"), ("b", "A", "A"), ("c", "A", "B"), ("c", "B", "B")]
    edges, _ = frames(spark, rows)
    found = {r.case_id: (r.components, r.walk_depth) for r in graph.case_shape(edges, limit=limit).collect()}
    assert found == {c: (components(links), walk_depth(links)) for c, links in by_case(rows).items()}
    single = {r.case_id: r.components for r in graph.case_components(edges, limit).collect()}
    assert single == {"a": 2, "b": 1, "c": 1}


@pytest.mark.parametrize("limit", [256, 4])
def test_single_measures_agree(spark, limit):
    rows = random_edges(2, cases=6)
    edges, _ = frames(spark, rows)
    groups = by_case(rows)
    parts = {r.case_id: r.components for r in graph.case_components(edges, limit).collect()}
    depth = {r.case_id: r.walk_depth for r in graph.case_walk_depth(edges, limit=limit).collect()}
    assert parts == {c: components(links) for c, links in groups.items()}
    assert depth == {c: walk_depth(links) for c, links in groups.items()}


@pytest.mark.parametrize("limit", [256, 6])
def test_hub_metrics(spark, limit):
    rows = random_edges(7, cases=10)
    edges, parties = frames(spark, rows)
    found = {r.case_id: r for r in graph.case_hub_metrics(edges, parties, limit).collect()}
    for case, links in by_case(rows).items():
        hub, share, between = hub_metrics(links)
        assert found[case].hub_node == hub
        assert found[case].hub_in_degree_share == pytest.approx(share)
        assert found[case].hub_betweenness == pytest.approx(between)


def test_long_chain_is_one_component(spark):
    rows = [("chain", f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    edges, _ = frames(spark, rows)
    assert graph.case_components(edges, limit=0).first().components == 1


@pytest.mark.parametrize("limit", [256, 0])
def test_hub_metrics_of_a_chain_a_star_and_a_loop(spark, limit):
    rows = [("chain", f"n{i}", f"n{i + 1}") for i in range(8)] + [("chain", "x", "n4")]
    rows += [("star", f"s{i}", "hub") for i in range(5)] + [("star", "hub", f"t{i}") for i in range(4)]
    rows += [("loop", "a", "b"), ("loop", "b", "c"), ("loop", "c", "a"), ("loop", "d", "b")]
    edges, parties = frames(spark, rows)
    found = {r.case_id: r.hub_betweenness for r in graph.case_hub_metrics(edges, parties, limit).collect()}
    assert found == pytest.approx({c: hub_metrics(links)[2] for c, links in by_case(rows).items()})


def test_paths_of_a_long_chain():
    chain = np.array([f"n{i:03d}" for i in range(301)])
    case = graph._Cases([chain[:-1], chain[1:2]], [chain[1:], chain[:1]])
    far, paths = case.whole(case.onward, np.array([0]))
    assert far[300] == 300 and paths[300] == 1 and (far[301:] == -1).all()
    case = graph._Cases([chain[:-1]] * 2, [chain[1:]] * 2)
    found = case.betweenness(["n150", "n000"])
    assert found == pytest.approx([150 * 150 / (300 * 299), 0.0])


def test_work_of_a_chain_follows_its_pairs():
    """Every (source, node) pair is met once: 256 edges give about 32,000 pairs, not levels times pairs."""
    chain = np.array([f"n{i:03d}" for i in range(257)])
    case = graph._Cases([chain[:-1]], [chain[1:]])
    seeds = np.arange(257)
    met = sum(len(node) for _, node, _, _ in case.levels(case.onward, seeds, np.full(257, 999)))
    assert met == 257 * 258 // 2


@pytest.mark.parametrize("chunk_pairs", [1, 40, 10**9])
def test_large_cases_in_chunks_of_sources(spark, chunk_pairs):
    rows = random_edges(7, cases=4)
    edges, parties = frames(spark, rows)
    found = {r.case_id: r.hub_betweenness for r in graph.case_hub_metrics(edges, parties, 0, chunk_pairs).collect()}
    assert found == pytest.approx({c: hub_metrics(links)[2] for c, links in by_case(rows).items()})


def test_pivots_stay_within_their_bound(spark):
    rows = random_edges(9, cases=3)
    edges, parties = frames(spark, rows)
    exact = {c: hub_metrics(links)[2] for c, links in by_case(rows).items()}
    few = {r.case_id: r.hub_betweenness for r in graph.case_hub_metrics(edges, parties, 0, pivots=3).collect()}
    assert all(abs(few[c] - exact[c]) <= graph.pivot_error(3) for c in exact)
    enough = {r.case_id: r.hub_betweenness for r in graph.case_hub_metrics(edges, parties, 0, pivots=1000).collect()}
    assert enough == pytest.approx(exact)
