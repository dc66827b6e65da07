"""Graph measures per case: statistics, components, walk depth, hub betweenness.

Cases with few edges are folded from one bounded edge array; the array is cut to `limit` + 1 edges before
the shuffle, so a giant case never travels whole. Cases above the limit go through joins over their edge
tables, and both paths give the same exact result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sleuthflow.functions.ranking import top_k
from sleuthflow.functions.skew import attach
from sleuthflow.session import materialize, remove, scratch_path

SMALL_CASE_EDGES = 256
MAX_WALK = 8


def graph_columns() -> dict[str, Column]:
    """Density and hub share out of the per-case totals."""
    n, m = F.col("nodes").cast("double"), F.col("edges").cast("double")
    return {
        "density": F.when(F.col("nodes") > 1, m / (n * (n - 1))).otherwise(F.lit(0.0)),
        "hub_share": F.col("max_in_degree").cast("double") / F.greatest(m, F.lit(1.0)),
    }


def case_graph_stats(totals: DataFrame) -> DataFrame:
    """Nodes, edges, density and hub share of every case."""
    return totals.select("case_id", "nodes", "edges", *[c.alias(name) for name, c in graph_columns().items()])


def edge_arrays(edges: DataFrame, limit: int = SMALL_CASE_EDGES) -> DataFrame:
    """(case, its edges) of every case with at most `limit` edges."""
    first = top_k(edges, ["case_id"], [F.asc("sender_id"), F.asc("receiver_id")], limit + 1)
    link = F.struct(F.col("sender_id").alias("src"), F.col("receiver_id").alias("dst"))
    return (
        first.groupBy("case_id")
        .agg(F.collect_list(link).alias("links"))
        .where(F.size("links") <= limit)
    )


def _nodes(links: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(links, lambda e: F.array(e["src"], e["dst"]))))


def components_of(links: Column) -> Column:
    """Number of weakly connected components: each edge merges the node groups it touches."""

    def merge(groups: Column, edge: Column) -> Column:
        ends = F.array(edge["src"], edge["dst"])
        joined = F.array_union(F.flatten(F.filter(groups, lambda g: F.arrays_overlap(g, ends))), ends)
        return F.concat(F.filter(groups, lambda g: ~F.arrays_overlap(g, ends)), F.array(joined))

    return F.size(F.aggregate(links, F.array().cast("array<array<string>>"), merge))


def walk_depth_of(links: Column, cap: int = MAX_WALK) -> Column:
    """Longest walk, at most `cap`: how often the set of reached nodes can step on before it is empty.

    Each step counts the set it starts from, which spares computing the next set twice; the first count
    is for the start itself and is taken off at the end.
    """
    start = F.struct(_nodes(links).alias("front"), F.lit(-1).alias("depth"))

    def counted(state: Column) -> Column:
        return state["depth"] + (F.size(state["front"]) > 0).cast("int")

    def step(state: Column, _: Column) -> Column:
        onward = F.filter(links, lambda e: F.array_contains(state["front"], e["src"]))
        front = F.array_distinct(F.transform(onward, lambda e: e["dst"]))
        return F.struct(front.alias("front"), counted(state).alias("depth"))

    steps = F.sequence(F.lit(1), F.lit(cap))
    return F.greatest(F.aggregate(steps, start, step, counted), F.lit(1))


def _large_edges(edges: DataFrame, limit: int) -> DataFrame | None:
    """Edges of the cases with more than `limit` of them, or None if there are none."""
    sizes = edges.groupBy("case_id").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > limit)
    if sizes.isEmpty():
        return None
    return materialize(
        attach(edges.select("case_id", "sender_id", "receiver_id"), sizes, "case_id", ["sender_id", "receiver_id"])
        .select("case_id", F.col("sender_id").alias("src"), F.col("receiver_id").alias("dst")),
        "large-case-edges",
    )


def _minimum_neighbour(pairs: DataFrame) -> DataFrame:
    """Each (case, u, v) with the least node next to u; hub nodes are cut in slices."""
    node = F.struct("case_id", "u").alias("at")
    keyed = pairs.select(node, "v")
    least = keyed.groupBy("at").agg(F.min("v").alias("least"), F.count("*").alias("n_rows"))
    return attach(keyed, least, "at", ["v"]).select("at.case_id", "at.u", "v", "least")


def _star_rounds(edges: DataFrame) -> DataFrame:
    """(case, node, root) of every node by alternating large-star and small-star (Kiveris et al. 2014)."""
    links = edges.where(F.col("src") != F.col("dst")).select(
        "case_id", F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).distinct()
    while True:
        both = links.unionByName(links.select("case_id", F.col("v").alias("u"), F.col("u").alias("v")))
        hub = F.least("u", "least")
        large = (
            _minimum_neighbour(both).where(F.col("v") > F.col("u")).select("case_id", F.col("v").alias("u"), hub.alias("v"))
        ).distinct()
        small = _minimum_neighbour(large).select(
            "case_id",
            F.inline(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("least").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("least").alias("v")),
                )
            ),
        )
        following = materialize(small.where(F.col("u") != F.col("v")).distinct(), "star-round")
        changed = following.join(links, ["case_id", "u", "v"], "left_anti").isEmpty()
        same = changed and links.join(following, ["case_id", "u", "v"], "left_anti").isEmpty()
        links = following
        if same:
            return links


def case_components(edges: DataFrame, limit: int = SMALL_CASE_EDGES) -> DataFrame:
    """Weakly connected components per case; a node with nothing but a self loop is one of its own."""
    arrays = edge_arrays(edges, limit)
    counted = arrays.select("case_id", components_of(F.col("links")).cast("bigint").alias("components"))
    rest = _large_edges(edges, limit)
    if rest is None:
        return counted
    return counted.unionByName(_components_by_joins(rest))


def _components_by_joins(edges: DataFrame) -> DataFrame:
    """Nodes of the case less those that hang below a root, so that nodes with self loops alone are counted."""
    nodes = edges.select("case_id", "src").union(edges.select("case_id", "dst")).distinct()
    below = _star_rounds(edges).groupBy("case_id").agg(F.count("*").alias("_below"))
    return (
        nodes.groupBy("case_id")
        .agg(F.count("*").alias("_nodes"))
        .join(below, "case_id", "left")
        .select("case_id", (F.col("_nodes") - F.coalesce("_below", F.lit(0))).alias("components"))
    )


def case_walk_depth(edges: DataFrame, cap: int = MAX_WALK, limit: int = SMALL_CASE_EDGES) -> DataFrame:
    """Longest walk per case, at least 1 and at most `cap`; any cycle reaches the cap."""
    arrays = edge_arrays(edges, limit)
    small = arrays.select("case_id", walk_depth_of(F.col("links"), cap).alias("walk_depth"))
    rest = _large_edges(edges, limit)
    if rest is None:
        return small
    return small.unionByName(_walk_by_joins(rest, cap))


def _walk_by_joins(edges: DataFrame, cap: int) -> DataFrame:
    """Frontier of distinct nodes per step; a node appears once, so a step is at most one pass over the edges."""
    front = edges.select("case_id", F.col("dst").alias("src")).distinct()
    reached = [edges.select("case_id", F.lit(1).alias("walk_depth")).distinct()]
    for depth in range(2, cap + 1):
        onward = edges.join(front, ["case_id", "src"], "left_semi")
        front = materialize(onward.select("case_id", F.col("dst").alias("src")).distinct(), "walk-front")
        reached.append(front.select("case_id", F.lit(depth).alias("walk_depth")).distinct())
    deepest = reached[0]
    for level in reached[1:]:
        deepest = deepest.unionByName(level)
    return deepest.groupBy("case_id").agg(F.max("walk_depth").alias("walk_depth"))


def case_shape(edges: DataFrame, limit: int = SMALL_CASE_EDGES) -> DataFrame:
    """Components and walk depth together, from one pass over the edge arrays."""
    arrays = edge_arrays(edges, limit)
    links = F.col("links")
    small = arrays.select(
        "case_id", components_of(links).cast("bigint").alias("components"), walk_depth_of(links).alias("walk_depth")
    )
    rest = _large_edges(edges, limit)
    if rest is None:
        return small
    return small.unionByName(_components_by_joins(rest).join(_walk_by_joins(rest, MAX_WALK), "case_id"))


#: Pairs (source, node) of large cases that are stored at a time.
CHUNK_PAIRS = 200_000_000
HUB_SCHEMA = "case_id string, hub_betweenness double"


def hub_nodes(parties: DataFrame) -> DataFrame:
    """Node with the most incoming edges (lowest id on a tie) and its share of all incoming edges."""
    best = top_k(parties, ["case_id"], [F.desc("in_degree"), F.asc("node")], 1)
    totals = parties.groupBy("case_id").agg(F.sum("in_degree").alias("in_total"), F.count("*").alias("nodes"))
    return best.select("case_id", F.col("node").alias("hub_node"), "in_degree").join(totals, "case_id").select(
        "case_id",
        "hub_node",
        (F.col("in_degree").cast("double") / F.greatest("in_total", F.lit(1)).cast("double")).alias("hub_in_degree_share"),
        "nodes",
    )


def case_hub_metrics(
    edges: DataFrame, parties: DataFrame, limit: int = SMALL_CASE_EDGES, chunk_pairs: int = CHUNK_PAIRS, pivots: int | None = None
) -> DataFrame:
    """Hub, its in-degree share and its normalised directed betweenness.

    `chunk_pairs` and `pivots` are those of large cases (see `_betweenness_by_joins`).
    """
    hubs = hub_nodes(parties)
    arrays = edge_arrays(edges, limit)
    ends = [F.col(f"links.{end}").alias(end) for end in ("src", "dst")]
    small = arrays.join(hubs, "case_id").select("case_id", "hub_node", *ends)
    between = small.mapInPandas(_betweenness_batches(), HUB_SCHEMA)
    rest = _large_edges(edges, limit)
    if rest is not None:
        between = between.unionByName(_betweenness_by_joins(rest, hubs, chunk_pairs, pivots))
    return hubs.join(between, "case_id", "left").select(
        "case_id",
        "hub_node",
        "hub_in_degree_share",
        F.coalesce("hub_betweenness", F.lit(0.0)).alias("hub_betweenness"),
    )


class _Cases:
    """Graphs of many small cases side by side; a pair (source, node) of one case has a place in one flat table."""

    def __init__(self, sources: list[np.ndarray], targets: list[np.ndarray]) -> None:
        named = [np.unique(np.concatenate(both).astype(str), return_inverse=True) for both in zip(sources, targets)]
        self.names = [names for names, _ in named]
        self.counts = np.array([len(n) for n in self.names])
        self.first = self.counts.cumsum() - self.counts
        src = np.concatenate([at[: len(s)] + f for (_, at), s, f in zip(named, sources, self.first)])
        dst = np.concatenate([at[len(s) :] + f for (_, at), s, f in zip(named, sources, self.first)])
        src, dst = np.unique(np.stack([src, dst])[:, src != dst], axis=1)
        self.case = np.repeat(np.arange(len(self.counts)), self.counts)
        squares = self.counts**2
        # Row of a source: the place of its pair with the first node of its case.
        local = np.arange(len(self.case)) - self.first[self.case]
        self.row = (squares.cumsum() - squares)[self.case] + local * self.counts[self.case]
        self.pairs = int(squares.sum())
        self.onward, self.back = (self._sorted(*ends) for ends in ((src, dst), (dst, src)))

    def _sorted(self, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends): ends of the edges of node n are ends[starts[n] : starts[n + 1]]."""
        order = src.argsort(kind="stable")
        return np.searchsorted(src[order], np.arange(len(self.case) + 1)), dst[order]

    def levels(self, edges: tuple[np.ndarray, np.ndarray], seeds: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(source, node, distance, shortest paths) level by level from every seed, each up to its distance `most`.

        A pair is met once, so the work of a seed is at most the edges of its case, whatever the depth.
        """
        starts, ends = edges
        met = np.zeros(self.pairs, bool)
        source, node, paths, depth = seeds, seeds, np.ones(len(seeds)), 0
        met[self.row[source] + node - self.first[self.case[node]]] = True
        limit = np.zeros(len(self.case), np.int64)
        limit[seeds] = most
        while len(source):
            yield source, node, depth, paths
            depth += 1
            going = limit[source] >= depth
            source, node, paths = source[going], node[going], paths[going]
            degree = starts[node + 1] - starts[node]
            at = np.repeat(starts[node] - (degree.cumsum() - degree), degree) + np.arange(degree.sum())
            source, paths, node = np.repeat(source, degree), np.repeat(paths, degree), ends[at]
            key = self.row[source] + node - self.first[self.case[node]]
            fresh = ~met[key]
            key, place, inverse = np.unique(key[fresh], return_index=True, return_inverse=True)
            source, node = source[fresh][place], node[fresh][place]
            paths = np.bincount(inverse, weights=paths[fresh], minlength=len(key))
            met[key] = True

    def whole(self, edges: tuple[np.ndarray, np.ndarray], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance and paths of every node from the one seed of its case; unreachable ones have distance -1."""
        far, paths = np.full(len(self.case), -1), np.zeros(len(self.case))
        for _, node, depth, n in self.levels(edges, seeds, np.full(len(seeds), len(self.case))):
            far[node], paths[node] = depth, n
        return far, paths

    def betweenness(self, hubs: list[str]) -> np.ndarray:
        """Share of the shortest paths between other nodes that lead through the hub of each case."""
        hub = self.first + np.array([np.searchsorted(names, h) for names, h in zip(self.names, hubs)])
        to_hub, paths_in = self.whole(self.back, hub)
        from_hub, paths_on = self.whole(self.onward, hub)
        farthest = np.zeros(len(self.counts), np.int64)
        np.maximum.at(farthest, self.case, from_hub)
        seeds = np.flatnonzero((to_hub > 0) & (farthest[self.case] > 0))
        total = np.zeros(len(self.counts))
        for source, node, depth, paths in self.levels(self.onward, seeds, to_hub[seeds] + farthest[self.case[seeds]]):
            through = (from_hub[node] > 0) & (to_hub[source] + from_hub[node] == depth) & (node != source)
            source, node = source[through], node[through]
            share = paths_in[source] * paths_on[node] / paths[through]
            total += np.bincount(self.case[source], weights=share, minlength=len(total))
        others = (self.counts - 1) * (self.counts - 2)
        return np.where(others > 0, total / np.maximum(others, 1), 0.0)


#: Pairs of nodes that small cases handled together may have.
PAIRS_AT_ONCE = 4_000_000


def _betweenness_batches():
    """Batch function for small cases: share of shortest paths through the hub, over all pairs of other nodes."""

    def batches(frames):
        for frame in frames:
            sources, targets = frame["src"].tolist(), frame["dst"].tolist()
            # A case of n edges has at most 2 n nodes.
            pairs = np.array([4 * len(s) ** 2 for s in sources], np.int64)
            part = (pairs.cumsum() - pairs) // PAIRS_AT_ONCE
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sources)]
            found = [
                _Cases(sources[low:high], targets[low:high]).betweenness(frame["hub_node"].tolist()[low:high])
                for low, high in zip(edges, edges[1:])
                if high > low
            ]
            yield frame[["case_id"]].assign(hub_betweenness=np.concatenate(found) if found else [])

    return batches


def _levels(edges: DataFrame, seeds: DataFrame, root: str | None = None) -> DataFrame:
    """Breadth-first levels from each (case, source): (case, source, node, dist, paths), one join per level.

    Every level is written once beside the earlier ones. `seeds` may have `most`, the distance up to which its
    source is followed.
    """
    spark = edges.sparkSession
    root = root or scratch_path(spark, "bfs")
    bounded = seeds if "most" in seeds.columns else seeds.withColumn("most", F.lit(None).cast("int"))
    columns = ["case_id", "source", "node", "dist", "paths", "most"]
    level = bounded.select(
        "case_id", "source", F.col("source").alias("node"), F.lit(0).alias("dist"), F.lit(1.0).alias("paths"), "most"
    )
    schema, depth = level.schema, 0
    while True:
        level.write.parquet(f"{root}/level={depth}")
        level = spark.read.schema(schema).parquet(f"{root}/level={depth}")
        found = spark.read.schema(schema).parquet(*[f"{root}/level={d}" for d in range(depth + 1)])
        if level.isEmpty():
            return found.select(*columns[:-1])
        depth += 1
        level = (
            level.where(F.coalesce(F.col("most") >= depth, F.lit(True)))
            .withColumnRenamed("node", "src")
            .join(edges, ["case_id", "src"])
            .groupBy("case_id", "source", F.col("dst").alias("node"), "most")
            .agg(F.sum("paths").alias("paths"))
            .join(found, ["case_id", "source", "node"], "left_anti")
            .select("case_id", "source", "node", F.lit(depth).alias("dist"), "paths", "most")
        )


def pivot_error(pivots: int, miss: float = 0.05) -> float:
    """Bound on the error of a betweenness from `pivots` sources that holds with a chance of 1 - `miss` (Hoeffding).

    A source adds at most the number of nodes it can reach beside the hub, so its share is between 0 and 1.
    """
    return math.sqrt(math.log(2 / miss) / (2 * pivots))


def _betweenness_by_joins(
    edges: DataFrame, hubs: DataFrame, chunk_pairs: int = CHUNK_PAIRS, pivots: int | None = None
) -> DataFrame:
    """Hub betweenness of large cases. Only nodes that reach the hub are taken as sources.

    Sources are taken in chunks, so that no more than about `chunk_pairs` (source, node) pairs are stored at a
    time; a chunk leaves one number per case and its levels are removed. With `pivots`, so many sources of a case
    stand for all of them (see `pivot_error`); without, the result is exact.
    """
    spark = edges.sparkSession
    cases = edges.select("case_id").distinct()
    hub = hubs.join(cases, "case_id", "left_semi").select("case_id", F.col("hub_node").alias("source"))
    forward = materialize(
        _levels(edges, hub).where(F.col("dist") > 0).select("case_id", "node", F.col("dist").alias("from_hub"), F.col("paths").alias("paths_on")),
        "from-hub",
    )
    backward = _levels(edges.select("case_id", F.col("dst").alias("src"), F.col("src").alias("dst")), hub).select(
        "case_id", F.col("node").alias("source"), F.col("dist").alias("to_hub"), F.col("paths").alias("paths_in")
    )
    # Beyond the hub's farthest node no path leads through the hub, so nothing behind that distance is kept.
    farthest = forward.groupBy("case_id").agg(F.max("from_hub").alias("_far"))
    sources = backward.where(F.col("to_hub") > 0).join(farthest, "case_id").withColumn("most", F.col("to_hub") + F.col("_far")).drop("_far")
    if pivots is not None:
        sizes = sources.groupBy("case_id").agg(F.count("*").alias("_all"))
        sources = top_k(sources, ["case_id"], [F.xxhash64("case_id", "source"), F.col("source")], pivots, "_rank").drop("_rank").join(sizes, "case_id")
        sources = sources.withColumn("weight", F.greatest(F.col("_all") / F.lit(pivots), F.lit(1.0))).drop("_all")
    else:
        sources = sources.withColumn("weight", F.lit(1.0))
    reached = hubs.select("case_id", "nodes")
    sources = materialize(sources, "sources")
    pairs = sources.join(reached, "case_id").agg(F.sum("nodes")).first()[0] or 0
    chunks = max(1, -(-int(pairs) // chunk_pairs))
    totals = []
    for n in range(chunks):
        mine = sources if chunks == 1 else sources.where(F.pmod(F.xxhash64("case_id", "source"), F.lit(chunks)) == n)
        root = scratch_path(spark, "bfs")
        reach = _levels(edges, mine.select("case_id", "source", "most"), root)
        through = (
            reach.where(F.col("node") != F.col("source"))
            .join(forward, ["case_id", "node"])
            .join(mine, ["case_id", "source"])
            .where(F.col("dist") == F.col("to_hub") + F.col("from_hub"))
            .groupBy("case_id")
            .agg(F.sum(F.col("weight") * F.col("paths_in") * F.col("paths_on") / F.col("paths")).alias("total"))
        )
        totals.append(materialize(through, "through"))
        remove(spark, root)
    through = reduce(DataFrame.unionByName, totals).groupBy("case_id").agg(F.sum("total").alias("total"))
    norm = (F.col("nodes") - 1) * (F.col("nodes") - 2)
    return (
        hubs.join(through, "case_id")
        .select("case_id", (F.col("total") / norm.cast("double")).alias("hub_betweenness"))
    )
