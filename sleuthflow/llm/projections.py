"""Approximate nearest neighbours by low-dimensional stable projections (Sun et al. 2014).

Vectors are projected to a few dimensions by a Gaussian matrix, which is 2-stable: the squared projected
distance of two vectors, over their squared distance, follows a chi-square law. Each tile of vectors gets a
kd-tree over its projections. A query visits the leaves of the tree by rising lower bound of the projected
distance and verifies their vectors exactly, until the bound of the next leaf is so large that a vector as near
as the k-th found so far would project that far with a probability below 1 - `SURE`.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame

from sleuthflow.llm.vectors import Worker, search, usable

PROJECTED = 8
LEAF = 32
SURE = 0.99
SEED = 7


def chi_square(x: float, freedom: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term = total = math.exp(-x / 2)
    for i in range(1, freedom // 2):
        term *= x / 2 / i
        total += term
    return 1 - total


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < p else (low, middle)
    return high


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Leaves of a kd-tree: the widest dimension is cut at its median until at most `leaf` points are left."""
    open_nodes, leaves = [np.arange(len(points))], []
    while open_nodes:
        node = open_nodes.pop()
        if len(node) <= leaf:
            leaves.append(node)
            continue
        inside = points[node]
        order = np.argpartition(inside[:, np.ptp(inside, axis=0).argmax()], len(node) // 2)
        open_nodes += [node[order[: len(node) // 2]], node[order[len(node) // 2 :]]]
    return leaves


class Projected(Worker):
    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, projected: int, sure: float) -> None:
        super().__init__(ids, queries, k)
        self.matrix = np.random.default_rng(SEED).standard_normal((queries.shape[1], projected))
        self.low = queries @ self.matrix
        self.far = chi_square_quantile(sure, projected)

    def tile(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        points = vectors @ self.matrix
        leaves = kd_leaves(points)
        width = max(map(len, leaves))
        members = np.full((len(leaves), width), -1)
        for n, leaf in enumerate(leaves):
            members[n, : len(leaf)] = np.sort(leaf)
        least = np.array([points[leaf].min(axis=0) for leaf in leaves])
        most = np.array([points[leaf].max(axis=0) for leaf in leaves])
        gap = np.maximum(np.maximum(least[None] - self.low[:, None], self.low[:, None] - most[None]), 0)
        bound = np.einsum("qlm,qlm->ql", gap, gap)
        order = bound.argsort(axis=1)
        rows = np.arange(len(self.ids))
        for step in range(len(leaves)):
            leaf = order[rows, step]
            going = bound[rows, leaf] <= self.far * self.nearest.bound()[rows] ** 2
            rows, leaf = rows[going], leaf[going]
            if not len(rows):
                break
            at = members[leaf]
            away = vectors[at] - self.queries[rows][:, None]
            cost = np.sqrt(np.einsum("qvd,qvd->qv", away, away))
            cost[(at < 0) | (ids[at] == self.ids[rows][:, None])] = np.inf
            self.nearest.add(rows, cost, ids[at])


def neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    projected: int = PROJECTED,
    sure: float = SURE,
) -> DataFrame:
    """(query_id, rank, key, cost): the k nearest found of every query, by Euclidean distance in doubles.

    Every row is a candidate but those with the query's own key. Vectors null, empty, zero or with null or
    non-finite components take no part; a query meets vectors of its own length only. Null keys take no part.
    Ties go to the smaller key; repeated rows are candidates each. An empty table gives an empty one. The
    expected recall of each true neighbour is at least `sure`; `projected` must be even.
    """
    rows = vectors.where(usable(vector, zero=False) & vectors[key].isNotNull())
    return search(rows, is_query, k, partial(Projected, projected=projected, sure=sure), key, vector)
