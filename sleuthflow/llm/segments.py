"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut in segments of equal length; each has a mean and a standard deviation. By Cauchy-Schwarz the
inner product of two vectors is at most the sum over segments of length * (mean * mean + deviation * deviation):
the same bound that segment means and deviations give for a distance. A tile of vectors meets a block of
queries coarse to fine: pairs whose bound is below the query's k-th score are dropped at each resolution, and
only survivors are scored exactly, in integers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sleuthflow.llm.vectors import Worker, search, usable

SEGMENTS = (4, 16)
EXACT = float(1 << 53)


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Weighted means and deviations of all segments, so that a product of two rows is the bound."""
    cuts = np.linspace(0, vectors.shape[1], min(segments, vectors.shape[1]) + 1).astype(int)
    parts = []
    for low, high in zip(cuts, cuts[1:]):
        piece = vectors[:, low:high]
        weight = np.sqrt(high - low)
        parts += [piece.mean(axis=1) * weight, piece.std(axis=1) * weight]
    return np.stack(parts, axis=1)


class Segmented(Worker):
    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        super().__init__(ids, queries, k)
        self.levels = [statistics(queries, s) for s in SEGMENTS]
        self.length = np.sqrt((queries**2).sum(axis=1))

    def tile(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        needed = -self.nearest.bound()
        slack = 1e-9 * self.length * np.sqrt((vectors**2).sum(axis=1).max())
        rows, alive = np.arange(len(self.ids)), self.ids[:, None] != ids[None]
        for segments, mine in zip(SEGMENTS, self.levels):
            bound = mine[rows] @ statistics(vectors, segments).T
            alive &= bound >= (needed[rows] - slack[rows])[:, None]
            kept = alive.any(axis=1)
            rows, alive = rows[kept], alive[kept]
        columns = np.flatnonzero(alive.any(axis=0))
        if not len(rows) or not len(columns):
            return
        mine, theirs = self.queries[rows], vectors[columns]
        if np.abs(mine).max() * np.abs(theirs).max() * vectors.shape[1] < EXACT:
            score = mine @ theirs.T
        else:
            score = (mine.astype(np.int64) @ theirs.astype(np.int64).T).astype(np.float64)
        cost = np.where(alive[:, columns], -score, np.inf)
        self.nearest.add(rows, cost, ids[columns])


def top_products(
    vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64
) -> DataFrame:
    """(query_id, rank, key, score): the k highest inner products of floor(scale * x), exactly.

    Every row is a candidate but those with the query's own key. Vectors null, empty or with null or non-finite
    components take no part; zero vectors do. A query meets vectors of its own length only; null keys take no
    part. Ties go to the smaller key; repeated rows are candidates each. An empty table gives an empty one.
    Scores are exact while they stay below 2**53.
    """
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    rows = vectors.where(usable(vector) & vectors[key].isNotNull()).withColumn(vector, whole)
    found = search(rows, is_query, k, Segmented, key, vector)
    return found.select("query_id", "rank", key, (-F.col("cost")).cast("long").alias("score"))
