"""Helpers of the vector searches: queries in bounded blocks against all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sleuthflow.functions.ranking import top_k
from sleuthflow.session import materialize

#: Bytes of query vectors that are broadcast at a time; beyond it, the next block is another pass.
BLOCK_BYTES = 2_000_000
TILE = 2048


def usable(vector: str, zero: bool = True) -> Column:
    """Not null or empty, without null, NaN or infinite components, and not zero unless `zero`."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))

    found = F.coalesce(F.size(vector) > 0, F.lit(False)) & ~F.coalesce(F.exists(vector, bad), F.lit(True))
    return found if zero else found & F.exists(vector, lambda x: x != 0)


def tiles(batches: Iterator[pa.RecordBatch], size: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of at most `size` vectors of one length each."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        for n in np.unique(lengths).tolist():
            part = batch if (lengths == n).all() else batch.filter(pa.array(lengths == n))
            for low in range(0, part.num_rows, size):
                piece = part.slice(low, size)
                values = pc.list_flatten(piece.column(1)).to_numpy(zero_copy_only=False).astype(np.float64)
                ids = piece.column(0).to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                yield ids[order], values.reshape(-1, n)[order]


class Nearest:
    """The k least (cost, id) of every query of a block so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.cost = np.full((queries, k), np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def bound(self) -> np.ndarray:
        return self.cost[:, -1]

    def add(self, rows: np.ndarray, cost: np.ndarray, ids: np.ndarray) -> None:
        """Offers a row of costs for each query in `rows`; `ids` rise along a row. Infinite costs are no offers."""
        if cost.shape[1] > self.k:
            last = np.partition(cost, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            less, tie = cost < last, cost == last
            kept = less | (tie & (tie.cumsum(axis=1) <= self.k - less.sum(axis=1, keepdims=True)))
            at = kept.nonzero()[1].reshape(len(rows), self.k)
            cost, ids = np.take_along_axis(cost, at, 1), np.take_along_axis(np.broadcast_to(ids, kept.shape), at, 1)
        cost = np.hstack([self.cost[rows], cost])
        ids = np.hstack([self.ids[rows], np.broadcast_to(ids, (len(rows), cost.shape[1] - self.k))])
        best = np.lexsort((ids, cost), axis=1)[:, : self.k]
        self.cost[rows] = np.take_along_axis(cost, best, 1)
        self.ids[rows] = np.take_along_axis(ids, best, 1)


class Worker:
    """Search of one block of queries, all of one length; `tile` takes vectors with rising ids."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.nearest = ids, queries, Nearest(len(ids), k)

    def tile(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        raise NotImplementedError


def search(
    vectors: DataFrame, is_query: Column, k: int, worker: Callable[[np.ndarray, np.ndarray, int], Worker], key: str, vector: str
) -> DataFrame:
    """(query_id, rank, key, cost): the k least costs of every query, ties to the smaller key.

    `vectors` has usable rows only. A key that is stored with several vectors asks with the least of them. Queries are stored once and taken in blocks of BLOCK_BYTES by the order
    of their keys; each block is broadcast and meets every vector in one pass, in which a task keeps k rows
    per query. Task results are ranked together; the rank filter prunes before that shuffle.
    """
    spark = vectors.sparkSession
    base = materialize(vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")), "vectors")
    asked = base.where(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    queries = materialize(asked.withColumn("length", F.size("vector")), "queries")
    count, longest = queries.agg(F.count("*"), F.max("length")).first()
    per_block = max(1, BLOCK_BYTES // (8 * (longest or 1)))
    blocks = max(1, -(-count // per_block))
    found = []
    for n in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n)
        rows = mine.select("id", "length", "vector").toArrow()
        held = {}
        for length in pc.unique(rows["length"]).to_pylist():
            part = rows.filter(pc.equal(rows["length"], length)).combine_chunks()
            flat = pc.list_flatten(part["vector"]).to_numpy().astype(np.float64)
            held[length] = (part["id"].to_numpy(), flat.reshape(-1, length))
        block = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            state = {length: worker(ids, matrix, k) for length, (ids, matrix) in block.value.items()}
            for ids, matrix in tiles(batches):
                if matrix.shape[1] in state:
                    state[matrix.shape[1]].tile(ids, matrix)
            for length, s in state.items():
                names = np.repeat(block.value[length][0], k)
                cost, ids = s.nearest.cost.ravel(), s.nearest.ids.ravel()
                good = cost < np.inf
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[good]), pa.array(ids[good]), pa.array(cost[good])], ["query_id", "id", "cost"]
                )

        found.append(base.mapInArrow(run, "query_id bigint, id bigint, cost double"))
    ranked = top_k(reduce(DataFrame.unionByName, found), ["query_id"], [F.asc("cost"), F.asc("id")], k, "rank")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "cost")
