"""Connected components of an edge table by alternating large-star and small-star (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sleuthflow.session import materialize


def _starred(links: DataFrame) -> DataFrame:
    """Every (u, v) with the least neighbour of u.

    The one-row-per-node side is stored first: an aggregate between shuffle and join would keep adaptive
    execution from splitting the rows of a hub node.
    """
    least = materialize(links.groupBy("u").agg(F.min("v").alias("least")), "least")
    return links.join(least, "u")


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) of every node that has an edge to another; the root is the least node of its component.

    Each round is written to the shared folder, which cuts lineage; rounds grow with the logarithm of the
    longest chain. Self loops, nulls, repeated and mirrored edges change nothing; no edges give no rows.
    """
    links = materialize(
        edges.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct(),
        "links",
    )
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(
            _starred(both).where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
            .distinct(),
            "large",
        )
        pairs = F.array(F.struct(F.col("u"), F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))
        small = _starred(large).select(F.inline(pairs)).where(F.col("u") != F.col("v")).distinct()
        following = materialize(small, "links")
        moved = following.exceptAll(links).isEmpty() and links.exceptAll(following).isEmpty()
        links = following
        if moved:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
