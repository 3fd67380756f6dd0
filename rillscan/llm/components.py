"""Connected components by alternating star operations on written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node ``u`` on the least of them and ``u``.

    ``large`` moves the larger neighbours, otherwise the smaller ones and ``u`` itself move.
    The least neighbour is pre-aggregated and written, so a hub's edges meet one row and
    adaptive execution may split them.
    """
    if large:
        rows = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        rows = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = written(rows.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    joined = rows.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("m").alias("a"), "b")
    else:
        out = joined.select(F.col("m").alias("a"), "b").union(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (long); the root is the least node.

    Nodes without an edge to another node have no row.  Rounds grow with the logarithm of
    the nodes of a component.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        edges = written(_stars(_stars(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == mark or not now[0]:
            break
        mark = now
    # at the fixed point every edge goes from a root to a member
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
