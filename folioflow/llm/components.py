"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Everything stays distributed; each step is a pre-aggregated minimum by vertex and a join with it, so a vertex with
very many edges is only a long run of narrow rows, which adaptive execution may split. Lineage is cut by a table in
the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(a, b) with a > b -> the same components with edges to the smallest neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    if large:  # written, so that the join below has two plain shuffles and adaptive execution can split a vertex with very many edges
        least = common.materialise(least, "least")
    linked = both.join(least, "a")
    if large:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> (id, root): every vertex that has an edge, and the smallest id of its component."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    edges = common.materialise(edges, "edges")

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(edges)
    while before[0]:
        edges = common.materialise(_star(_star(edges, True), False), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    # stars now: each vertex but a root has one edge, to its root
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
