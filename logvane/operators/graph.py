"""Connected components by alternating star contractions [Kiveris et al. 2014]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.session import materialize


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, component`` for all end points of ``edges(a, b)``; a component is named by its smallest node.

    Every round is two aggregations and two joins on one node per row, so no
    task ever holds the neighbours of a hub; rounds grow with the logarithm of
    the graph's size. Every round is written once and read back, which cuts the
    lineage at the price of one computation; a checkpoint would compute it twice.
    """
    edges = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    last = None
    for _ in range(max_rounds):
        # larger neighbours hang on the smallest node around
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(roots, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # smaller neighbours, and the node itself, hang on the smallest of them
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(roots, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.a", "e.b")
        edges = materialize(small.filter("a <> b").distinct(), "edges")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
