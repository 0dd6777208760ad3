"""Density clustering on a grid: no preset number of clusters, sparse points are noise.

Points are folded into cells first, so identical or crowded points cost one
row, and neighbourhoods are looked up by cell key instead of by comparing
pairs of points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.operators.embed import cosine
from logvane.operators.graph import connected_components
from logvane.operators.running import numbered
from logvane.session import materialize

NOISE = -1


def grid_cell(vector: Column, width: float) -> Column:
    return F.transform(vector, lambda x: F.floor(x / F.lit(float(width))))


def _face_neighbours(cell: Column, dimensions: int) -> Column:
    """The 2d cells that share a face."""
    def shifted(axis, step):
        return F.transform(cell, lambda x, i: x + F.when(i == axis, F.lit(step)).otherwise(F.lit(0)))

    return F.array(*[shifted(axis, step) for axis in range(dimensions) for step in (-1, 1)])


def density_clusters(
    points: DataFrame, dimensions: int, cell_width: float, min_size: int = 15, key: str = "doc_id",
    vector: str = "vector", weight: str = "weight",
) -> DataFrame:
    """Add ``topic``: clusters numbered from 0 by falling weight, ties by smallest key; -1 is noise.

    A cell is core when it and its face neighbours together weigh at least
    ``min_size``; clusters are face-connected core cells; a point in a cell next
    to a core cell joins the heaviest such neighbour; clusters lighter than
    ``min_size`` are noise.
    """
    placed = points.withColumn("_cell", grid_cell(F.col(vector), cell_width))
    cells = materialize(
        placed.groupBy("_cell").agg(F.sum(weight).cast("bigint").alias("own"), F.min(key).alias("first")), "cells"
    )
    around = cells.select(
        "_cell", "own", "first", F.explode(_face_neighbours(F.col("_cell"), dimensions)).alias("at")
    ).join(
        cells.select(F.col("_cell").alias("at"), F.col("own").alias("near_own"), F.col("first").alias("near")), "at"
    )
    density = around.groupBy("first").agg(F.sum("near_own").alias("near_total"))
    core = materialize(
        cells.join(density, "first", "left")
        .filter(F.col("own") + F.coalesce(F.col("near_total"), F.lit(0)) >= min_size)
        .select("first", F.col("own").alias("core_own")), "core-cells"
    )

    # `first` names a cell: no two cells share a point
    near_core = around.join(core.withColumnsRenamed({"first": "near", "core_own": "near_core_own"}), "near")
    core_edges = near_core.join(core, "first").select(F.col("first").alias("a"), F.col("near").alias("b"))
    joined = connected_components(core_edges)
    core_labels = core.join(joined.withColumnRenamed("node", "first"), "first", "left").select(
        "first", "core_own", F.coalesce("component", "first").alias("component")
    )
    border = (
        near_core.join(core.select("first"), "first", "left_anti")
        .groupBy("first")
        .agg(F.max_by("near", F.struct("near_core_own", -F.col("near"))).alias("near"))
        .join(core_labels.select(F.col("first").alias("near"), "component"), "near")
        .select("first", "component")
    )
    labels = cells.join(core_labels.select("first", "component").unionByName(border), "first")

    sizes = (
        labels.groupBy("component").agg(F.sum("own").alias("size"), F.min("first").alias("start"))
        .filter(F.col("size") >= min_size)
    )
    topic_of = numbered(sizes, [F.desc("size"), "start"], "topic").select("component", F.col("topic").cast("int").alias("topic"))
    topics = materialize(labels.join(topic_of, "component").select("_cell", "topic"), "cell-topics")
    return placed.join(topics, "_cell", "left").withColumn(
        "topic", F.coalesce("topic", F.lit(NOISE))
    ).drop("_cell")


def centroids(points: DataFrame, by: str = "topic", vector: str = "vector", weight: str | None = None) -> DataFrame:
    """Weighted mean vector per group, summed coordinate by coordinate."""
    w = F.col(weight) if weight else F.lit(1)
    spread = points.select(by, w.alias("w"), F.posexplode(vector).alias("i", "x"))
    means = spread.groupBy(by, "i").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("x"))
    return means.groupBy(by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid")
    )


def centroid_similarity(points: DataFrame, by: str = "topic", vector: str = "vector", weight: str | None = None) -> DataFrame:
    """Add ``topic_prob``: cosine of a point to the centroid of its group."""
    middle = centroids(points, by, vector, weight)
    return points.join(middle, by).withColumn("topic_prob", cosine(F.col(vector), F.col("centroid"))).drop("centroid")
