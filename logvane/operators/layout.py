"""A neighbour-preserving map of vectors in the plane: attraction along a neighbour graph, sampled repulsion.

The graph is a table of nearest neighbours, from the exact search or from an
index. Its edges get fuzzy weights: the nearest neighbour of a point weighs
one, the others fall off with their distance against the point's own scale, and
the two directions of an edge are joined. The map starts from given places (the
projection on two components) and moves in rounds. A round is a handful of
joins on the table of places: every point is drawn to its neighbours and pushed
from a few others, drawn by a hash of point, round and number, and its moves
are summed by one aggregation. No point's edges are ever held together, places
stay a table, and the same input gives the same map on any cluster.

How well neighbourhoods survive is measured as trustworthiness, for all points
against all rows; the pairs are compared in blocks and never held together.

Defined cases: a point without neighbours is only pushed. Equal vectors keep
distinct places only if their starts differ. Keys are distinct; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logvane.operators.retrieve import MATRIX_VALUES, _matrix, _unit, blocks_met, nearest
from logvane.operators.running import numbered
from logvane.session import BROADCAST_ROWS, materialize

ROUNDS, PUSHED, PUSH = 60, 5, 1.0
SPREAD = 10.0


def fuzzy_edges(neighbours: DataFrame) -> DataFrame:
    """``i, j, w`` in both directions from ``query_id, doc_id, distance``."""
    near = neighbours.select(F.col("query_id").alias("i"), F.col("doc_id").alias("j"), F.col("distance").alias("d")).filter("i <> j")
    # a point lists a fixed number of neighbours
    own = Window.partitionBy("i")
    scaled = near.withColumn("gap", F.col("d") - F.min("d").over(own)).withColumn("scale", F.avg("gap").over(own))
    one_way = scaled.select("i", "j", F.when(F.col("scale") > 0, F.exp(-F.col("gap") / F.col("scale"))).otherwise(1.0).alias("w"))
    both = one_way.unionByName(one_way.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    # a or b, as probabilities: 1 - (1 - a)(1 - b)
    return both.groupBy("i", "j").agg((F.sum("w") - F.when(F.count("*") > 1, F.product("w")).otherwise(0.0)).alias("w"))


def _round(places: DataFrame, edges: DataFrame, number: int, step: float, n: int, push: float) -> DataFrame:
    """Places after one round; a large table of places is sorted into its joins, not sent through the driver in every round."""
    if n > BROADCAST_ROWS:
        places = places.hint("merge")
    there = places.select(F.col("place").alias("t_place"), F.col("doc_id").alias("j"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    here = places.select(F.col("doc_id").alias("i"), "x", "y")
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    squared = dx * dx + dy * dy
    zero = F.lit(0.0)
    pull = -2.0 * F.col("w") / (1.0 + squared)
    drawn = edges.join(there.drop("t_place"), "j").join(here, "i").select(
        "i", (pull * dx).alias("ax"), (pull * dy).alias("ay"), F.col("w").alias("aw"), zero.alias("rx"), zero.alias("ry"), zero.alias("rn"))
    others = F.transform(F.sequence(F.lit(1), F.lit(PUSHED)), lambda k: F.pmod(F.xxhash64("place", F.lit(number), k), F.lit(n)))
    shove = 2.0 / ((0.01 + squared) * (1.0 + squared))
    met = places.select(F.col("doc_id").alias("i"), "x", "y", "place", F.explode(others).alias("t_place")).filter("place <> t_place").join(there, "t_place")
    far = lambda c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), c))
    pushed = met.select("i", zero.alias("ax"), zero.alias("ay"), zero.alias("aw"), far(shove * dx).alias("rx"), far(shove * dy).alias("ry"), F.lit(1.0).alias("rn"))
    moves = drawn.unionByName(pushed).groupBy("i").agg(*[F.sum(c).alias(c) for c in ("ax", "ay", "aw", "rx", "ry", "rn")])
    mean = lambda s, c: F.coalesce(F.col(s) / F.nullif(F.col(c), zero), zero)
    moved = places.join(moves.withColumnRenamed("i", "doc_id"), "doc_id", "left")
    return moved.select(
        "doc_id", "place", *[(F.col(p) + step * (mean(f"a{p}", "aw") + push * mean(f"r{p}", "rn"))).alias(p) for p in ("x", "y")])


def embed_neighbours(starts: DataFrame, neighbours: DataFrame, rounds: int = ROUNDS, push: float = PUSH) -> DataFrame:
    """``doc_id, x, y``: the map of ``starts(doc_id, x, y)`` after some rounds with falling steps."""
    places = numbered(starts.select("doc_id", "x", "y"), ["doc_id"], "place")
    size = places.agg(F.count("*").alias("n"), F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("r")).first()
    if not size["n"]:
        return starts.select("doc_id", "x", "y")
    scale = SPREAD / size["r"] if size["r"] else 1.0
    places = materialize(places.withColumns({c: F.col(c) * scale for c in ("x", "y")}), "places")
    edges = materialize(fuzzy_edges(neighbours), "edges")
    for number in range(rounds):
        places = materialize(_round(places, edges, number, 1.0 - number / rounds, size["n"], push), "places")
    return places.select("doc_id", "x", "y")


def trustworthiness(points: DataFrame, k: int = 10, metric: str = "l2", judged: int | None = None) -> DataFrame:
    """One row: ``n_judged`` points and the trustworthiness of ``points(doc_id, embedding, x, y)`` for them.

    All points are judged, or the ``judged`` ones with the smallest hashes of their keys. A neighbour in the map that is none
    in space costs its rank in space beyond k; ranks are counted over all rows, a pair of blocks at a time.
    """
    points = points.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"), F.array("x", "y").alias("map"), F.lit(0).alias("collection"))
    n, width = points.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if 2 * n - 3 * k - 1 <= 0:
        return points.sparkSession.createDataFrame([(0, 1.0)], "n_judged long, trustworthiness double")
    some = points if judged is None else points.orderBy(F.xxhash64("doc_id"), "doc_id").limit(judged)
    flat = nearest(some.select(F.col("doc_id").alias("query_id"), F.col("map").alias("embedding")), points.select("doc_id", "collection", F.col("map").alias("embedding")), k + 1, "l2")
    order = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    pairs = flat.filter("query_id <> doc_id").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("query_id", "doc_id")
    others = pairs.join(points.select("doc_id", F.col("embedding").alias("to")), "doc_id").groupBy("query_id").agg(F.collect_list("to").alias("tos"))
    asked = others.join(some.select(F.col("doc_id").alias("query_id"), "embedding"), "query_id")
    kind, unit = dict(points.dtypes)["doc_id"], _unit if metric == "cosine" else (lambda m: m)

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """How far each point's neighbours of the map are in space."""
        for batch in batches:
            limits = [np.sqrt(((unit(np.stack(tos).astype(float)) - unit(own[None].astype(float))) ** 2).sum(1)) for own, tos in zip(batch["embedding"], batch["tos"])]
            yield batch[["query_id", "embedding"]].assign(limits=limits)

    asked = materialize(asked.mapInPandas(reach, f"query_id {kind}, embedding array<double>, limits array<double>"), "judged")
    columns = [f"n{i}" for i in range(k)]

    def closer(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame(columns=["query_id", *columns])
        froms, vectors = unit(_matrix(asked["embedding"])), unit(_matrix(rows["embedding"]))
        ids, keys, own = asked["query_id"].to_numpy(), rows["doc_id"].to_numpy(), (vectors**2).sum(1)
        limits = np.zeros((len(ids), k))
        for i, found in enumerate(asked["limits"]):
            limits[i, : len(found)] = found
        counts = np.zeros((len(ids), k), np.int64)
        step = max(1, MATRIX_VALUES // len(keys))
        for start in range(0, len(ids), step):
            part, limit = froms[start : start + step], limits[start : start + step]
            squared = (part**2).sum(1)[:, None] + own[None, :] - 2.0 * part @ vectors.T
            # all but few rows are beyond the farthest neighbour
            q, at = np.nonzero(squared < limit.max(axis=1, keepdims=True) ** 2)
            other = ids[start + q] != keys[at]
            q, near = q[other], np.sqrt(np.maximum(squared[q[other], at[other]], 0.0))
            for i in range(k):
                counts[start : start + step, i] = np.bincount(q[near < limit[q, i] - 1e-9], minlength=len(part))
        return pd.DataFrame(counts, columns=columns).assign(query_id=ids)[["query_id", *columns]]

    met = blocks_met(asked, points.select("doc_id", "embedding"), "query_id", "doc_id", width)
    sums = met.applyInPandas(closer, ", ".join([f"query_id {kind}", *[f"{c} long" for c in columns]])).groupBy("query_id").agg(*[F.sum(c).alias(c) for c in columns])
    # a rank is one more than the rows that are closer
    cost = reduce(Column.__add__, [F.greatest(F.col(c) + 1 - k, F.lit(0)) for c in columns])
    share = 2.0 / (F.col("n_judged") * k * (2 * n - 3 * k - 1))
    return sums.agg(F.count("*").alias("n_judged"), F.sum(cost).alias("cost")).select(
        "n_judged", F.when(F.col("n_judged") > 0, 1.0 - F.col("cost") * share).otherwise(1.0).alias("trustworthiness"))
