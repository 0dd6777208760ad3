"""Isolation forest [Liu, Ting, Zhou 2008]: trees grown in parallel groups, scoring in Arrow batches."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logvane.functions.arrays import to_matrix
from logvane.operators.sampling import hash_sample
from logvane.session import collect_bounded, share

EULER_GAMMA = 0.5772156649015329


class Forest(NamedTuple):
    """Trees as full binary heaps of a common height: row t holds tree t.

    A leaf above the last level sends every row to its left child, so a walk
    of exactly ``height`` steps ends in a slot of ``path_length``.
    """

    features: np.ndarray
    thresholds: np.ndarray
    path_length: np.ndarray
    height: int
    sample_size: int


def mean_path(n: float) -> float:
    """Average path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def grow_tree(points: np.ndarray, height: int, rng: np.random.Generator) -> tuple[list, list, list]:
    """Random axis-parallel splits until a node is pure, single or at full height."""
    inner = 2**height - 1
    features, thresholds = np.zeros(inner, dtype=np.int32), np.full(inner, np.inf)
    path = np.zeros(inner + 1)
    pending = [(0, 0, np.arange(len(points)))]
    while pending:
        node, depth, members = pending.pop()
        rows = points[members]
        usable = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(members) > 1 else []
        if depth == height or len(usable) == 0:
            slot = node
            for _ in range(depth, height):
                slot = 2 * slot + 1
            path[slot - inner] = depth + mean_path(len(members))
            continue
        feature = int(rng.choice(usable))
        split = rng.uniform(rows[:, feature].min(), rows[:, feature].max())
        goes_right = rows[:, feature] >= split
        if goes_right.all():  # the draw hit the minimum itself
            split = np.nextafter(split, np.inf)
            goes_right = rows[:, feature] >= split
        features[node], thresholds[node] = feature, split
        pending.append((2 * node + 1, depth + 1, members[~goes_right]))
        pending.append((2 * node + 2, depth + 1, members[goes_right]))
    return features.tolist(), thresholds.tolist(), path.tolist()


def draws(trees: int, sample_size: int) -> int:
    """A third more rows than places in the trees, so that every tree fills up."""
    return trees * sample_size + trees * sample_size // 3


def fit_forest(
    df: DataFrame, key: str = "event_key", vector: str = "features", trees: int = 200,
    sample_size: int = 256, seed: int = 42,
) -> Forest:
    """Grow the trees on hash-drawn samples; the result does not depend on partitioning."""
    rows = df.count()
    size = min(sample_size, rows)
    height = max(1, math.ceil(math.log2(max(size, 2))))

    wanted = draws(trees, size)
    pool = hash_sample(df.select(key, vector), key, wanted, seed) if rows > wanted else df.select(key, vector)
    if rows <= 8 * size:
        tree_ids = F.sequence(F.lit(0), F.lit(trees - 1))
    else:
        copies = F.sequence(F.lit(0), F.lit(max(1, math.ceil(wanted / rows)) - 1))
        tree_ids = F.array_distinct(
            F.transform(copies, lambda c: F.pmod(F.xxhash64(F.lit(seed + 1), c, F.col(key)), F.lit(trees)).cast("int"))
        )
    # few rows but much work per row: keep the adaptive planner from merging the trees into one task
    tasks = min(trees, df.sparkSession.sparkContext.defaultParallelism)
    drawn = pool.select(key, vector, F.explode(tree_ids).alias("tree_id")).repartition(tasks, "tree_id")
    order = Window.partitionBy("tree_id").orderBy(F.xxhash64(F.lit(seed + 2), "tree_id", key), key)
    members = drawn.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= size)

    def grow(key_values: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(key_values[0])
        group = group.sort_values("_rank")  # arrival order within a group is not fixed
        points = np.stack(group[vector].to_numpy())
        tree = grow_tree(points, height, np.random.default_rng([seed, tree_id]))
        return pd.DataFrame([(tree_id, *tree)], columns=["tree_id", "features", "thresholds", "path_length"])

    grown = members.drop(key).groupBy("tree_id").applyInPandas(
        grow, "tree_id int, features array<int>, thresholds array<double>, path_length array<double>"
    )
    found = sorted(collect_bounded(grown, trees, "trees"))
    return Forest(
        np.array([t["features"] for t in found], dtype=np.int32), np.array([t["thresholds"] for t in found]),
        np.array([t["path_length"] for t in found]), height, size,
    )


def forest_paths(forest: Forest, points: np.ndarray) -> np.ndarray:
    """Mean path length per row."""
    rows, width = points.shape
    flat = np.ascontiguousarray(points).ravel()
    base = np.arange(rows, dtype=np.intp) * width
    total = np.zeros(rows)
    inner = 2**forest.height - 1
    # the walk writes into the same buffers for all trees
    node, at, right = np.empty(rows, np.intp), np.empty(rows, np.intp), np.empty(rows, bool)
    value, limit = np.empty(rows), np.empty(rows)
    for features, thresholds, path in zip(forest.features.astype(np.intp), forest.thresholds, forest.path_length):
        node.fill(0)
        for _ in range(forest.height):
            np.take(features, node, out=at, mode="clip")
            at += base
            np.take(flat, at, out=value, mode="clip")
            np.take(thresholds, node, out=limit, mode="clip")
            np.greater_equal(value, limit, out=right)
            node += node
            node += right
            node += 1
        node -= inner
        total += np.take(path, node, out=value, mode="clip")
    return total / len(forest.features)


def forest_score(forest: Forest, vector: str = "features") -> Column:
    """Score in [-1, 0): lower is more anomalous."""
    shared = share(forest)
    normal = mean_path(forest.sample_size) or 1.0

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        points = to_matrix(column)
        if not len(points):
            return pa.array([], pa.float64())
        return pa.array(-np.exp2(-forest_paths(shared.value, points) / normal))

    return score(F.col(vector))
