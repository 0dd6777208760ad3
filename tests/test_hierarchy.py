"""Hierarchical density clustering against a plain one that splits from the top."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logvane.operators import hierarchy, retrieve, running


def by_hand(vectors, weights, k, min_size):
    """Topic and strength per point: a forest by Kruskal, split from the heaviest edge down."""
    n = len(vectors)
    dist = np.round(np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(-1)), 10)
    near = [sorted((dist[i, j], j) for j in range(n) if j != i)[:k] for i in range(n)]
    core = []
    for i in range(n):
        total, c = weights[i], 0.0 if weights[i] >= min_size else None
        for d, j in near[i]:
            total += weights[j]
            if c is None and total >= min_size:
                c = d
        core.append(near[i][-1][0] if c is None else c)
    pairs = {(min(i, j), max(i, j)) for i in range(n) for _, j in near[i]}
    edges = sorted((max(dist[a, b], core[a], core[b], hierarchy.LEAST), a, b) for a, b in pairs)
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    forest = []
    for w, a, b in edges:
        if root(a) != root(b):
            up[root(b)] = root(a)
            forest.append((w, a, b))

    def parts(nodes, links):
        group = {x: x for x in nodes}

        def top(x):
            while group[x] != x:
                x = group[x]
            return x

        for _, a, b in links:
            group[top(b)] = top(a)
        found = {}
        for x in nodes:
            found.setdefault(top(x), []).append(x)
        return [(members, [e for e in links if top(e[1]) == top(members[0])]) for members in found.values()]

    weight = lambda nodes: sum(weights[x] for x in nodes)
    level = {}

    # members of a kept cluster are all nodes it was called with
    kept = []

    def collect(nodes, links, birth, selectable):
        own, below, inside, left, rest = 0.0, 0.0, [], nodes, links
        while True:
            if not rest:
                own += weight(left) * (1 / hierarchy.LEAST - birth)
                level.update({x: 1 / hierarchy.LEAST for x in left})
                break
            w = rest[-1][0]
            sides = parts(left, rest[:-1])
            heavy = [s for s in sides if weight(s[0]) >= min_size]
            if len(heavy) == 1:
                gone = [x for s in sides if s is not heavy[0] for x in s[0]]
                own += weight(gone) * (1 / w - birth)
                level.update({x: 1 / w for x in gone})
                left, rest = heavy[0]
                continue
            own += weight(left) * (1 / w - birth)
            if heavy:
                inside = [collect(*s, 1 / w, True) for s in heavy]
                below = sum(v for v, _ in inside)
            else:
                level.update({x: 1 / w for x in left})
            break
        if selectable and own >= below:
            return own, [nodes]
        return below, [t for _, found in inside for t in found]

    components = [s for s in parts(list(range(n)), forest) if weight(s[0]) >= min_size]
    for members, links in components:
        kept += collect(members, links, 0.0, len(components) > 1)[1]
    kept.sort(key=lambda t: (-weight(t), min(t)))
    result = {x: (-1, 0.0) for x in range(n)}
    for number, nodes in enumerate(kept):
        highest = max(level[x] for x in nodes)
        result.update({x: (number, round(level[x] / highest, 9)) for x in nodes})
    return result


def blobs(seed, n, dims=2):
    rng = np.random.default_rng(seed)
    middles = rng.uniform(-10, 10, (4, dims))
    rows = [middles[i % 4] + rng.normal(scale=[0.3, 0.6, 1.0, 0.2][i % 4], size=dims) for i in range(int(n * 0.8))]
    return np.round(np.array(rows + [rng.uniform(-12, 12, dims) for _ in range(n - len(rows))]), 3)


def clustered(spark, vectors, weights, k, min_size, together=hierarchy.EDGES_TOGETHER):
    rows = [(i, v.tolist(), w, "kept") for i, (v, w) in enumerate(zip(vectors, weights))]
    points = spark.createDataFrame(rows, "doc_id long, embedding array<double>, weight long, other string").repartition(3).cache()
    queries = points.select(F.col("doc_id").alias("query_id"), "embedding")
    near = retrieve.nearest(queries, points.withColumn("collection", F.lit(0)), k + 1, "l2")
    got = hierarchy.hierarchical_clusters(points, near, min_size, together).collect()
    assert {r["other"] for r in got} <= {"kept"}
    return {r["doc_id"]: (r["topic"], round(r["topic_prob"], 9)) for r in got}


@pytest.mark.parametrize("seed,n,k,min_size,together", [(1, 300, 299, 15, 500_000), (2, 240, 12, 8, 40), (3, 200, 6, 5, 500_000)])
def test_equals_splitting_from_the_top(spark, seed, n, k, min_size, together):
    vectors = blobs(seed, n)
    expected = by_hand(vectors, [1] * n, k, min_size)
    assert clustered(spark, vectors, [1] * n, k, min_size, together) == expected
    assert len({t for t, _ in expected.values()}) > 2


def test_weights_stand_for_repeated_points(spark):
    vectors = blobs(4, 150)
    weights = np.random.default_rng(4).choice([1, 1, 2, 5, 40], 150).tolist()
    assert clustered(spark, vectors, weights, 10, 12) == by_hand(vectors, weights, 10, 12)


def test_few_points_and_none(spark):
    vectors = blobs(5, 6)
    assert set(clustered(spark, vectors, [1] * 6, 3, 15).values()) == {(-1, 0.0)}
    none = spark.createDataFrame([], "doc_id long, embedding array<double>, weight long")
    near = spark.createDataFrame([], "query_id long, doc_id long, distance double")
    assert hierarchy.hierarchical_clusters(none, near).count() == 0


def test_places_without_gaps(spark):
    df = spark.range(1_000).withColumn("x", (F.col("id") * 7919) % 1000).repartition(5)
    got = running.numbered(df, [F.desc("x")], "place").collect()
    assert {r["x"]: r["place"] for r in got} == {x: 999 - x for x in range(1_000)}
