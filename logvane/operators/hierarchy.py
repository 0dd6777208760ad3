"""Hierarchical density clustering: no preset width, no preset number of clusters, strengths of membership.

From each point's nearest neighbours come core distances (the distance within
which ``min_size`` points lie, weights counted) and a graph whose edges weigh
the mutual reachability distance. Borůvka rounds give its minimum spanning
forest: every component picks its least outgoing edge by an aggregation, and
star contraction joins them. Going through the forest's edges by rising weight
gives the hierarchy: components below ``min_size`` are light, a cluster is born
where light ones together reach it, and two clusters that meet become the
children of a third. Clusters are kept where they last longer, weighed by their
points, than the clusters inside them (excess of mass).

The forest's edges are swept in ranges of bounded size, one task a range, that
hold the components the range touches; between ranges the endpoints of later
edges are renamed by joins. All before and after runs on one row per point.

Defined cases: points without neighbours, and components of the graph lighter
than ``min_size``, are noise. If the whole graph is one component, the root is
no cluster; if it has several, each may be one. Equal distances are ordered by
the keys of their ends, so results do not depend on the layout of the input.
Distances below ``LEAST`` count as ``LEAST``. Keys are distinct integers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logvane.operators.graph import connected_components
from logvane.operators.running import numbered
from logvane.session import materialize

NOISE = -1
LEAST = 1e-6
HIGHEST = 1 / LEAST
#: the cluster of components that are too light for one
LIGHT = -1
#: edges of the spanning forest that one task sweeps
EDGES_TOGETHER = 500_000


def reachability_edges(points: DataFrame, neighbours: DataFrame, min_size: int = 15) -> DataFrame:
    """``a, b, w`` with a < b: mutual reachability of neighbours among ``points(doc_id, weight)``.

    ``neighbours`` holds ``query_id, doc_id, distance``. A point whose listed
    neighbours weigh too little takes the distance of the farthest.
    """
    weights = points.select("doc_id", F.col("weight").cast("double").alias("weight"))
    near = neighbours.select(F.col("query_id").alias("a"), F.col("doc_id").alias("b"), F.col("distance").alias("d")).filter("a <> b")
    near = near.join(weights.select(F.col("doc_id").alias("b"), F.col("weight").alias("b_weight")), "b")
    near = near.join(weights.select(F.col("doc_id").alias("a"), F.col("weight").alias("a_weight")), "a")
    near = materialize(near, "near")
    rising = Window.partitionBy("a").orderBy("d", "b")
    reached = F.col("a_weight") + F.sum("b_weight").over(rising) >= min_size
    core = near.withColumn("enough", reached).groupBy("a").agg(
        F.when(F.first("a_weight") >= min_size, 0.0).otherwise(F.coalesce(F.min(F.when(F.col("enough"), F.col("d"))), F.max("d"))).alias("core")
    )
    core = materialize(core, "core")
    pairs = near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d"))
    # a point that lists nobody has no core distance of its own
    pairs = pairs.join(core.withColumnRenamed("core", "core_a"), "a", "left").join(core.select(F.col("a").alias("b"), F.col("core").alias("core_b")), "b", "left")
    return pairs.select("a", "b", F.greatest("d", "core_a", "core_b", F.lit(LEAST)).alias("w"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of ``a, b, w``, equal weights ordered by a and b."""
    live = materialize(edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")), "live")
    chosen = []
    while not live.isEmpty():
        ends = F.explode(F.array(
            F.struct(F.col("ca").alias("c"), F.col("cb").alias("o")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("o"))
        )).alias("e")
        best = live.select("w", "a", "b", ends).groupBy("e.c").agg(F.min(F.struct("w", "a", "b", "e.o")).alias("m"))
        best = materialize(best.select("c", "m.*"), "least")
        chosen.append(best.select("a", "b", "w").distinct())
        joined = connected_components(best.select(F.col("c").alias("a"), F.col("o").alias("b")))
        ends_a = joined.select(F.col("node").alias("ca"), F.col("component").alias("na"))
        ends_b = joined.select(F.col("node").alias("cb"), F.col("component").alias("nb"))
        # every component has an outgoing edge here; of parallel edges between two of them the least stays
        renamed = live.join(ends_a, "ca").join(ends_b, "cb").filter("na <> nb")
        live = materialize(renamed.groupBy(F.least("na", "nb").alias("ca"), F.greatest("na", "nb").alias("cb")).agg(
            F.min(F.struct("w", "a", "b")).alias("m")
        ).select("m.a", "m.b", "m.w", "ca", "cb"), "live")
    if not chosen:
        return edges.filter("false")
    forest = chosen[0]
    for more in chosen[1:]:
        forest = forest.unionByName(more)
    return forest


# ---- from the forest to clusters

_EVENT = "kind string, id long, ref long, x double, y double, flag int"


class _Sweep:
    """Components while edges are gone through by rising weight."""

    def __init__(self, states: pd.DataFrame, min_size: float, first_cluster: int):
        self.min_size, self.next_cluster = min_size, first_cluster
        self.up = {c: c for c in states["comp"].tolist()}
        # per root: weight, cluster, weighted sum of entry levels, best of the clusters inside, touched light members
        self.state = {
            c: [w, int(k), s, b, [c] if k == LIGHT else []]
            for c, w, k, s, b in zip(*(states[x].tolist() for x in ("comp", "weight", "cluster", "level_sum", "inside")))
        }
        self.events: list[tuple] = []
        # a point of enough weight is a cluster by itself, entered at the highest level
        for state in self.state.values():
            if state[1] == LIGHT and state[0] >= min_size:
                state[1] = self._born()
                self._enter(state[4], state[1], HIGHEST)
                state[2], state[4] = state[0] * HIGHEST, []

    def root(self, c: int) -> int:
        while self.up[c] != c:
            self.up[c] = self.up[self.up[c]]
            c = self.up[c]
        return c

    def _born(self) -> int:
        self.next_cluster += 1
        return self.next_cluster - 1

    def _enter(self, members: list[int], cluster: int, level: float) -> None:
        self.events += [("enter", c, cluster, level, 0.0, 0) for c in members]

    def close(self, state: list, parent: int | None, level: float, selectable: bool = True) -> float:
        """End a cluster at the level of its birth; what it and the clusters inside are worth."""
        own = state[2] - state[0] * level
        kept = selectable and own >= state[3]
        self.events.append(("cluster", state[1], parent, own, level, int(kept)))
        return own if kept else state[3]

    def join(self, a: int, b: int, distance: float) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        level, x, y = 1.0 / distance, self.state[a], self.state.pop(b)
        weight = x[0] + y[0]
        self.up[b] = a
        if x[1] == LIGHT and y[1] == LIGHT:
            members = x[4] + y[4]
            if weight < self.min_size:
                merged = [weight, LIGHT, 0.0, 0.0, members]
            else:
                cluster = self._born()
                self._enter(members, cluster, level)
                merged = [weight, cluster, weight * level, 0.0, []]
        elif LIGHT not in (x[1], y[1]):
            cluster = self._born()
            inside = self.close(x, cluster, level) + self.close(y, cluster, level)
            merged = [weight, cluster, weight * level, inside, []]
        else:
            heavy, light = (x, y) if y[1] == LIGHT else (y, x)
            self._enter(light[4], heavy[1], level)
            merged = [weight, heavy[1], heavy[2] + light[0] * level, heavy[3], []]
        self.state[a] = merged


def _swept(edges: DataFrame, states: DataFrame, min_size: float, number: int) -> DataFrame:
    """Events of one range of edges ``w, a, b, ca, cb`` with the states of the components it touches."""
    left = edges.select(F.lit(0).alias("one"), "w", "a", "b", "ca", "cb").groupBy("one")
    right = states.select(F.lit(0).alias("one"), "comp", "weight", "cluster", "level_sum", "inside").groupBy("one")

    def run(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        sweep = _Sweep(known, min_size, number << 40)
        rows = rows.sort_values(["w", "a", "b"])
        for w, ca, cb in zip(*(rows[c].tolist() for c in ("w", "ca", "cb"))):
            sweep.join(ca, cb, w)
        out = sweep.events
        out += [("state", c, s[1], s[0], s[2], 0) for c, s in sweep.state.items()]
        out += [("inside", c, None, s[3], 0.0, 0) for c, s in sweep.state.items()]
        out += [("root", c, sweep.root(c), 0.0, 0.0, 0) for c in sweep.up]
        frame = pd.DataFrame(out, columns=["kind", "id", "ref", "x", "y", "flag"])
        return frame.astype({"id": "int64", "ref": "Int64", "x": "float64", "y": "float64", "flag": "int32"})

    return left.cogroup(right).applyInPandas(run, _EVENT)


def condensed(points: DataFrame, forest: DataFrame, min_size: int = 15, together: int = EDGES_TOGETHER) -> tuple[DataFrame, DataFrame]:
    """``(entries, clusters)``: the cluster each point enters and at which level; clusters with parent, worth and whether kept."""
    forest = materialize(forest, "forest")
    size = forest.count()
    ranges = max(-(-size // together), 1)
    edges = forest if ranges == 1 else numbered(forest, ["w", "a", "b"], "place")
    part = F.lit(0) if ranges == 1 else F.floor(F.col("place") / together)
    edges = edges.select("w", "a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"), part.cast("int").alias("part"))
    states = points.select(
        F.col("doc_id").alias("comp"), F.col("weight").cast("double").alias("weight"), F.lit(LIGHT).cast("long").alias("cluster"),
        F.lit(0.0).alias("level_sum"), F.lit(0.0).alias("inside"),
    )
    labels = points.select("doc_id", F.col("doc_id").alias("comp"))
    entries, clusters = [], []
    for number in range(ranges if size else 0):
        now = edges.filter(F.col("part") == number)
        touched = now.select(F.explode(F.array("ca", "cb")).alias("comp")).distinct()
        events = materialize(_swept(now, states.join(touched, "comp"), min_size, number + 1), "swept")
        enter = events.filter("kind = 'enter'").select(F.col("id").alias("comp"), F.col("ref").alias("cluster"), F.col("x").alias("level"))
        roots = events.filter("kind = 'root'").select(F.col("id").alias("comp"), F.col("ref").alias("root"))
        entries.append(labels.join(enter, "comp").select("doc_id", "cluster", "level"))
        clusters.append(events.filter("kind = 'cluster'").select(F.col("id").alias("cluster"), F.col("ref").alias("parent"), F.col("x").alias("worth"), (F.col("flag") == 1).alias("kept")))
        fresh = events.filter("kind = 'state'").select(F.col("id").alias("comp"), F.col("x").alias("weight"), F.col("ref").alias("cluster"), F.col("y").alias("level_sum")).join(
            events.filter("kind = 'inside'").select(F.col("id").alias("comp"), F.col("x").alias("inside")), "comp")
        states = materialize(states.join(touched, "comp", "left_anti").unionByName(fresh), "states")
        if number + 1 < ranges:
            labels = materialize(labels.join(enter, "comp", "left_anti").join(roots, "comp", "left").select(
                "doc_id", F.coalesce("root", "comp").alias("comp")), "labels")
            a, b = (roots.select(F.col("comp").alias(c), F.col("root").alias(f"n{c}")) for c in ("ca", "cb"))
            edges = materialize(edges.filter(F.col("part") > number).join(a, "ca", "left").join(b, "cb", "left").select(
                "w", "a", "b", F.coalesce("nca", "ca").alias("ca"), F.coalesce("ncb", "cb").alias("cb"), "part"), "edges")
    # points of enough weight without any edge are clusters too
    alone = numbered(states.filter((F.col("cluster") == LIGHT) & (F.col("weight") >= min_size)), ["comp"], "place").select(
        "comp", "weight", (LIGHT - 1 - F.col("place")).alias("cluster"), (F.col("weight") * HIGHEST).alias("level_sum"), "inside")
    entries.append(alone.select(F.col("comp").alias("doc_id"), "cluster", F.lit(HIGHEST).alias("level")))
    # the clusters that are left were born at level 0; one that holds everything is the root
    last = states.filter(F.col("cluster") != LIGHT).unionByName(alone)
    several = last.limit(2).count() > 1
    clusters.append(last.select(
        "cluster", F.lit(None).cast("long").alias("parent"), F.col("level_sum").alias("worth"),
        (F.lit(several) & (F.col("level_sum") >= F.col("inside"))).alias("kept"),
    ))
    everything = entries[0]
    for more in entries[1:]:
        everything = everything.unionByName(more)
    table = clusters[0]
    for more in clusters[1:]:
        table = table.unionByName(more)
    return materialize(everything, "entries"), materialize(table, "clusters")


def _outermost(clusters: DataFrame) -> DataFrame:
    """``cluster, outer``: the kept cluster that holds it and lies in no other kept one; parents are skipped by doubling."""
    known = clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("kept"), F.col("cluster")).alias("outer"))
    while True:
        known = materialize(known, "outer")
        if known.filter("up IS NOT NULL").isEmpty():
            return known.select("cluster", "outer")
        above = known.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("outer").alias("above"))
        known = known.join(above, "up", "left").select("cluster", F.col("next").alias("up"), F.coalesce("above", "outer").alias("outer"))


def hierarchical_clusters(points: DataFrame, neighbours: DataFrame, min_size: int = 15, together: int = EDGES_TOGETHER) -> DataFrame:
    """Add ``topic`` and ``topic_prob`` to ``points(doc_id, weight, ...)``.

    Topics are numbered from 0 by falling weight, ties by smallest key; -1 is
    noise with strength 0. The strength is the level at which the point enters
    against the highest of its topic.
    """
    slim = points.select("doc_id", "weight")
    entries, clusters = condensed(slim, spanning_forest(reachability_edges(slim, neighbours, min_size)), min_size, together)
    placed = materialize(entries.join(_outermost(clusters), "cluster").filter("outer IS NOT NULL").select("doc_id", "outer", "level").join(slim, "doc_id"), "placed")
    sizes = placed.groupBy("outer").agg(F.sum("weight").alias("size"), F.min("doc_id").alias("first"), F.max("level").alias("highest"))
    topics = numbered(sizes, [F.desc("size"), "first"], "topic").select("outer", F.col("topic").cast("int").alias("topic"), "highest")
    found = placed.join(topics, "outer").select("doc_id", "topic", (F.col("level") / F.col("highest")).alias("topic_prob"))
    return points.join(found, "doc_id", "left").withColumns({
        "topic": F.coalesce("topic", F.lit(NOISE)), "topic_prob": F.coalesce("topic_prob", F.lit(0.0))
    })
