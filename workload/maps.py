"""The neighbour-preserving map of flagged events, and how well neighbourhoods survive."""

from __future__ import annotations

from pyspark.sql import functions as F

from logvane.operators import components, layout, vector_index
from logvane.operators import features as X
from logvane.session import materialize, work_path
from workload.scoring import SCORED_CTE, event_features, simple_scores

NEIGHBOURS = 15
ROUNDS = 20
_MAPS: dict[tuple[str, str], object] = {}


def _map(spark, sf_dir):
    """Flagged events with their standardized features and places, mapped once per session.

    Features that many events share would be one place many times over, so equal ones are one point of the map.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MAPS:
        events, scaler = event_features(spark, sf_dir)
        flagged = simple_scores(spark, sf_dir).filter("is_anomaly = 1").select("event_key")
        rows = events.join(flagged, "event_key").select("event_key", F.array(*[F.round(z, 6) for z in X.standardized(scaler)]).alias("embedding"))
        rows = materialize(rows, "map-rows")
        points = materialize(rows.groupBy("embedding").agg(F.xxhash64(F.first("embedding")).alias("doc_id")), "map-points")
        axes = components.fit_components(points, 2, "embedding")
        starts = points.withColumn("p", components.project(axes, "embedding")).select(
            "doc_id", "embedding", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
        docs = points.withColumn("collection", F.lit(0))
        # nothing of the map hangs on a draw of points: centroids and probes are those of all
        index = vector_index.build_index(docs, work_path(spark, "map-index"), "l2", fit_rows=None)
        queries = points.select(F.col("doc_id").alias("query_id"), "embedding")
        probes = vector_index.probes_for(index, docs, NEIGHBOURS + 1, measured=None)
        near = vector_index.search(index, queries, docs, NEIGHBOURS + 1, probes)
        places = layout.embed_neighbours(starts, near, ROUNDS)
        _MAPS[key] = rows, materialize(starts.drop("x", "y").join(places, "doc_id"), "map-places")
    return _MAPS[key]


def neighbour_map(spark, sf_dir):
    """Every flagged event's place."""
    rows, places = _map(spark, sf_dir)
    return rows.join(places.drop("doc_id"), "embedding").select("event_key", "x", "y")


def neighbour_map_quality(spark, sf_dir):
    """Events placed, and whether the neighbourhoods of all points of the map can be trusted by nine in ten."""
    rows, places = _map(spark, sf_dir)
    trust = layout.trustworthiness(places, 10).first()["trustworthiness"]
    placed = rows.join(places.filter("NOT isnan(x) AND NOT isnan(y)").drop("doc_id"), "embedding", "left")
    return placed.agg(F.count("*").alias("n_events"), F.count("x").alias("n_placed"), F.lit(trust >= 0.9).alias("trusted"))


QUERIES = {f.__name__: f for f in [neighbour_map, neighbour_map_quality]}
ORACLES = {
    "neighbour_map_quality": f"WITH {SCORED_CTE} SELECT count(*) AS n_events, count(*) AS n_placed, true AS trusted FROM scored WHERE is_anomaly = 1",
}
