"""Stored indexes of the given tables: the vector index, how much of the exact result it finds, and what it reads."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logvane.operators import hierarchy, retrieve, vector_index
from logvane.session import materialize, work_path
from workload.knowledge import ORACLES as KNOWLEDGE_SQL
from workload.knowledge import SEARCH_CTE, _kb, _nearest_shown, _queries
from workload.raw_events import table

_BUILT: dict[tuple[str, str, str], vector_index.VectorIndex] = {}


def _index(spark, sf_dir, name, docs, **how):
    """The index of a table, built once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = vector_index.build_index(docs, work_path(spark, name), **how)
    return _BUILT[key]


def _vectors(spark, sf_dir):
    """All vectors as one collection."""
    return table(spark, sf_dir, "embeddings").select(F.lit("all").alias("collection"), F.col("vec_id").alias("doc_id"), "embedding")


def indexed_passages(spark, sf_dir):
    """The five nearest documents of every language from the index with every cell probed: the exact rows."""
    kb = _kb(spark, sf_dir)
    return _nearest_shown(vector_index.search(_index(spark, sf_dir, "passages", kb), _queries(spark, sf_dir), kb))


def indexed_passages_blocked(spark, sf_dir):
    """The same through the path for query sets too large to share."""
    kb = _kb(spark, sf_dir)
    return _nearest_shown(vector_index.search(_index(spark, sf_dir, "passages", kb), _queries(spark, sf_dir), kb, max_shared=1))


def _recall(spark, sf_dir, asked="true", measured=vector_index.MEASURED):
    """For the vectors ``asked``: of their ten exact neighbours in the whole table, those that the probed cells give."""
    docs = _vectors(spark, sf_dir)
    index = _index(spark, sf_dir, "vectors", docs, fit_rows=None)
    probes = vector_index.probes_for(index, docs, 10, measured=measured)
    queries = docs.filter(asked).select(F.col("doc_id").alias("query_id"), "embedding")
    found = vector_index.search(index, queries, docs, 10, probes).select("query_id", "doc_id", F.lit(1).alias("hit"))
    exact = retrieve.nearest(queries, docs, 10).select("query_id", "doc_id")
    hits = exact.join(found, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
    return hits, probes, index, queries


def index_recall(spark, sf_dir):
    """Queries, exact neighbours, and whether nine of ten are found with the measured number of probes."""
    hits, *_ = _recall(spark, sf_dir, "doc_id % 20 = 0")
    return hits.agg(
        F.count("*").alias("n_queries"), F.sum("n_exact").alias("n_exact"), (F.sum("n_found") >= 0.9 * F.sum("n_exact")).alias("recall_reached")
    )


def index_probes(spark, sf_dir):
    """Recall of every vector as a query beside the cells probed, those there are, and the stored rows in reach."""
    hits, probes, index, queries = _recall(spark, sf_dir, measured=None)
    reach = vector_index.rows_in_reach(index, queries, _vectors(spark, sf_dir), probes)
    return hits.join(reach, "query_id", "left").select(
        "query_id", (F.col("n_found") / F.col("n_exact")).alias("recall"), F.lit(probes).alias("probes"), F.lit(index.cells).alias("cells"), "n_rows")


def index_cells(spark, sf_dir):
    """Rows by collection as the index holds them, each once."""
    docs = _vectors(spark, sf_dir)
    rows = vector_index.stored_rows(spark, _index(spark, sf_dir, "vectors", docs, fit_rows=None), docs)
    return rows.groupBy("collection").agg(F.count("*").alias("n_rows"), F.sum("doc_id").alias("id_sum"), F.count_distinct("doc_id").alias("n_ids"))


#: itself and fifteen others, as the smallest cluster has fifteen points
NEIGHBOURS = 16
_CLUSTERED: dict[tuple[str, str], object] = {}


def _hierarchical(spark, sf_dir):
    """All vectors with their clusters, made once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CLUSTERED:
        _CLUSTERED[key] = materialize(_clustered(spark, sf_dir), "hierarchical")
    return _CLUSTERED[key]


def _clustered(spark, sf_dir):
    docs = _vectors(spark, sf_dir).withColumn("weight", F.lit(1))
    index = _index(spark, sf_dir, "vectors", docs, fit_rows=None)
    queries = docs.select(F.col("doc_id").alias("query_id"), "embedding")
    near = vector_index.search(index, queries, docs, NEIGHBOURS, vector_index.probes_for(index, docs, NEIGHBOURS))
    # a unit vector's distance is that of its cosine
    near = near.withColumn("distance", F.sqrt(2 * F.greatest("distance", F.lit(0.0))))
    return hierarchy.hierarchical_clusters(docs.select("doc_id", "weight"), near)


def hierarchical_topics(spark, sf_dir):
    """Every vector's cluster in the hierarchy and its strength there; neighbours come from the index."""
    return _hierarchical(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "topic", "topic_prob")


def hierarchical_topic_checks(spark, sf_dir):
    """Broken rules of the clustering: sizes, order, numbers and strengths."""
    found = _hierarchical(spark, sf_dir)
    order = Window.partitionBy(F.lit(0)).orderBy("topic")
    # one row per topic, each checked against the one before
    topics = found.filter("topic >= 0").groupBy("topic").agg(F.count("*").alias("n"), F.max("topic_prob").alias("top"), F.min("doc_id").alias("lowest"))
    topics = topics.withColumn("before", F.lag(F.struct("topic", (-F.col("n")).alias("n"), "lowest")).over(order))
    this = F.struct((-F.col("n")).alias("n"), "lowest")
    wrong = (F.col("n") < 15) | (F.abs(F.col("top") - 1) > 1e-9) | (F.col("topic") != F.coalesce(F.col("before.topic") + 1, F.lit(0))) | F.coalesce(
        F.struct(F.col("before.n").alias("n"), F.col("before.lowest").alias("lowest")) > this, F.lit(False))
    strength = (F.col("topic_prob") < 0) | (F.col("topic_prob") > 1) | ((F.col("topic") < 0) != (F.col("topic_prob") == 0))
    points = found.select(F.col("doc_id"), F.lit(1).alias("point"), strength.alias("wrong"))
    both = points.unionByName(topics.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("point"), wrong.alias("wrong")))
    return both.agg(F.sum("point").alias("n_points"), F.count_distinct("doc_id").alias("n_ids"), F.count_if("wrong").alias("broken"))


QUERIES = {f.__name__: f for f in [
    indexed_passages, indexed_passages_blocked, index_recall, index_probes, index_cells, hierarchical_topics, hierarchical_topic_checks]}

_EXACT_TEN = """
q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
ten AS (SELECT query_id, vec_id FROM q, embeddings
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), vec_id) <= 10)"""

ORACLES = {
    "indexed_passages": KNOWLEDGE_SQL["nearest_passages"],
    "indexed_passages_blocked": f"WITH {SEARCH_CTE} SELECT query_id, collection, doc_id, round(distance, 6) AS distance, rank FROM found",
    "index_recall": f"WITH {_EXACT_TEN} SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_exact, true AS recall_reached FROM ten",
    "hierarchical_topic_checks": "SELECT count(*) AS n_points, count(DISTINCT vec_id) AS n_ids, CAST(0 AS BIGINT) AS broken FROM embeddings",
    "index_cells": "SELECT 'all' AS collection, count(*) AS n_rows, CAST(sum(vec_id) AS BIGINT) AS id_sum, count(DISTINCT vec_id) AS n_ids FROM embeddings",
}
