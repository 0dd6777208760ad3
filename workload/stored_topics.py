"""Topic runs that are stored, loaded and applied: what is assigned against what the run and the stored tables say."""

from __future__ import annotations

from pyspark.sql import functions as F

from logvane.functions import text as X
from logvane.operators import components, embed, retrieve
from logvane.plans import topics as T
from logvane.session import materialize, work_path
from logvane.streaming.events import assign_to_table
from workload.scoring import SCORED_CTE, simple_scores

_RUNS: dict[tuple[str, str], tuple] = {}


def _stored(spark, sf_dir):
    """Flagged events, a run over two thirds of them (by the hash of their keys), and its stored model; once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        flagged = materialize(simple_scores(spark, sf_dir).filter("is_anomaly = 1"), "flagged")
        run = T.fit_topics(flagged.filter(F.crc32(F.col("event_key").cast("string").cast("binary")) % 3 != 0))
        path = work_path(spark, "topic-model")
        T.save_model(run, path)
        _RUNS[key] = flagged, run, path
    return _RUNS[key]


def assigned_topics(spark, sf_dir):
    """Every flagged event with its topic from the stored model."""
    flagged, _, path = _stored(spark, sf_dir)
    return T.assign_topics(flagged, T.load_model(spark, path)).select("event_key", "topic", "topic_prob", "topic_keywords", "model_version")


def _by_the_tables(spark, flagged, path, version):
    """Topics as the stored tables give them: by text, else by an exact search among the stored centroids."""
    folder = f"{path}/v{version}"
    texts, centers = spark.read.parquet(f"{folder}/texts"), spark.read.parquet(f"{folder}/centroids")
    cleaned = T.with_corpus(flagged).select("event_key", X.clean_text(F.col("corpus")).alias("clean_text"))
    fresh = cleaned.select("clean_text").distinct().join(texts, "clean_text", "left_anti")
    vectors = embed.embed(fresh, "clean_text").withColumn(
        "vector", components.project(T.load_model(spark, path, version).axes, "embedding")).select(F.col("clean_text").alias("query_id"), F.col("vector").alias("embedding"))
    near = retrieve.nearest(vectors, centers.select(F.lit(0).alias("collection"), F.col("topic").alias("doc_id"), F.col("centroid").alias("embedding")), 1)
    near = near.join(centers.select(F.col("topic").alias("doc_id"), "least"), "doc_id")
    given = near.select(F.col("query_id").alias("clean_text"), F.when(F.round(1 - F.col("distance"), 9) >= F.round("least", 9), F.col("doc_id")).cast("int").alias("topic"))
    # noise where no topic is near enough, or none exists
    given = fresh.join(given, "clean_text", "left").select("clean_text", F.coalesce("topic", F.lit(-1)).alias("topic"))
    return cleaned.join(texts.select("clean_text", "topic").unionByName(given), "clean_text").select("event_key", F.col("topic").alias("wanted"))


def assigned_topic_checks(spark, sf_dir):
    """Flagged events, those whose topic is not that of the stored tables, and those that changed the topic their run gave."""
    flagged, run, path = _stored(spark, sf_dir)
    model = T.load_model(spark, path)
    got = T.assign_topics(flagged, model).select("event_key", "topic", "topic_prob")
    wanted = _by_the_tables(spark, flagged, path, model.version)
    before = run.events.select("event_key", F.col("topic").alias("old"), F.col("topic_prob").alias("old_prob"))
    both = got.join(wanted, "event_key", "left").join(before, "event_key", "left")
    return both.agg(
        F.count("*").alias("n_events"), F.count_if(~F.col("topic").eqNullSafe(F.col("wanted"))).alias("not_nearest"),
        F.count_if(F.col("old").isNotNull() & ((F.col("old") != F.col("topic")) | (F.col("old_prob") != F.col("topic_prob")))).alias("changed"),
    )


def streamed_topic_checks(spark, sf_dir):
    """The same events as a stream: those that the batch places otherwise."""
    flagged, _, path = _stored(spark, sf_dir)
    landing, out, state = (work_path(spark, n) for n in ("topic-landing", "topic-stream", "topic-state"))
    flagged.repartition(3).write.parquet(landing)
    assign_to_table(spark.readStream.schema(flagged.schema).option("maxFilesPerTrigger", 2).parquet(landing), path, out, state).awaitTermination()
    streamed = spark.read.parquet(out).select("event_key", F.col("topic").alias("streamed"), F.col("topic_keywords").alias("streamed_words"))
    both = T.assign_topics(flagged, T.load_model(spark, path)).join(streamed, "event_key", "full")
    same = F.col("topic").eqNullSafe(F.col("streamed")) & F.col("topic_keywords").eqNullSafe(F.col("streamed_words"))
    return both.agg(F.count("*").alias("n_events"), F.count_if(~same).alias("differ"))


QUERIES = {f.__name__: f for f in [assigned_topics, assigned_topic_checks, streamed_topic_checks]}

ORACLES = {
    "assigned_topic_checks": f"WITH {SCORED_CTE} SELECT count(*) AS n_events, CAST(0 AS BIGINT) AS not_nearest, CAST(0 AS BIGINT) AS changed FROM scored WHERE is_anomaly = 1",
    "streamed_topic_checks": f"WITH {SCORED_CTE} SELECT count(*) AS n_events, CAST(0 AS BIGINT) AS differ FROM scored WHERE is_anomaly = 1",
}
