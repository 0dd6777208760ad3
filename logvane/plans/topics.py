"""The topic stage: corpus, cleaning, vectors, reduction, clustering, keywords; stored topic models and their use."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logvane.functions import text as X
from logvane.functions.arrays import to_matrix
from logvane.operators import components, density, embed, hierarchy, keywords, vector_index
from logvane.operators.normalize import text_column
from logvane.session import collect_bounded, materialize, share, work_path
from logvane.sources.tables import write_stage

CORPUS_COLUMNS = ["message", "image_base", "target_image_base", "target_object"]


def with_corpus(events: DataFrame, name: str = "corpus") -> DataFrame:
    return events.withColumn(name, X.event_corpus({c: text_column(events, c) for c in CORPUS_COLUMNS}))


def distinct_documents(cleaned: DataFrame, key: str, text: str = "clean_text") -> DataFrame:
    """One row per cleaned text with its weight: logs repeat, and repeats must not be embedded again."""
    return cleaned.groupBy(text).agg(F.count("*").alias("weight"), F.min(key).alias("doc_id"))


class TopicRun(NamedTuple):
    """What a run of the topic stage found."""

    events: DataFrame
    weights: DataFrame
    docs: DataFrame
    axes: components.Components
    named: DataFrame


def _hierarchical(reduced: DataFrame, min_size: int) -> DataFrame:
    """Clusters of the hierarchy; neighbours come from an index of the reduced vectors."""
    docs = reduced.select(F.lit(0).alias("collection"), "doc_id", F.col("vector").alias("embedding"))
    index = vector_index.build_index(docs, work_path(reduced.sparkSession, "topic-index"), "l2")
    k = min_size + 1
    near = vector_index.search(
        index, docs.select(F.col("doc_id").alias("query_id"), "embedding"), docs, k, vector_index.probes_for(index, docs, k)
    )
    return hierarchy.hierarchical_clusters(reduced, near, min_size)


def fit_topics(
    anomalies: DataFrame, key: str = "event_key", dimensions: int = 5, cell_width: float = 0.2, min_size: int = 15,
    words: int = 10, shown_words: int = 8, embedder=None, method: str = "grid",
) -> TopicRun:
    """The whole stage. ``method`` is ``grid`` (cells of a preset width) or ``hierarchy`` (no preset width; real strengths)."""
    cleaned = with_corpus(anomalies).withColumn("clean_text", X.clean_text(F.col("corpus"))).drop("corpus")
    cleaned = materialize(cleaned, "cleaned")
    docs = distinct_documents(cleaned, key)
    vectors = materialize(embed.embed(docs, "clean_text", embedder=embedder), "vectors")
    axes = components.fit_components(vectors, dimensions, "embedding")
    reduced = vectors.withColumn("vector", components.project(axes, "embedding"))
    if method == "hierarchy":
        clustered = _hierarchical(materialize(reduced, "reduced"), min_size)
    else:
        clustered = density.density_clusters(reduced, axes.loadings.shape[1], cell_width, min_size)
        clustered = density.centroid_similarity(clustered, weight="weight")
    docs = materialize(clustered, "topic-docs")

    counted = keywords.term_counts(
        docs.withColumn("tokens", F.split("clean_text", " ")), weight="weight"
    )
    weights = materialize(keywords.term_weights(counted), "term-weights")
    named = keywords.keyword_text(keywords.top_terms(weights, n=min(words, shown_words)))
    events = cleaned.join(docs.select("clean_text", "topic", "topic_prob"), "clean_text").drop("clean_text")
    return TopicRun(keywords.with_keywords(events, named), weights, docs, axes, named)


def topic_stage(anomalies: DataFrame, key: str = "event_key", **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(events with topic, topic_prob and topic_keywords, term weights, distinct documents)``."""
    run = fit_topics(anomalies, key, **how)
    return run.events, run.weights, run.docs


def save_topics(weights: DataFrame, docs: DataFrame, path: str) -> None:
    """Keep the state of a topic run as tables: term weights and centroids."""
    write_stage(weights, f"{path}/terms")
    write_stage(density.centroids(docs, weight="weight"), f"{path}/centroids")


def topic_overview(events: DataFrame) -> DataFrame:
    """Topics with their size and keywords, noise left out."""
    return (
        events.filter(F.col("topic") != density.NOISE)
        .groupBy("topic", "topic_keywords").agg(F.count("*").alias("n_events"))
    )


# ---- stored models

#: topics that a model may hold: their centroids are shipped to every task
MAX_TOPICS = 100_000


class TopicModel(NamedTuple):
    """A stored version, ready to assign: axes, and per topic its centroid and the least similarity of a member."""

    path: str
    version: int
    axes: components.Components
    topics: np.ndarray
    centroids: np.ndarray
    least: np.ndarray


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The newest complete version below ``path``, None without one."""
    try:
        return spark.read.schema("version long").parquet(f"{path}/versions").agg(F.max("version")).first()[0]
    except Exception as e:  # the folder comes with the first version
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def save_model(run: TopicRun, path: str) -> int:
    """Store a run as the next version; it counts from when its number is added, so readers never see half of one."""
    spark = run.docs.sparkSession
    version = (latest_version(spark, path) or 0) + 1
    folder = f"{path}/v{version}"
    members = run.docs.filter(F.col("topic") != density.NOISE)
    middle = density.centroids(members, weight="weight")
    near = members.join(middle, "topic").groupBy("topic").agg(F.min(embed.cosine(F.col("vector"), F.col("centroid"))).alias("least"))
    axes = [(run.axes.center.tolist(), run.axes.loadings.tolist(), run.axes.explained.tolist())]
    spark.createDataFrame(axes, "center array<double>, loadings array<array<double>>, explained array<double>").write.parquet(f"{folder}/axes")
    middle.join(near, "topic").write.parquet(f"{folder}/centroids")
    run.weights.write.parquet(f"{folder}/terms")
    run.named.write.parquet(f"{folder}/keywords")
    run.docs.select("clean_text", "topic", "topic_prob").write.parquet(f"{folder}/texts")
    spark.range(version, version + 1).withColumnRenamed("id", "version").write.mode("append").parquet(f"{path}/versions")
    return version


def load_model(spark: SparkSession, path: str, version: int | None = None) -> TopicModel:
    """A stored version, the newest unless one is named."""
    version = latest_version(spark, path) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no topic model below {path}")
    folder = f"{path}/v{version}"
    axes = spark.read.parquet(f"{folder}/axes").first()
    rows = collect_bounded(spark.read.parquet(f"{folder}/centroids").orderBy("topic"), MAX_TOPICS, "topics")
    return TopicModel(
        path, version, components.Components(*(np.array(axes[c], float) for c in ("center", "loadings", "explained"))),
        np.array([r["topic"] for r in rows], np.int32), np.array([r["centroid"] for r in rows], float), np.array([r["least"] for r in rows], float),
    )


def nearest_topic(model: TopicModel, vector: str) -> Column:
    """``topic`` and ``topic_prob``: the topic with the most similar centroid and that cosine; ties go to the smaller topic.

    A vector less similar than every member of its topic was is noise.
    """
    shared = share((model.topics, model.centroids, model.least))

    @F.arrow_udf("struct<topic:int,topic_prob:double>")
    def assign(column: pa.Array) -> pa.Array:
        topics, centroids, least = shared.value
        if not len(column) or not len(topics):
            found, cosine = np.full(len(column), density.NOISE, np.int32), np.zeros(len(column))
        else:
            unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1.0)
            cosines = np.round(unit(to_matrix(column)) @ unit(centroids).T, 10)
            at = cosines.argmax(axis=1)
            cosine = cosines[np.arange(len(at)), at]
            found = np.where(cosine >= np.round(least[at], 10), topics[at], density.NOISE).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(found), pa.array(cosine)], ["topic", "topic_prob"])

    return assign(F.col(vector))


def assign_topics(events: DataFrame, model: TopicModel, embedder=None) -> DataFrame:
    """Events with ``topic, topic_prob, topic_keywords`` and ``model_version``.

    A text that the run has seen keeps the topic it got there. The others are
    embedded once per distinct text, projected and given the nearest topic.
    """
    spark, folder = events.sparkSession, f"{model.path}/v{model.version}"
    events = events.drop("topic", "topic_prob", "topic_keywords", "model_version", "clean_text", "corpus")
    cleaned = with_corpus(events).withColumn("clean_text", X.clean_text(F.col("corpus"))).drop("corpus")
    texts = spark.read.parquet(f"{folder}/texts")
    fresh = cleaned.select("clean_text").distinct().join(texts, "clean_text", "left_anti")
    placed = embed.embed(fresh, "clean_text", embedder=embedder).withColumn("vector", components.project(model.axes, "embedding"))
    given = placed.select("clean_text", nearest_topic(model, "vector").alias("found")).select("clean_text", "found.*")
    known = cleaned.join(texts.unionByName(given), "clean_text").drop("clean_text")
    return keywords.with_keywords(known, spark.read.parquet(f"{folder}/keywords")).withColumn("model_version", F.lit(model.version))
