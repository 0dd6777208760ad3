"""Named passage collections with vectors, stored as one partitioned Parquet table."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logvane.functions.text import clean_tokens
from logvane.operators.embed import embed
from logvane.session import materialize
from logvane.sources.knowledge import landed_feeds, load_collection
from logvane.sources.tables import write_stage

#: texts, words and vectors of counts take about half of the space that the default leaves
COMPRESSION = "zstd"


def repeated_ids(docs: DataFrame) -> DataFrame:
    return docs.groupBy("collection", "doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def replace_collections(docs: DataFrame, path: str, embedder: Callable[[Column], Column] | None = None) -> None:
    """Embed ``collection, doc_id, text, meta`` and replace the collections that occur in it.

    Tokens are stored next to the vectors, since every search re-ranks by them. Collections not in ``docs`` stay as they are. Repeated ids are refused.
    """
    # ids are found by sorting texts and parsing rules: stored, that is done once
    docs = materialize(docs, "passages", COMPRESSION)
    clash = repeated_ids(docs).first()
    if clash is not None:
        raise ValueError(f"id {clash['doc_id']} occurs {clash['n']} times in {clash['collection']}")
    indexed = embed(docs.withColumn("tokens", clean_tokens(F.col("text"))), "text", embedder=embedder, tokens="tokens")
    write_stage(indexed, path, partition_by=["collection"], compression=COMPRESSION)


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("collection", "doc_id", "text", "meta", "embedding", "tokens")


def collection_counts(kb: DataFrame) -> DataFrame:
    return kb.groupBy("collection").agg(F.count("*").alias("n_docs"))


# where each feed lands below the knowledge folder
FEED_PATHS = {
    "mitre_attack": "attack.json",
    "mitre_d3fend": "d3fend.json",
    "mitre_car": "car/analytics",
    "cisa_kev": "kev.json",
    "sigma_rules": "sigma/rules",
    "msrc_cvrf": "msrc.json",
}


def build_knowledge_base(
    spark: SparkSession, root: str, path: str, feeds: dict[str, str] = FEED_PATHS, embedder=None
) -> DataFrame:
    """All landed feeds into the collections table; missing feeds are reported and skipped."""
    present, missing = landed_feeds(spark, root, feeds)
    if missing:
        warnings.warn(f"feeds not found below {root}: {', '.join(missing)}", stacklevel=2)
    parts = [load_collection(spark, c, p) for c, p in present.items()]
    if not parts:
        raise FileNotFoundError(f"no feed below {root}")
    replace_collections(reduce(DataFrame.unionByName, parts), path, embedder)
    return read_collections(spark, path)
