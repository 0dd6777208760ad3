"""Event lines as a stream: the batch column functions on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvane.operators.normalize import normalize, parse_lines
from logvane.operators.rules import label
from logvane.plans import topics
from logvane.plans.detect import Detectors, score_with
from logvane.session import work_path


def stream_lines(spark: SparkSession, root: str, pattern: str = "*.json", files_per_batch: int = 1000) -> DataFrame:
    """``path, line`` for files as they land."""
    return (
        spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).text(root)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    )


def stream_labeled(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Stateless: parse, normalize and label each batch."""
    return label(normalize(parse_lines(lines), keep))


def malicious_windows(
    labeled: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes"
) -> DataFrame:
    """Malicious events per host and event-time window; rows later than ``late`` are dropped.

    Every event moves the watermark, so windows close while only benign ones arrive.
    """
    # the optimizer moves a filter below the watermark unless it names the time
    malicious = F.when(F.col("at") > F.lit("0001-01-01").cast("timestamp"), F.col("ground_truth")) == 1
    return (
        labeled.filter(F.col("event_ts").isNotNull())
        .withColumn("at", F.col("event_ts").cast("timestamp"))
        .withWatermark("at", late)
        .filter(malicious)
        .groupBy(F.window("at", window, slide).alias("w"), "hostname")
        .agg(F.count("*").alias("n_events"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "hostname", "n_events")
    )


def first_sightings(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events whose key has not been seen within the watermark."""
    return (
        events.filter(F.col("event_ts").isNotNull()).withColumn("at", F.col("event_ts").cast("timestamp"))
        .withWatermark("at", late).dropDuplicatesWithinWatermark(keys)
    )


def stream_scored(labeled: DataFrame, model: Detectors) -> DataFrame:
    """Score each batch with fitted detectors; no state, no shuffle."""
    return score_with(labeled, model)


def assign_to_table(events: DataFrame, model_path: str, path: str, state: str, embedder=None):
    """Start a stream that gives each micro-batch the topics of the newest stored model.

    A version added meanwhile is used from the next micro-batch on. A batch that
    is repeated after a failure replaces its own folder, so no event is doubled.
    Returns the started query; its results are read from ``path``.
    """
    held: dict[str, topics.TopicModel] = {}

    def assign(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = topics.latest_version(spark, model_path)
        if "model" not in held or held["model"].version != newest:
            held["model"] = topics.load_model(spark, model_path, newest)
        topics.assign_topics(batch, held["model"], embedder).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(assign).option("checkpointLocation", state).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process what is available into a Parquet table with exactly-once output, and read it."""
    spark = stream.sparkSession
    path, state = work_path(spark, name), work_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
