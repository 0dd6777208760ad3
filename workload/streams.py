"""The streaming jobs, each run over all available input and compared with its batch meaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from logvane.plans import detect
from logvane.session import work_path
from logvane.sources.ndjson import write_lines
from logvane.streaming import events as E
from workload.raw_events import LABELED_CTE, NORM_CTE, labeled, raw_lines, to_lines


def _landed(spark, sf_dir):
    """The lines as text files, the way a collector drops them."""
    root = work_path(spark, "landing")
    write_lines(raw_lines(spark, sf_dir), root)
    return root


def _event_stream(spark, sf_dir):
    """Lines derived from the events file, read as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return to_lines(events)


def stream_labels(spark, sf_dir):
    """Lines landed as files, parsed and labelled incrementally."""
    lines = E.stream_lines(spark, _landed(spark, sf_dir), "*.txt", files_per_batch=2)
    stored = E.run_to_table(E.stream_labeled(lines), "stream-labeled")
    return stored.groupBy("event_id", "hostname", "ground_truth").agg(F.count("*").alias("n_events"))


def stream_windows(spark, sf_dir):
    """Malicious events per host and hour, closed windows only."""
    labeled_stream = E.stream_labeled(_event_stream(spark, sf_dir), ["event_key"])
    closed = E.run_to_table(E.malicious_windows(labeled_stream, "1 hour", late="10 minutes"), "stream-windows")
    return closed.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "hostname", "n_events"
    )


def stream_sliding_windows(spark, sf_dir):
    labeled_stream = E.stream_labeled(_event_stream(spark, sf_dir), ["event_key"])
    closed = E.run_to_table(
        E.malicious_windows(labeled_stream, "1 hour", "30 minutes", late="10 minutes"), "stream-sliding"
    )
    return closed.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "hostname", "n_events"
    )


KEYS = ["event_id", "hostname", "process_id", "timestamp"]


def stream_first_sightings(spark, sf_dir):
    """Repeated events suppressed by key."""
    stream = E.stream_labeled(_event_stream(spark, sf_dir), ["event_key"])
    return E.run_to_table(E.first_sightings(stream, KEYS), "stream-first").select(*KEYS)


def stream_scores(spark, sf_dir):
    """Detectors fitted on the stored events, applied to the stream."""
    _, model = detect.fit_and_score(labeled(spark, sf_dir))
    scored = E.stream_scored(E.stream_labeled(_event_stream(spark, sf_dir), ["event_key"]), model)
    wanted = scored.select("event_key", "if_anomaly_score", "ocsvm_anomaly_score", "ae_anomaly_score", "is_anomaly")
    return E.run_to_table(wanted, "stream-scores")


def stream_score_checks(spark, sf_dir):
    """Every event's streamed scores and flag, and whether they are those of the batch."""
    scored, model = detect.fit_and_score(labeled(spark, sf_dir))
    names = ["if_anomaly_score", "ocsvm_anomaly_score", "ae_anomaly_score", "is_anomaly"]
    streamed = E.stream_scored(E.stream_labeled(_event_stream(spark, sf_dir), ["event_key"]), model)
    stored = E.run_to_table(streamed.select("event_key", *[F.col(n).alias(f"s_{n}") for n in names]), "stream-checks")
    same = [F.abs(F.col(n) - F.col(f"s_{n}")) < 1e-9 for n in names]
    return stored.join(scored.select("event_key", *names), "event_key").select(
        "event_key", reduce(lambda a, b: a & b, same).alias("as_batch")
    )


QUERIES = {
    f.__name__: f
    for f in [stream_labels, stream_windows, stream_sliding_windows, stream_first_sightings, stream_scores, stream_score_checks]
}


def _closed_windows(step: str, starts: str) -> str:
    return f"""WITH {LABELED_CTE},
bad AS (SELECT event_ts, hostname FROM labeled WHERE ground_truth = 1 AND event_ts IS NOT NULL),
passed AS (SELECT max(event_ts) - INTERVAL 10 MINUTE AS until FROM labeled),
placed AS (SELECT unnest({starts}) AS window_start, event_ts, hostname FROM bad)
SELECT window_start, hostname, count(*) AS n_events FROM placed
WHERE window_start + INTERVAL 1 HOUR <= (SELECT until FROM passed) GROUP BY ALL"""


ORACLES = {
    "stream_labels": f"""WITH {LABELED_CTE} SELECT event_id, hostname, ground_truth, count(*) AS n_events
        FROM labeled GROUP BY ALL""",
    "stream_windows": _closed_windows("1 hour", "[time_bucket(INTERVAL 1 HOUR, event_ts)]"),
    "stream_sliding_windows": _closed_windows(
        "30 minutes",
        "[time_bucket(INTERVAL 30 MINUTE, event_ts), time_bucket(INTERVAL 30 MINUTE, event_ts) - INTERVAL 30 MINUTE]",
    ),
    "stream_score_checks": f"WITH {LABELED_CTE} SELECT event_key, true AS as_batch FROM labeled",
    "stream_first_sightings": f"""WITH {NORM_CTE} SELECT DISTINCT event_id, hostname, process_id, "timestamp" FROM norm
        WHERE event_ts IS NOT NULL""",
}
