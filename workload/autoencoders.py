"""The encoder-decoder detector over all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from logvane.operators import autoencoder
from logvane.operators import features as X
from logvane.session import materialize
from workload.raw_events import NORM_CTE
from workload.scoring import event_features

_SCORED: dict[tuple[str, str], object] = {}


def _scored(spark, sf_dir):
    """Events with their error, and the error of giving the mean for every coordinate; fitted on all events, once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SCORED:
        events, scaler = event_features(spark, sf_dir)
        rows = materialize(events.select("event_key", F.array(*X.standardized(scaler)).alias("features")), "ae-features")
        model = autoencoder.fit_autoencoder(rows, "event_key", middle=4)
        mean_error = F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x) / F.size("features")
        _SCORED[key] = materialize(rows.select("event_key", autoencoder.reconstruction_error(model).alias("error"), mean_error.alias("mean_error")), "ae-scores")
    return _SCORED[key]


def autoencoder_scores(spark, sf_dir):
    """Every event's reconstruction error."""
    return _scored(spark, sf_dir).select("event_key", "error")


def autoencoder_checks(spark, sf_dir):
    """Events scored, broken scores, and whether the model explains at least a third of what the mean leaves."""
    return _scored(spark, sf_dir).agg(
        F.count("*").alias("n_events"), F.count_distinct("event_key").alias("n_keys"),
        F.count_if(F.expr("error IS NULL OR isnan(error) OR error < 0")).alias("broken"), (F.avg("error") <= F.avg("mean_error") * 2 / 3).alias("explains"),
    )


QUERIES = {f.__name__: f for f in [autoencoder_scores, autoencoder_checks]}
ORACLES = {
    "autoencoder_checks": f"WITH {NORM_CTE} SELECT count(*) AS n_events, count(DISTINCT event_key) AS n_keys, CAST(0 AS BIGINT) AS broken, true AS explains FROM norm",
}
