"""The detection stage: features, three detectors on all rows, flags, anomalies, projection, report."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.operators import boundary, components, isolation_forest, metrics
from logvane.operators.features import Scaler, feature_columns, fit_scaler, with_features
from logvane.operators.normalize import one_hot_event_ids, top_event_ids
from logvane.operators.quantiles import exact_quantiles
from logvane.operators.sampling import hash_sample
from logvane.operators.scores import combine_flags, suspicion
from logvane.session import materialize, spread_small

CONTAMINATION = 0.05
# draws of 200 trees with 256 rows each, and a third more
FIT_ROWS = isolation_forest.draws(200, 256)
FLAGS = ["if_is_anomaly", "ocsvm_is_anomaly", "ae_is_anomaly"]
LOWER_IS_WORSE = {"if_anomaly_score": True, "ocsvm_anomaly_score": True, "ae_anomaly_score": False}
MODEL_NAMES = {
    "Isolation Forest": "if_anomaly_score",
    "One-Class Boundary": "ocsvm_anomaly_score",
    "PCA Reconstruction": "ae_anomaly_score",
}


class Detectors(NamedTuple):
    """Everything needed to score new rows: bounded model state and thresholds."""

    event_ids: list[int]
    scaler: Scaler
    forest: isolation_forest.Forest
    boundary: boundary.Boundary
    components: components.Components
    if_cut: float
    ae_cut: float


def _featured(events: DataFrame, event_ids: list[int], scaler: Scaler) -> DataFrame:
    hot = [f"eid_{i}" for i in event_ids if f"eid_{i}" not in events.columns]
    return with_features(one_hot_event_ids(events, event_ids) if hot else events, scaler)


def _raw_scores(featured: DataFrame, forest, bound, pca) -> DataFrame:
    return featured.withColumns({
        "if_anomaly_score": isolation_forest.forest_score(forest),
        "ocsvm_anomaly_score": boundary.boundary_score(bound),
        "ae_anomaly_score": components.reconstruction_error(pca),
    })


def _flags(scored: DataFrame, if_cut: float, rho: float, ae_cut: float) -> DataFrame:
    flagged = scored.withColumns({
        "if_label": F.when(F.col("if_anomaly_score") < if_cut, -1).otherwise(1),
        "ocsvm_label": F.when(F.col("ocsvm_anomaly_score") < rho, -1).otherwise(1),
        "ae_is_anomaly": (F.col("ae_anomaly_score") >= ae_cut).cast("int"),
    })
    flagged = flagged.withColumns({
        "if_is_anomaly": (F.col("if_label") == -1).cast("int"),
        "ocsvm_is_anomaly": (F.col("ocsvm_label") == -1).cast("int"),
    })
    return flagged.withColumns({"is_anomaly": combine_flags(FLAGS), "anomaly_score": F.col("if_anomaly_score")})


def fit_and_score(
    events: DataFrame, contamination: float = CONTAMINATION, key: str = "event_key", columns: list[str] | None = None
) -> tuple[DataFrame, Detectors]:
    """Scores and flags for every row, and the fitted detectors.

    ``events`` should be a stored table: the fitting passes read only its feature
    columns, which costs less than storing the vectors. ``columns`` names them;
    by default the event features with one-hot ids of the most frequent events.
    The scored rows are written once, and thresholds and flags read them.
    """
    event_ids = [] if columns else sorted(top_event_ids(events))
    events = one_hot_event_ids(events, event_ids)
    scaler = fit_scaler(events, columns or feature_columns(events))
    featured = spread_small(with_features(events, scaler))
    pool = materialize(hash_sample(featured.select(key, "features"), key, FIT_ROWS), "fit-sample")
    forest = isolation_forest.fit_forest(pool, key)
    bound = boundary.fit_boundary(featured, nu=contamination, threshold=False)
    pca = components.fit_components(featured, min_explained=0.95, center=0.0)
    scored = materialize(_raw_scores(featured, forest, bound, pca).drop("features"), "scores")
    cuts = exact_quantiles(scored, ["if_anomaly_score", "ocsvm_anomaly_score", "ae_anomaly_score"], [contamination, 1 - contamination])
    if_cut, ae_cut = cuts["if_anomaly_score"][0], cuts["ae_anomaly_score"][1]
    bound = bound._replace(rho=cuts["ocsvm_anomaly_score"][0])
    model = Detectors(event_ids, scaler, forest, bound, pca, if_cut, ae_cut)
    return _flags(scored, if_cut, bound.rho, ae_cut), model


def score_with(events: DataFrame, model: Detectors) -> DataFrame:
    """Score rows, batch or stream, with fitted detectors: a projection without shuffles."""
    featured = _featured(events, model.event_ids, model.scaler)
    scored = _raw_scores(featured, model.forest, model.boundary, model.components).drop("features")
    return _flags(scored, model.if_cut, model.boundary.rho, model.ae_cut)


def projection(
    scored: DataFrame, model: Detectors, key: str = "event_key", max_rows: int | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Two principal coordinates of all rows, or of a sample of ``max_rows``, with the columns a plot colours by."""
    keep = keep or ["if_is_anomaly", "if_anomaly_score", "event_id", "hostname", "image_base"]
    featured = with_features(scored, model.scaler)
    at = components.project(components.fit_components(featured, 2))
    placed = (featured if max_rows is None else hash_sample(featured, key, max_rows)).withColumn("_at", at)
    return placed.select(key, F.col("_at")[0].alias("x"), F.col("_at")[1].alias("y"), *keep)


def detector_report(scored: DataFrame, label: str = "ground_truth") -> DataFrame:
    models = {name: suspicion(c, LOWER_IS_WORSE[c]) for name, c in MODEL_NAMES.items()}
    return metrics.report(metrics.curve(metrics.scores_long(scored, label, models)))
