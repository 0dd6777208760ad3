"""The model-based detectors; their results are checked by properties in the tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from logvane.operators.sampling import hash_sample
from logvane.plans import detect
from workload.raw_events import LABELED_CTE, labeled, table

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, sf_dir):
    """Line items under a digest of their row: order and line number repeat in these tables, whole rows do not."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.withColumn("event_key", F.md5(F.to_json(F.struct(*lines.columns))))


def event_detectors(spark, sf_dir):
    """Three detectors fitted and applied to all events."""
    scored, _ = detect.fit_and_score(labeled(spark, sf_dir))
    return scored.select("event_key", *detect.LOWER_IS_WORSE, *detect.FLAGS, "is_anomaly")


def lineitem_detectors(spark, sf_dir):
    scored, _ = detect.fit_and_score(_lines(spark, sf_dir), columns=LINE_FEATURES)
    return scored.select("event_key", *detect.LOWER_IS_WORSE, *detect.FLAGS, "is_anomaly")


def event_detector_report(spark, sf_dir):
    scored, _ = detect.fit_and_score(labeled(spark, sf_dir))
    return detect.detector_report(scored)


def event_projection(spark, sf_dir):
    scored, model = detect.fit_and_score(labeled(spark, sf_dir))
    return detect.projection(scored, model)


def event_sample(spark, sf_dir):
    """A seeded sample of exactly a thousand events."""
    return hash_sample(labeled(spark, sf_dir), "event_key", 1_000).select("event_key", "event_id", "ground_truth")


def _checks(df, **counts):
    """One row per property: its name and a count."""
    row = df.agg(*[c.cast("long").alias(n) for n, c in counts.items()])
    return row.select(F.explode(F.create_map(*[x for n in counts for x in (F.lit(n), F.col(n))])).alias("property", "n"))


def _detector_checks(scored, model):
    """What must hold for all rows whatever the models have learned."""
    rules = {
        "if_is_anomaly": F.col("if_anomaly_score") < model.if_cut,
        "ocsvm_is_anomaly": F.col("ocsvm_anomaly_score") < model.boundary.rho,
        "ae_is_anomaly": F.col("ae_anomaly_score") >= model.ae_cut,
    }
    wrong = [F.col(flag) != rule.cast("int") for flag, rule in rules.items()]
    unscored = [F.col(c).isNull() for c in detect.LOWER_IS_WORSE]
    either = lambda parts: F.count_if(reduce(lambda a, b: a | b, parts))
    # at most the given share lies beyond a quantile; ties at it may lower the share
    few = [F.sum(c) <= 0.05 * F.count("*") + 1 for c in ("if_is_anomaly", "ocsvm_is_anomaly")]
    return _checks(
        scored, rows=F.count("*"), keys=F.countDistinct("event_key"), unscored=either(unscored), wrong_flags=either(wrong),
        wrong_unions=F.count_if(F.col("is_anomaly") != F.greatest(*detect.FLAGS)),
        outside_unit=F.count_if(~F.col("if_anomaly_score").between(-1, 0.5)), negative_errors=F.count_if(F.col("ae_anomaly_score") < 0),
        flagged_too_often=reduce(lambda a, b: a + b, [F.when(f, 0).otherwise(1) for f in few]),
    )


def event_detector_checks(spark, sf_dir):
    return _detector_checks(*detect.fit_and_score(labeled(spark, sf_dir)))


def lineitem_detector_checks(spark, sf_dir):
    return _detector_checks(*detect.fit_and_score(_lines(spark, sf_dir), columns=LINE_FEATURES))


def detector_report_counts(spark, sf_dir):
    """Positives and negatives of every detector's report add up to the labels."""
    scored, _ = detect.fit_and_score(labeled(spark, sf_dir))
    report = detect.detector_report(scored)
    return report.select("model", (F.col("tp") + F.col("fn")).alias("positives"), (F.col("tn") + F.col("fp")).alias("negatives"))


def projection_checks(spark, sf_dir):
    """All events are placed; principal coordinates are centred, and the first spreads at least as far."""
    scored, model = detect.fit_and_score(labeled(spark, sf_dir))
    placed = detect.projection(scored, model)
    return _checks(
        placed, rows=F.count("*"), keys=F.countDistinct("event_key"), unplaced=F.count_if(F.col("x").isNull() | F.col("y").isNull()),
        off_centre=F.when(F.abs(F.avg("x")) + F.abs(F.avg("y")) < 1e-6, 0).otherwise(1),
        second_wider=F.when(F.var_pop("y") <= F.var_pop("x") + 1e-9, 0).otherwise(1),
        related=F.when(F.abs(F.covar_pop("x", "y")) < 1e-6 * (1 + F.var_pop("x")), 0).otherwise(1),
    )


QUERIES = {
    f.__name__: f
    for f in [
        event_detectors, lineitem_detectors, event_detector_report, event_projection, event_sample, event_detector_checks,
        lineitem_detector_checks, detector_report_counts, projection_checks,
    ]
}

def _expected(source: str, zeros: list[str]) -> str:
    """The number of rows twice, as rows and as keys, and nothing that breaks a rule."""
    rows = [f"SELECT '{name}' AS property, count(*) AS n FROM {source}" for name in ("rows", "keys")]
    return " UNION ALL ".join(rows + [f"SELECT '{name}', 0" for name in zeros])


_NO_FAULTS = ["unscored", "wrong_flags", "wrong_unions", "outside_unit", "negative_errors", "flagged_too_often"]

ORACLES = {
    "event_detector_checks": f"WITH {LABELED_CTE} {_expected('labeled', _NO_FAULTS)}",
    "lineitem_detector_checks": _expected("lineitem", _NO_FAULTS),
    "detector_report_counts": f"""WITH {LABELED_CTE}, c AS (SELECT count(*) FILTER (ground_truth = 1) AS positives,
          count(*) FILTER (ground_truth = 0) AS negatives FROM labeled)
        SELECT unnest({list(detect.MODEL_NAMES)}) AS model, positives, negatives FROM c""",
    "projection_checks": f"WITH {LABELED_CTE} {_expected('labeled', ['unplaced', 'off_centre', 'second_wider', 'related'])}",
    "event_sample": f"""WITH {LABELED_CTE}, drawn AS (
          SELECT *, CAST('0x' || substr(md5('42/' || event_key), 1, 15) AS BIGINT) AS h FROM labeled)
        SELECT event_key, event_id, ground_truth FROM drawn ORDER BY h, event_key LIMIT 1000""",
}
