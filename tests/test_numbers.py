import math

import numpy as np
import pytest
from plans import plan_of
from pyspark.sql import functions as F

from logvane.operators import features, metrics, quantiles, running, sampling, scores


def values(spark, numbers):
    return spark.createDataFrame([(float(x),) for x in numbers], "v double")


@pytest.mark.parametrize("direct_rows", [10, 10_000_000])
@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_quantile_equals_numpy(spark, q, direct_rows):
    numbers = np.random.default_rng(1).lognormal(size=3001)
    found = quantiles.exact_quantile(values(spark, numbers), "v", q, direct_rows)
    assert found == pytest.approx(np.quantile(numbers, q), rel=1e-12)


def test_quantile_with_a_value_on_a_third_of_the_rows(spark):
    numbers = [5.0] * 1000 + list(np.random.default_rng(2).uniform(0, 10, 2000))
    for q in (0.1, 0.5, 0.9):
        assert quantiles.exact_quantile(values(spark, numbers), "v", q, 10) == pytest.approx(np.quantile(numbers, q))


def test_quantile_of_nothing(spark):
    assert quantiles.exact_quantile(values(spark, []), "v", 0.5) is None


@pytest.mark.parametrize("rows_per_range", [50, 1_000_000])
def test_running_totals(spark, rows_per_range):
    rng = np.random.default_rng(3)
    rows = [("a", float(s), int(rng.integers(5))) for s in rng.permutation(1000)] + [("b", 7.5, 3)]
    df = spark.createDataFrame(rows, "g string, s double, n long")
    found = {(r["g"], r["s"]): r["cum_n"] for r in running.running_totals(df, ["g"], "s", ["n"], rows_per_range).collect()}
    total = 0
    for g, s, n in sorted((r for r in rows if r[0] == "a"), key=lambda r: -r[1]):
        total += n
        assert found[(g, s)] == total
    assert found[("b", 7.5)] == 3 and len(found) == len(rows)


def report(spark, pairs, **options):
    df = spark.createDataFrame([("m", float(s), y) for s, y in pairs], "model string, score double, label int")
    return metrics.report(metrics.curve(df, **options)).first()


def test_metrics_with_ties(spark):
    row = report(spark, zip([0.9, 0.8, 0.8, 0.3, 0.1, 0.1], [1, 0, 1, 0, 1, 0]))
    assert (row["roc_auc"], row["pr_auc"]) == (0.6667, 0.7222)
    # the best F1 is reached twice: the lower threshold counts
    assert (row["f1"], row["threshold"], row["precision"], row["recall"], row["fpr"]) == (0.6667, 0.1, 0.5, 1.0, 1.0)
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (0, 3, 0, 3)


def test_perfect_and_random_scores(spark):
    assert report(spark, [(i, int(i >= 50)) for i in range(100)])["roc_auc"] == 1.0
    rng = np.random.default_rng(4)
    row = report(spark, zip(rng.uniform(size=4000), rng.integers(0, 2, 4000).tolist()), rows_per_range=200)
    assert abs(row["roc_auc"] - 0.5) < 0.03


def test_one_class_only(spark):
    row = report(spark, [(0.1, 0), (0.2, 0)])
    assert row["roc_auc"] is None and row["pr_auc"] is None and row["f1"] == 0.0


def test_curve_points(spark):
    df = spark.createDataFrame([("m", 2.0, 1), ("m", 1.0, 0)], "model string, score double, label int")
    points = metrics.curve(df)
    assert sorted(tuple(r)[1:] for r in metrics.roc_points(points).collect()) == [(1.0, 1.0, 1.0), (2.0, 0.0, 1.0)]
    assert sorted(tuple(r)[1:] for r in metrics.pr_points(points).collect()) == [(1.0, 0.5, 1.0), (2.0, 1.0, 1.0)]


def test_auc_agrees_with_the_library_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(5)
    rows = [("m", float(np.round(s, 2)), int(y)) for s, y in zip(rng.normal(size=500), rng.integers(0, 2, 500))]
    df = spark.createDataFrame(rows, "model string, score double, label int")
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert metrics.report(metrics.curve(df), digits=9).first()["roc_auc"] == pytest.approx(theirs, abs=1e-8)


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.1, 3.0), (0.1, None)], "c double, x double")
    scaler = features.fit_scaler(df, ["c", "x"])
    rows = [r[0] for r in features.with_features(df, scaler).select("features").collect()]
    x = np.array([1.0, 3.0, 0.0])
    assert [r[0] for r in rows] == [0.0, 0.0, 0.0]
    assert [r[1] for r in rows] == pytest.approx((x - x.mean()) / x.std())


def test_sample_is_exact_and_independent_of_partitions(spark):
    df = spark.range(20_000).withColumnRenamed("id", "event_key")
    first = {r[0] for r in sampling.hash_sample(df.repartition(3), "event_key", 500).collect()}
    again = {r[0] for r in sampling.hash_sample(df.repartition(11), "event_key", 500).collect()}
    assert first == again and len(first) == 500
    assert sampling.hash_sample(df, "event_key", 10**6).count() == 20_000
    other = {r[0] for r in sampling.hash_sample(df, "event_key", 500, seed=7).collect()}
    assert len(first & other) < 100
    assert abs(np.mean(list(first)) - 10_000) < 1500


def test_reattach_takes_the_first_twin_and_matches_missing_keys(spark):
    labeled = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "h")], "event_key long, t string, h string")
    scored = spark.createDataFrame([(2, "a", None, 0.2), (1, "a", None, 0.1)], "event_key long, t string, h string, s double")
    found = scores.reattach_scores(labeled, scored, ["t", "h", "absent"], ["s"])
    assert [tuple(r) for r in found.orderBy("event_key").select("event_key", "s").collect()] == [(1, 0.1), (2, 0.1), (3, None)]
    assert scores.impute_benign(found, {"s": True}).filter("event_key = 3").first()["s"] == 0.1


def test_flags(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 0), (0, 0, 0)], "a int, b int, c int")
    got = df.select(scores.combine_flags(["a", "b", "c"]).alias("any"), scores.combine_flags(["a", "b", "c"], 2).alias("two"))
    assert [tuple(r) for r in got.collect()] == [(1, 0), (1, 1), (0, 0)]


def test_worst_events_are_cut_before_the_shuffle(spark):
    from logvane.plans.analyse import worst_events

    df = spark.createDataFrame([(1, 0.5, 1)], "topic int, anomaly_score double, event_key long")
    plan = plan_of(worst_events(df, 3))
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit"), "partial and final limit expected"
    assert math.isfinite(len(plan))
