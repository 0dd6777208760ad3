import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logvane.operators import boundary, components, isolation_forest, sampling
from logvane.plans import detect
from logvane.session import TooLarge, collect_bounded, materialize


@pytest.fixture(scope="module")
def cloud(spark):
    """A tight cloud with five far-out points, keys 0 to 4."""
    rng = np.random.default_rng(0)
    points = rng.normal(size=(3000, 4))
    points[:5] = [[9, 9, 9, 9], [-9, 9, -9, 9], [9, -9, 9, -9], [-8, -8, 8, 8], [12, 0, 0, -12]]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "event_key long, features array<double>").cache()


def test_forest_finds_planted_outliers(cloud):
    forest = isolation_forest.fit_forest(cloud, trees=100)
    scored = cloud.withColumn("score", isolation_forest.forest_score(forest))
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert -1.0 <= low < high < 0.0
    # a tree sees a planted point in one of twelve samples, so its rank is near the top, not exact
    worst = {r["event_key"] for r in scored.orderBy("score").limit(15).collect()}
    assert {0, 1, 2, 3, 4} <= worst


@pytest.mark.parametrize("rows", [60, 3000])
def test_forest_does_not_depend_on_partitions(cloud, rows):
    part = cloud.filter(F.col("event_key") < rows)
    a = isolation_forest.fit_forest(part.repartition(1), trees=20)
    b = isolation_forest.fit_forest(part.repartition(7), trees=20)
    assert np.array_equal(a.thresholds, b.thresholds) and np.array_equal(a.path_length, b.path_length)
    assert len(a.features) == 20


def test_mean_path_of_known_sizes():
    assert isolation_forest.mean_path(1) == 0.0 and isolation_forest.mean_path(2) == 1.0
    assert isolation_forest.mean_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_walk_agrees_with_plain_descent():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(256, 3))
    features, thresholds, path = isolation_forest.grow_tree(points, 8, rng)
    forest = isolation_forest.Forest(np.array([features]), np.array([thresholds]), np.array([path]), 8, 256)

    def descend(x):
        node = 0
        while node < 255:
            node = 2 * node + 1 + int(x[features[node]] >= thresholds[node])
        return path[node - 255]

    assert isolation_forest.forest_paths(forest, points) == pytest.approx([descend(x) for x in points])


def test_boundary_controls_the_share_and_finds_outliers(cloud):
    model = boundary.fit_boundary(cloud, nu=0.05)
    scored = cloud.withColumn("score", boundary.boundary_score(model)).withColumn("out", F.col("score") < model.rho)
    assert scored.agg(F.avg(F.col("out").cast("int"))).first()[0] == pytest.approx(0.05, abs=0.01)
    assert scored.filter("event_key < 5 AND out").count() == 5


def test_components_equal_svd(cloud):
    points = np.array([r["features"] for r in cloud.collect()])
    model = components.fit_components(cloud, 2)
    _, _, axes = np.linalg.svd(points - points.mean(axis=0), full_matrices=False)
    assert np.abs(model.loadings.T) == pytest.approx(np.abs(axes[:2]), abs=1e-8)
    largest = np.abs(model.loadings).argmax(axis=0)
    assert (model.loadings[largest, [0, 1]] > 0).all()
    errors = cloud.select("event_key", components.reconstruction_error(model).alias("e")).orderBy("event_key").collect()
    centered = points - points.mean(axis=0)
    expected = ((centered - centered @ axes[:2].T @ axes[:2]) ** 2).mean(axis=1)
    assert [r["e"] for r in errors] == pytest.approx(expected)


def test_all_components_leave_no_error(cloud):
    model = components.fit_components(cloud, 4, min_explained=1.0)
    assert cloud.select(components.reconstruction_error(model).alias("e")).agg(F.max("e")).first()[0] < 1e-20


@pytest.fixture(scope="module")
def stage(spark):
    rng = np.random.default_rng(2)
    rows = [
        (i, int(rng.choice([1, 3, 10, 13])), 2, int(rng.integers(2)), 3, 5, 1, int(rng.integers(1000)),
         int(rng.integers(20, 90)), f"h{i % 4}", "a.exe", int(i % 10 == 0))
        for i in range(2000)
    ]
    schema = (
        "event_key long, event_id long, severity_value long, is_system int, process_depth int, hour_of_day int, "
        "day_of_week int, granted_access long, message_len int, hostname string, image_base string, ground_truth int"
    )
    return spark.createDataFrame(rows, schema).cache()


def test_detection_stage(spark, stage):
    scored, model = detect.fit_and_score(stage)
    assert scored.count() == 2000, "every row is scored"
    shares = scored.agg(*[F.avg(f) for f in [*detect.FLAGS, "is_anomaly"]]).first()
    assert all(abs(s - 0.05) <= 0.01 for s in shares[:3]) and max(shares[:3]) <= shares[3] <= sum(shares[:3])
    assert scored.filter("anomaly_score <> if_anomaly_score").count() == 0
    assert scored.filter("(if_label = -1) <> (if_is_anomaly = 1)").count() == 0

    again = detect.score_with(stage.repartition(5), model).withColumnRenamed("if_anomaly_score", "again")
    both = scored.join(again.select("event_key", "again", F.col("is_anomaly").alias("flag")), "event_key")
    assert both.filter("again <> if_anomaly_score OR flag <> is_anomaly").count() == 0

    report = {r["model"]: r for r in detect.detector_report(scored).collect()}
    assert set(report) == set(detect.MODEL_NAMES)
    assert all(abs(r["roc_auc"] - 0.5) < 0.1 for r in report.values()), "labels are unrelated to the features"

    placed = detect.projection(scored, model, max_rows=300)
    assert placed.count() == 300 and {"x", "y", "if_is_anomaly", "hostname"} <= set(placed.columns)


def test_bounded_collect_refuses_rather_than_drops(spark):
    with pytest.raises(TooLarge):
        collect_bounded(spark.range(11), 10, "rows")
    assert len(collect_bounded(spark.range(10), 10, "rows")) == 10


def test_walks_and_steps_are_those_of_the_plain_formulas():
    # every step pulled with all rows, and every level of a tree made new arrays
    rng = np.random.default_rng(6)
    points = rng.normal(size=(500, 3))
    trees = [isolation_forest.grow_tree(points[rng.permutation(500)[:64]], 6, rng) for _ in range(9)]
    forest = isolation_forest.Forest(*(np.array(x) for x in zip(*trees)), 6, 64)
    plain = np.zeros(500)
    for features, thresholds, path in trees:
        for i, row in enumerate(points):
            node = 0
            while node < 63:
                node = 2 * node + 1 + int(row[features[node]] >= thresholds[node])
            plain[i] += path[node - 63]
    assert np.array_equal(isolation_forest.forest_paths(forest, points), plain / 9)
    directions, phases = rng.normal(size=(3, 32)), rng.uniform(0, 6, 32)
    z = boundary.fourier(points, directions, phases)
    assert np.allclose(z, np.sqrt(2 / 32) * np.cos(points @ directions + phases), atol=1e-15)
    weights, rho = np.zeros(32), 0.0
    for t in range(30):
        inside = (z @ weights < rho).astype(float)
        weights, rho = (1 - 1 / (t + 1)) * weights + inside @ z / (t + 1) / (0.05 * 500), rho + (1 - inside.mean() / 0.05) / (t + 1)
    got = boundary.descend(z, np.zeros(32), 0.0, 0.05, 0, 30)
    assert np.allclose(got[0], weights, atol=1e-12) and got[1] == pytest.approx(rho, abs=1e-12)


def test_a_sample_hashes_its_keys_once(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(sampling, "materialize", lambda df, name: stored.append(name) or materialize(df, name))
    df = spark.range(5000).select(F.col("id").alias("event_key"))
    got = sampling.hash_sample(df, "event_key", 100)
    assert stored == ["sampled"]
    wanted = sorted(range(5000), key=lambda i: (int(hashlib.md5(f"42/{i}".encode()).hexdigest()[:15], 16), i))[:100]
    assert sorted(r[0] for r in got.collect()) == sorted(wanted)
