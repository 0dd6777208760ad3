"""The encoder-decoder: its gradient, layout independence, and outliers that components miss."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logvane.operators import autoencoder, components


def test_gradient():
    rng = np.random.default_rng(1)
    layout = autoencoder.Layout(4, 3, 2)
    flat, x = layout.start(1), rng.normal(size=(7, 4))
    _, g = autoencoder.gradient(layout, flat, x)
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert g[i] == pytest.approx((autoencoder.gradient(layout, up, x)[0] - autoencoder.gradient(layout, down, x)[0]) / 2e-6, abs=1e-6)


@pytest.fixture(scope="module")
def bent(spark):
    """Points along a bow, and some off it that lie well inside its extent."""
    rng = np.random.default_rng(2)
    t = rng.uniform(-2, 2, 3_000)
    rows = np.stack([t, t**2 - 1.3, np.sin(2 * t)], 1) + rng.normal(scale=0.05, size=(3_000, 3))
    off = np.stack([rng.uniform(-0.6, 0.6, 30), rng.uniform(0.6, 1.4, 30), rng.uniform(-0.2, 0.2, 30)], 1)
    data = [(i, v.tolist(), 0) for i, v in enumerate(rows)] + [(5_000 + i, v.tolist(), 1) for i, v in enumerate(off)]
    return spark.createDataFrame(data, "id long, features array<double>, planted int").repartition(4).cache()


def area(rows):
    scores, planted = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    ranks = scores.argsort().argsort() + 1
    n = planted.sum()
    return (ranks[planted == 1].sum() - n * (n + 1) / 2) / (n * (len(rows) - n))


def test_finds_what_components_miss(bent):
    model = autoencoder.fit_autoencoder(bent, "id", middle=1, rounds=25, step=0.02, rows_per_unit=1_600)
    curved = area(bent.select(autoencoder.reconstruction_error(model), "planted").collect())
    linear = area(bent.select(components.reconstruction_error(components.fit_components(bent, 1)), "planted").collect())
    assert curved > 0.95 and linear < 0.9, (curved, linear)


def test_the_model_does_not_hang_on_the_layout(bent):
    one = autoencoder.fit_autoencoder(bent.repartition(1), "id", rounds=2, rows_per_unit=700)
    other = autoencoder.fit_autoencoder(bent.repartition(9, "planted"), "id", rounds=2, rows_per_unit=700)
    assert np.allclose(one.flat, other.flat, atol=1e-9)


def test_empty_tables(bent):
    with pytest.raises(ValueError, match="no rows"):
        autoencoder.fit_autoencoder(bent.filter("false"), "id")
    model = autoencoder.fit_autoencoder(bent.filter("id < 3"), "id", rounds=1)
    assert bent.filter("false").select(autoencoder.reconstruction_error(model)).count() == 0
