import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from logvane.operators import sketches as S

SCHEMA = "host string, at date, v double, w string"
FIRST = datetime.date(2024, 1, 1)


def day(n):
    return FIRST + datetime.timedelta(days=n)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    # a third of all rows on one host and day
    return [("hot", day(3), float(v), f"w{v:.2f}") for v in rng.normal(size=20_000)] + [
        (f"h{i % 4}", day(i % 9), float(v), f"w{i % 700}") for i, v in enumerate(rng.exponential(size=40_000))]


@pytest.fixture(scope="module")
def states(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    path = str(tmp_path_factory.mktemp("states") / "t")
    S.day_states(df, ["host"], F.col("at"), ["v"], ["w"]).write.parquet(path)
    return spark.read.parquet(path)


def error_of(values, estimate, share):
    values = np.asarray(values)
    return max((values < estimate).mean() - share, share - (values <= estimate).mean(), 0)


def test_spans_merge_from_the_table(states, rows):
    merged = S.span_states(states, ["host"], "2024-01-03", "2024-01-06")
    got = merged.select("host", "n_rows", S.quantiles("v", [0.01, 0.5, 0.99]).alias("q"), S.distinct("w").alias("d")).collect()
    assert {r["host"] for r in got} == {"hot", "h0", "h1", "h2", "h3"}
    for r in got:
        inside = [x for x in rows if x[0] == r["host"] and day(2) <= x[1] <= day(5)]
        assert r["n_rows"] == len(inside)
        for share, estimate in zip([0.01, 0.5, 0.99], r["q"]):
            assert error_of([x[2] for x in inside], estimate, share) <= S.rank_bound() + 1 / len(inside)
        exact = len({x[3] for x in inside})
        assert abs(r["d"] - exact) <= S.distinct_bound() * exact + 1


def test_states_of_all_groups_add_up(states, rows):
    one = S.merge_states(states, []).select("n_rows", S.n_measured("v").alias("n"), F.get(S.quantiles("v", [0.5]), 0).alias("q")).first()
    assert one["n_rows"] == one["n"] == len(rows)
    assert error_of([x[2] for x in rows], one["q"], 0.5) <= S.rank_bound()


def test_merged_in_steps_or_at_once(states):
    steps = S.merge_states(S.merge_states(states, ["day"]), []).select("n_rows", S.distinct("w").alias("d")).first()
    assert steps == S.merge_states(states, []).select("n_rows", S.distinct("w").alias("d")).first()


def test_rolling_spans(states, rows):
    got = {(r["host"], r["until"]): r["n_rows"] for r in S.rolling_states(states, ["host"], 3).collect()}
    want = {}
    for host, at, *_ in rows:
        for ahead in range(3):
            key = (host, at + datetime.timedelta(days=ahead))
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_odd_values(spark):
    rows = [("a", day(0), None, None), ("a", day(0), float("nan"), ""), (None, None, 2.0, "x"), (None, None, 4.0, "x"),
            ("b", day(0), float("inf"), "x"), ("b", day(1), float("-inf"), "")]
    states = S.day_states(spark.createDataFrame(rows, SCHEMA), ["host"], F.col("at"), ["v"], ["w"])
    shown = ["host", "day", "n_rows", S.n_measured("v").alias("n"), S.quantiles("v", [0.0, 1.0]).alias("q"), S.distinct("w").alias("d")]
    got = {(r["host"], r["day"]): tuple(r)[2:] for r in states.select(*shown).collect()}
    inf = float("inf")
    assert got == {("a", day(0)): (2, 0, None, 1), (None, None): (2, 2, [2.0, 4.0], 1),
                   ("b", day(0)): (1, 1, [inf, inf], 1), ("b", day(1)): (1, 1, [-inf, -inf], 1)}
    whole = S.rolling_states(states, [], 9)
    assert max(r["n_rows"] for r in whole.collect()) == 4, "rows without a day belong to no span"


def test_empty_table(spark):
    states = S.day_states(spark.createDataFrame([], SCHEMA), ["host"], F.col("at"), ["v"], ["w"])
    assert states.count() == 0 and S.rolling_states(states, ["host"], 7).count() == 0


def test_bounds_shrink_with_size():
    assert S.rank_bound(1600) < S.rank_bound(800) < S.rank_bound(800, 1e-9)
    assert S.distinct_bound(14) == pytest.approx(S.distinct_bound(12) / 2)
