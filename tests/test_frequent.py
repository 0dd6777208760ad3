from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logvane.operators import frequent


def exact(values, k):
    counts = Counter(v for v in values if v is not None)
    return sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:k]


def got(found):
    return [(r["item"], r["n"]) for r in found.items.collect()]


@pytest.fixture(scope="module")
def words():
    # a third of all rows are one word, 30,000 others follow a power law
    rng = np.random.default_rng(3)
    return ["hot"] * 30_000 + [f"w{v}" for v in np.minimum(rng.zipf(1.3, 60_000), 30_000)]


@pytest.fixture(scope="module")
def table(spark, words):
    return spark.createDataFrame([(w,) for w in words], "w string").repartition(6).cache()


@pytest.mark.parametrize("counters", [400, 3_000, 100_000])
def test_equals_exact_counts(table, words, counters):
    found = frequent.frequent_items(table, F.col("w"), 20, counters)
    assert got(found) == exact(words, 20)
    assert found.rows == len(words)


def test_fewer_rows_than_distinct_items_are_shuffled(table, words):
    found = frequent.frequent_items(table, F.col("w"), 20, 400)
    assert 0 < found.shortfall and 20 <= found.survivors < 400 and found.shuffled <= 6 * 400
    per_task = table.groupBy(F.spark_partition_id(), "w").count().count()
    assert found.shuffled < per_task / 2


def test_too_few_counters_are_repeated_with_more(table, words):
    found = frequent.frequent_items(table, F.col("w"), 300, 2)
    assert got(found) == exact(words, 300) and found.counters > 2


def test_all_are_counted_where_counters_do_not_decide(spark):
    # every item equally often: no summary can tell them apart
    values = [i % 500 for i in range(5_000)]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    found = frequent.frequent_items(df, F.col("v"), 10, 4, most_counters=32)
    assert got(found) == exact(values, 10) and found.counters == 0 and found.survivors == 500


def test_ties_at_the_end_go_to_the_smaller_item(spark):
    values = ["a"] * 50 + ["c"] * 30 + ["b"] * 30 + ["d"] * 30 + [f"x{i}" for i in range(40)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(2)
    for counters in (4, 8, 1_000):
        assert got(frequent.frequent_items(df, F.col("v"), 2, counters)) == [("a", 50), ("b", 30)]


def test_counters_hold_their_bound(spark, table, words):
    rows = frequent.summaries(table.select(F.col("w").alias("item")), 50).collect()
    off = sum(r["off"] for r in rows)
    counts, sums = Counter(words), Counter()
    for r in rows:
        if r["item"] is not None:
            sums[r["item"]] += r["n"]
    assert all(sums[w] <= n <= sums[w] + off for w, n in counts.items())
    assert off <= len(words) / 51


def test_nulls_empties_few_items_and_empty_tables(spark):
    values = [None, "", "", "a", None, None]
    df = spark.createDataFrame([(v, 1) for v in values], "item string, n int")
    assert got(frequent.frequent_items(df, F.col("item"), 5)) == [("", 2), ("a", 1)]
    assert got(frequent.frequent_items(df.filter("false"), F.col("item"), 5)) == []
    assert got(frequent.frequent_items(df.filter("item IS NULL"), F.col("item"), 5, 1)) == []
    one = spark.createDataFrame([(float(i % 3),) for i in range(30)] + [(float("nan"),)] * 40, "v double")
    assert got(frequent.frequent_items(one, F.col("v"), 9, 1)) == [(0.0, 10), (1.0, 10), (2.0, 10)]


def test_rows_that_stand_for_several(spark, table, words):
    # the terms of a task are counted before the counters see them
    counted = spark.createDataFrame([(w, n) for w, n in Counter(words[: len(words) // 2]).items()], "w string, n long").repartition(3)
    rest = spark.createDataFrame([(w, 1) for w in words[len(words) // 2 :]], "w string, n long").repartition(3)
    found = frequent.frequent_items(counted.unionByName(rest), F.col("w"), 20, 400, n=F.col("n"))
    assert got(found) == exact(words, 20) and found.rows == len(words) and found.shortfall > 0
