"""Mergeable summaries per group and day: quantiles and distinct counts of any span without reading its events again.

Events are folded once into a state per group and day: rows, a KLL sketch of
each measured column [Karnin et al. 2016] and a HyperLogLog sketch of each
counted one [Flajolet et al. 2007]. States are a table like any other; states of
days add up to those of weeks, of groups to those of all, in any order, and
their size does not depend on the number of events behind them. Both are
aggregates that Spark combines before it shuffles, so a group with a third of
all rows ships one state per task.

Defined cases: nulls and NaN are not measured, nulls are not counted; an empty
string counts as a value of its own. Rows without a day form states without a
day, which belong to no span. A group whose values are all null has null
quantiles and 0 distinct values. An empty table gives no states.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: sizes of the sketches: a rank is off by at most 0.6 % of the rows at 99 %, a distinct count by 1.6 % in one deviation
KLL_K, HLL_LOG_SIZE = 800, 12
# published for KLL doubles: error of a single rank is 2.296 / k^0.9021 with a chance of 99 %
_RANK_FACTOR, _RANK_POWER, _RANK_SURE = 2.296, 0.9021, 0.99


def rank_bound(k: int = KLL_K, chance: float = 1e-6) -> float:
    """Error of a rank, as a share of the rows, that is exceeded with at most this chance."""
    normal = NormalDist()
    return _RANK_FACTOR / k**_RANK_POWER * normal.inv_cdf(1 - chance / 2) / normal.inv_cdf((1 + _RANK_SURE) / 2)


def distinct_bound(log_size: int = HLL_LOG_SIZE, chance: float = 1e-6) -> float:
    """Relative error of a merged distinct count that is exceeded with at most this chance."""
    return 1.04 / 2 ** (log_size / 2) * NormalDist().inv_cdf(1 - chance / 2)


def _measured(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def day_states(
    events: DataFrame, by: list[str], day: Column, measured: list[str] = [], counted: list[str] = [], k: int = KLL_K,
    log_size: int = HLL_LOG_SIZE,
) -> DataFrame:
    """One state per group and day: ``by, day, n_rows``, ``kll_<column>`` of measured and ``hll_<column>`` of counted columns."""
    # the sketch passes over empty strings, so every value gets a first character
    text = lambda c: F.concat(F.lit("="), F.col(c).cast("string"))
    return events.groupBy(*by, day.alias("day")).agg(
        F.count("*").alias("n_rows"),
        *[F.kll_sketch_agg_double(_measured(c), F.lit(k)).alias(f"kll_{c}") for c in measured],
        *[F.hll_sketch_agg(text(c), F.lit(log_size)).alias(f"hll_{c}") for c in counted],
    )


def merge_states(states: DataFrame, by: list[str]) -> DataFrame:
    """The states of coarser groups: those of all rows with equal ``by``."""
    named = lambda prefix: [c for c in states.columns if c.startswith(prefix) and c not in by]
    return states.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"),
        *[F.kll_merge_agg_double(c).alias(c) for c in named("kll_")],
        *[F.hll_union_agg(c).alias(c) for c in named("hll_")],
    )


def span_states(states: DataFrame, by: list[str], first: str, last: str) -> DataFrame:
    """One state per group for the days from ``first`` to ``last``, both included; other days' files need not be read."""
    within = F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return merge_states(states.filter(within), by)


def rolling_states(states: DataFrame, by: list[str], days: int) -> DataFrame:
    """One state per group and ``until``, for the ``days`` days that end there; spans that hold a row of the group.

    A state is copied once per span it belongs to; events are not.
    """
    untils = F.sequence(F.col("day"), F.date_add("day", days - 1))
    return merge_states(states.withColumn("until", F.explode(untils)), [*by, "until"])


def n_measured(column: str) -> Column:
    """How many values a state has measured."""
    return F.kll_sketch_get_n_double(f"kll_{column}")


def quantiles(column: str, qs: list[float]) -> Column:
    """The values at these shares of the rows, null where nothing was measured."""
    return F.when(n_measured(column) > 0, F.kll_sketch_get_quantile_double(f"kll_{column}", F.array(*map(F.lit, qs))))


def distinct(column: str) -> Column:
    """How many different values a state has counted."""
    return F.hll_sketch_estimate(f"hll_{column}")
