"""Quantiles and distinct counts of weeks from stored day states, beside the exact figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from logvane.operators import sketches
from logvane.session import work_path
from logvane.sources.tables import read_stage, write_stage
from workload.raw_events import NORM_CTE, normalized

MEASURED, COUNTED, SHARES, DAYS = ["message_len", "granted_access"], ["process_id", "message"], [0.05, 0.5, 0.95], 7
_STORED: dict[tuple[str, str], str] = {}


def _states(spark, sf_dir):
    """States per host and day, made once per session and read back from the table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = work_path(spark, "day-states")
        write_stage(sketches.day_states(normalized(spark, sf_dir), ["hostname"], F.to_date("event_ts"), MEASURED, COUNTED), path)
        _STORED[key] = path
    return read_stage(spark, _STORED[key])


def day_state_counts(spark, sf_dir):
    """Rows and measured values of every host and day, from the states."""
    return _states(spark, sf_dir).select(
        "hostname", "day", "n_rows", *[sketches.n_measured(c).alias(f"n_{c}") for c in MEASURED]
    )


def week_estimates(spark, sf_dir):
    """Every host's quantiles and distinct counts of the seven days up to each day."""
    weeks = sketches.rolling_states(_states(spark, sf_dir), ["hostname"], DAYS)
    shown = [F.get(sketches.quantiles(c, SHARES), i).alias(f"{c}_p{round(100 * q)}") for c in MEASURED for i, q in enumerate(SHARES)]
    return weeks.select("hostname", "until", "n_rows", *shown, *[sketches.distinct(c).alias(f"n_{c}") for c in COUNTED])


def _events_by_week(spark, sf_dir):
    dated = normalized(spark, sf_dir).withColumn("day", F.to_date("event_ts"))
    return dated.withColumn("until", F.explode(F.sequence("day", F.date_add("day", DAYS - 1))))


def week_quantile_errors(spark, sf_dir):
    """Each estimated quantile with its exact ranks, its error as a share of the rows and the bound of that error."""
    weeks = sketches.rolling_states(_states(spark, sf_dir), ["hostname"], DAYS)
    asked = weeks.select("hostname", "until", F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.lit(q).alias("share"), F.get(sketches.quantiles(c, SHARES), i).alias("estimate"))
        for c in MEASURED for i, q in enumerate(SHARES)
    ])).alias("a")).select("hostname", "until", "a.*")
    events = _events_by_week(spark, sf_dir).select("hostname", "until", F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in MEASURED
    ])).alias("e")).select("hostname", "until", "e.*")
    # values are folded first, so a row of the join is a value, not an event
    values = events.filter("value IS NOT NULL").groupBy("hostname", "until", "measure", "value").agg(F.count("*").alias("n"))
    ranked = asked.join(values, ["hostname", "until", "measure"]).groupBy("hostname", "until", "measure", "share", "estimate").agg(
        F.sum("n").alias("n_values"),
        (F.sum(F.when(F.col("value") < F.col("estimate"), F.col("n")).otherwise(0)) / F.sum("n")).alias("below"),
        (F.sum(F.when(F.col("value") <= F.col("estimate"), F.col("n")).otherwise(0)) / F.sum("n")).alias("upto"),
    )
    error = F.greatest(F.col("below") - F.col("share"), F.col("share") - F.col("upto"), F.lit(0.0))
    return ranked.withColumn("error", error).withColumn("bound", F.lit(sketches.rank_bound()))


def week_quantile_checks(spark, sf_dir):
    """Whether every estimated quantile lies within its bound."""
    # a rank is a whole row, which matters in small groups
    within = F.col("error") <= F.col("bound") + 1 / F.col("n_values")
    return week_quantile_errors(spark, sf_dir).select("hostname", "until", "measure", "share", "n_values", within.alias("within_bound"))


def week_distinct_errors(spark, sf_dir):
    """Each estimated distinct count beside the exact one and the bound of the error."""
    weeks = sketches.rolling_states(_states(spark, sf_dir), ["hostname"], DAYS)
    exact = _events_by_week(spark, sf_dir).groupBy("hostname", "until").agg(*[F.count_distinct(c).alias(f"exact_{c}") for c in COUNTED])
    both = weeks.join(exact, ["hostname", "until"])
    return both.select("hostname", "until", F.explode(F.array(*[
        F.struct(F.lit(c).alias("counted"), sketches.distinct(c).alias("estimate"), F.col(f"exact_{c}").alias("exact")) for c in COUNTED
    ])).alias("c")).select("hostname", "until", "c.*").withColumn("bound", F.lit(sketches.distinct_bound()))


def week_distinct_checks(spark, sf_dir):
    """Exact distinct counts of every host's weeks, and whether the estimate lies within its bound."""
    within = F.abs(F.col("estimate") - F.col("exact")) <= F.col("bound") * F.col("exact") + 1
    return week_distinct_errors(spark, sf_dir).select("hostname", "until", "counted", "exact", within.alias("within_bound"))


QUERIES = {f.__name__: f for f in [
    day_state_counts, week_estimates, week_quantile_errors, week_quantile_checks, week_distinct_errors, week_distinct_checks]}

_WEEKS = f"""{NORM_CTE},
weeks AS (SELECT *, CAST(unnest(range(CAST(event_ts AS DATE)::TIMESTAMP, CAST(event_ts AS DATE)::TIMESTAMP + INTERVAL {DAYS} DAY, INTERVAL 1 DAY)) AS DATE) AS until
          FROM norm WHERE event_ts IS NOT NULL)"""

ORACLES = {
    "day_state_counts": f"""WITH {NORM_CTE} SELECT hostname, CAST(event_ts AS DATE) AS day, count(*) AS n_rows,
        {', '.join(f'count({c}) AS n_{c}' for c in MEASURED)} FROM norm GROUP BY ALL""",
    "week_quantile_checks": f"""WITH {_WEEKS} SELECT hostname, until, measure, share, n_values, true AS within_bound
        FROM ({' UNION ALL '.join(f"SELECT hostname, until, '{c}' AS measure, count({c}) AS n_values FROM weeks GROUP BY ALL" for c in MEASURED)}),
             (SELECT unnest({SHARES}::DOUBLE[]) AS share)""",
    "week_distinct_checks": f"WITH {_WEEKS} " + " UNION ALL ".join(
        f"SELECT hostname, until, '{c}' AS counted, count(DISTINCT {c}) AS exact, true AS within_bound FROM weeks GROUP BY ALL" for c in COUNTED),
}
