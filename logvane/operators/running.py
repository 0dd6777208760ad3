"""Running totals over a global order, without a single-task window."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logvane.session import materialize

ROWS_PER_RANGE = 500_000
MAX_RANGES = 10_000


def running_totals(
    df: DataFrame, by: list[str], order_col: str, sum_cols: list[str], rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Add ``cum_<c>``: the sum of ``c`` over all rows of the group at or above this ``order_col``.

    ``df`` holds one row per (group, order value). The order is cut into value
    ranges of about equal row counts; rows are summed within their range, and a
    small table of range totals supplies what the ranges above contribute.
    """
    n = df.count()
    ranges = min(MAX_RANGES, n // rows_per_range)
    if ranges <= 1:
        ranged = df.withColumn("_range", F.lit(0.0))
    else:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = df.agg(F.percentile_approx(order_col, shares, 10 * MAX_RANGES)).first()[0]
        splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
        ranged = Bucketizer(splits=splits, inputCol=order_col, outputCol="_range").transform(df)
    above = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in sum_cols])
    offsets = offsets.select(
        *by, "_range", *[F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_above_{c}") for c in sum_cols]
    )
    within = Window.partitionBy(*by, "_range").orderBy(F.desc(order_col))
    summed = ranged.withColumns({f"_within_{c}": F.sum(c).over(within) for c in sum_cols})
    joined = summed.join(offsets, [*by, "_range"])
    return joined.withColumns({f"cum_{c}": F.col(f"_within_{c}") + F.col(f"_above_{c}") for c in sum_cols}).drop(
        "_range", *[f"_within_{c}" for c in sum_cols], *[f"_above_{c}" for c in sum_cols]
    )


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Add the place in a global order, from 0 without gaps; ranges are numbered apart and shifted by their sizes."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    # one row per range here, never one per row
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before")
    )
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.join(sizes, "_range").withColumn(name, within + F.col("_before")).drop("_range", "_before")
