"""Exact quantiles that never gather an unbounded group."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# at most this many values are ranked in one task
DIRECT_ROWS = 1_000_000
ACCURACY = 10_000


@dataclass
class _Wanted:
    """Two neighbouring order statistics of the values strictly between ``left`` and ``right`` of a column."""

    column: str
    n: int
    low: int
    high: int
    left: float | None = None
    right: float | None = None
    found: tuple[float, float] | None = None

    def value(self) -> Column:
        """The column's value where it is still a candidate, else null."""
        v = F.col(self.column).cast("double")
        within = F.lit(True)
        if self.left is not None:
            within = (v > self.left) & (v < self.right)
        return F.when(within, v)


def exact_quantile(df: DataFrame, column: str, q: float, direct_rows: int = DIRECT_ROWS) -> float | None:
    """The ``q`` quantile with linear interpolation, over the non-null values; None without any."""
    return exact_quantiles(df, [column], [q], direct_rows)[column][0]


def exact_quantiles(
    df: DataFrame, columns: list[str], qs: list[float], direct_rows: int = DIRECT_ROWS
) -> dict[str, list[float | None]]:
    """All quantiles of all columns, in passes that they share.

    Approximate quantiles bracket the wanted ranks; only values inside a bracket
    stay candidates. Each round shrinks them by a factor of thousands, until
    ``direct_rows`` or fewer are left of each to rank.
    """
    sizes = df.agg(*[F.count(c) for c in columns]).first()
    wanted = {
        (c, q): _Wanted(c, n, math.floor(q * (n - 1)), math.ceil(q * (n - 1)))
        for c, n in zip(columns, sizes) for q in qs if n
    }
    while large := [w for w in wanted.values() if w.found is None and w.n > direct_rows]:
        _narrow(df, large)
    if rest := [w for w in wanted.values() if w.found is None]:
        _rank(df, rest)

    def between(c: str, q: float, n: int) -> float | None:
        if not n:
            return None
        (low, high), rank = wanted[c, q].found, q * (n - 1)
        return low + (high - low) * (rank - math.floor(rank))

    return {c: [between(c, q, n) for q in qs] for c, n in zip(columns, sizes)}


def _narrow(df: DataFrame, wanted: list[_Wanted]) -> None:
    """Bracket every pair of ranks, in two passes over all of them."""
    spread = 2.0 / ACCURACY
    sides = df.agg(*[
        F.percentile_approx(w.value(), [max(0.0, w.low / w.n - spread), min(1.0, (w.high + 1) / w.n + spread)], ACCURACY)
        for w in wanted
    ]).first()
    counts = []
    for w, (left, right) in zip(wanted, sides):
        v, inside = w.value(), (w.value() > left) & (w.value() < right)
        counts.append(F.struct(
            F.count_if(v < left), F.count_if(v <= left), F.count_if(inside), F.count_if(v <= right),
            F.min(F.when(inside, v)), F.max(F.when(inside, v)),
        ))
    for w, (left, right), (below, upto_left, inside, upto_right, least, most) in zip(wanted, sides, df.agg(*counts).first()):
        if w.low < below or w.high >= upto_right:
            raise RuntimeError("approximate quantile outside its error bound")
        # ends of the bracket may carry any number of ties: they are settled by counting
        low = left if w.low < upto_left else right if w.low >= upto_left + inside else None
        high = left if w.high < upto_left else right if w.high >= upto_left + inside else None
        if low is None and high is None:
            w.n, w.low, w.high, w.left, w.right = inside, w.low - upto_left, w.high - upto_left, left, right
        else:
            # the ranks are neighbours: one just outside makes the other the last one inside
            w.found = (most if low is None else low, least if high is None else high)


def _rank(df: DataFrame, wanted: list[_Wanted]) -> None:
    """Ranks within at most ``direct_rows`` values of each."""
    candidates = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), w.value().alias("v")) for i, w in enumerate(wanted)
    ]))).filter(F.col("v").isNotNull())
    counted = candidates.groupBy("i", "v").agg(F.count("*").alias("n"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("v")))
    rank = lambda name: F.array(*[F.lit(getattr(w, name)) for w in wanted])[F.col("i")]
    for r in upto.groupBy("i").agg(
        F.min(F.when(F.col("upto") > rank("low"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > rank("high"), F.col("v"))).alias("b")
    ).collect():  # a row for each quantile
        wanted[r["i"]].found = (r["a"], r["b"])


def describe(df: DataFrame, columns: list[str], direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum, one row per column."""
    stats = df.agg(
        *[F.struct(F.count(c), F.avg(c), F.stddev_samp(c), F.min(c).cast("double"), F.max(c).cast("double")).alias(c)
          for c in columns]
    ).first()
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], direct_rows)
    rows = [
        (c, stats[c][0], stats[c][1], stats[c][2], stats[c][3], *quartiles[c], stats[c][4]) for c in columns
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, n long, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    )
