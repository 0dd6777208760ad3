"""The most frequent items, exactly, without shuffling every distinct one.

A plain count by item ships a row for each distinct item of each task, and most
word pairs occur once. Here every task keeps a bounded number of counters
[Misra, Gries 1982]: where there are more items, the count of the first one too
many is taken off all. What a task has taken off in this way is the most that
any of its counts can be short of [Agarwal et al. 2012, mergeable summaries].
Spark adds up the counters by item; an item can be among the ``k`` most frequent
only if its sum plus all shortfalls reaches the k-th largest sum. These
survivors alone are counted exactly, in a second pass.

The k-th sum must exceed the shortfall, or an item that no task has kept might
belong to the result. Then the pass is repeated with more counters; past
``MOST_COUNTERS`` all items are counted, so the result never depends on the size
of the summaries. As sums and shortfalls both grow with the rows, the counters
needed do not.

Defined cases: nulls and NaN are not items; an empty string is one. Equal counts go to
the smaller item. With fewer than ``k`` items all are returned. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.session import materialize

#: counters per task: at first for each item wanted, how many times more with every repetition, and at most
COUNTERS_PER_ITEM, MORE, MOST_COUNTERS = 20, 8, 4_000_000
LEAST_COUNTERS = 1_000


@dataclass
class FrequentItems:
    """The ``item, n`` rows and what they cost; ``shuffled`` rows are those of the summaries in all passes."""

    items: DataFrame
    rows: int
    shuffled: int
    survivors: int
    shortfall: int
    counters: int


def _folded(parts: list[pa.Table], counters: int) -> tuple[pa.Table, int]:
    """Counts by item of all parts, cut to ``counters``, and what was taken off."""
    held = pa.concat_tables(parts).group_by("item", use_threads=False).aggregate([("n", "sum")])
    held = held.select(["item", "n_sum"]).rename_columns(["item", "n"])
    if len(held) <= counters:
        return held, 0
    n = held["n"].to_numpy()
    off = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])
    kept = held.filter(pa.array(n > off))
    return kept.set_column(1, "n", pa.array(kept["n"].to_numpy() - off)), off


def summaries(items: DataFrame, counters: int) -> DataFrame:
    """``item, n, off`` of every task: at most ``counters`` items, and one row without an item holding rows and shortfall.

    Items come one by one, or with a count ``n`` of rows each.
    """
    kind = dict(items.dtypes)["item"]
    if "n" not in items.columns:
        items = items.withColumn("n", F.lit(1).cast("long"))

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, rows, off, item_type = [], 0, 0, 0, pa.null()
        for batch in batches:
            part, _ = _folded([pa.Table.from_batches([batch])], len(batch))
            item_type = part.schema.field("item").type
            rows += pc.sum(part["n"]).as_py() or 0
            held.append(part)
            waiting += len(part)
            # folding costs as much as what is held, so it waits until that has doubled
            if waiting > 2 * counters:
                kept, more = _folded(held, counters)
                held, waiting, off = [kept], len(kept), off + more
        if held:
            kept, more = _folded(held, counters)
            off += more
            kept = kept.append_column("off", pa.array(np.zeros(len(kept), np.int64)))
            yield from kept.combine_chunks().to_batches(max_chunksize=50_000)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, item_type), pa.array([rows]), pa.array([off])], ["item", "n", "off"])

    return items.select("item", "n").mapInArrow(summarize, f"item {kind}, n long, off long")


def frequent_items(
    df: DataFrame, item: Column, k: int, counters: int | None = None, most_counters: int = MOST_COUNTERS, n: Column | None = None,
) -> FrequentItems:
    """The ``k`` most frequent values of ``item`` with their exact counts; a row stands for ``n`` whole ones where that is given."""
    items = df.select(item.alias("item"), (F.lit(1) if n is None else n).cast("long").alias("n")).filter("item IS NOT NULL")
    if dict(items.dtypes)["item"] in ("float", "double"):
        items = items.filter(~F.isnan("item"))
    counters = counters or max(COUNTERS_PER_ITEM * k, LEAST_COUNTERS)
    shuffled = 0
    while counters <= most_counters:
        kept = materialize(summaries(items, counters), "counters")
        rows, off, n_kept = kept.agg(F.sum(F.when(F.col("item").isNull(), F.col("n"))), F.sum("off"), F.count("item")).first()
        shuffled += n_kept
        sums = kept.filter("item IS NOT NULL").groupBy("item").agg(F.sum("n").alias("n"))
        if not off:
            # no counter was ever cut: the sums are the counts
            return FrequentItems(_first(sums, k), rows or 0, shuffled, 0, 0, counters)
        sums = materialize(sums, "counter-sums")
        n_items, least = _first(sums, k).agg(F.count("*"), F.min("n")).first()
        if n_items == k and least > off:
            # a written table tells its size, so Spark sends it to all tasks where it is small
            survivors = materialize(sums.filter(F.col("n") + off >= least).select("item"), "survivors")
            counted = items.join(survivors, "item", "left_semi").groupBy("item").agg(F.sum("n").alias("n"))
            return FrequentItems(_first(counted, k), rows, shuffled, survivors.count(), off, counters)
        counters *= MORE
    counted = materialize(items.groupBy("item").agg(F.sum("n").alias("n")), "counts")
    rows, n_items = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return FrequentItems(_first(counted, k), rows, shuffled, n_items, 0, 0)


def _first(counts: DataFrame, k: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), "item").limit(k)
