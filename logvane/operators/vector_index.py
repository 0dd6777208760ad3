"""An inverted-file index of passage vectors: cells around coarse centroids, searched a few at a time.

Centroids are fitted by Spark's k-means and bounded in number. Every passage is
written once below its collection and the cell of its nearest centroid; a
crowded cell is written by several tasks. A search ranks the centroids for each
query, reads only the cells that some query probes (a partition filter, so the
other folders are never opened) and compares a passage with the queries that
probe its cell. With all cells probed the result is that of the exact search.

How many cells to probe is measured: for stored passages as queries, the exact
neighbours' cells are looked up in the query's order of cells. The rank below
which the wanted share of neighbours lies is the number of probes.

Defined cases: a null vector cannot be compared and is refused when the index is
built. Repeated ids are rows of their own. An empty table gives an index
without cells, in which nothing is found. Null collections are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logvane.functions.arrays import to_matrix
from logvane.operators.retrieve import MATRIX_VALUES, _TopK, _matrix, _unit, nearest
from logvane.session import TooLarge, collect_bounded, share

#: centroids are held by every task: at 384 dimensions about 50 MB
MAX_CELLS = 16_384
ROWS_PER_CELL = 2_000
FIT_ROWS, FIT_ROUNDS = 200_000, 10
#: queries that are shipped to every task, and coordinates in a block of queries or of rows beyond (50,000 vectors of 64)
MAX_SHARED, BLOCK_VALUES = 2_000, 3_200_000
BLOCK_QUERIES = BLOCK_ROWS = 50_000
#: queries by which the number of probes is measured
MEASURED = 500


@dataclass
class VectorIndex:
    """Where an index lies, its centroids and its measure."""

    path: str
    centroids: np.ndarray
    metric: str

    @property
    def cells(self) -> int:
        return len(self.centroids)


def _ranked_cells(vectors: np.ndarray, index_centroids: np.ndarray, probes: int, metric: str) -> np.ndarray:
    """The nearest ``probes`` cells of every vector, nearest first; ties go to the smaller cell."""
    rows = _unit(vectors) if metric == "cosine" else vectors
    own, found = (index_centroids**2).sum(1)[None, :], np.empty((len(rows), probes), np.int32)
    # a matrix of all rows and cells may be far larger than both
    together = max(1, MATRIX_VALUES // len(index_centroids))
    for start in range(0, len(rows), together):
        squared = np.round(own - 2.0 * rows[start : start + together] @ index_centroids.T, 10)
        if probes == 1:
            found[start : start + together, 0] = squared.argmin(axis=1)
        else:
            found[start : start + together] = np.argsort(squared, axis=1, kind="stable")[:, :probes]
    return found


def _cell_column(centroids: np.ndarray, metric: str):
    shared = share(centroids)

    @F.pandas_udf("int")
    def cell(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype="int32")
        return pd.Series(_ranked_cells(_matrix(column), shared.value, 1, metric)[:, 0])

    return cell


def build_index(
    docs: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, collection: str = "collection", doc_id: str = "doc_id",
    vector: str = "embedding", fit_rows: int | None = FIT_ROWS, seed: int = 7,
) -> VectorIndex:
    """Fit centroids on about ``fit_rows`` rows, chosen by the hash of id and vector (None: on all), and store every row by its cell."""
    spark = docs.sparkSession
    rows = docs.select(F.col(collection).alias("collection"), F.col(doc_id).alias("doc_id"), F.col(vector).cast("array<double>").alias("vector"))
    count, missing = rows.agg(F.count("*"), F.count_if(F.col("vector").isNull())).first()
    if missing:
        raise ValueError(f"{missing} rows have no vector")
    wanted = min(cells or max(1, round(count / ROWS_PER_CELL), round(count**0.5 / 2)), MAX_CELLS, max(count, 1))
    centroids = np.empty((0, 0))
    if count:
        fit_rows = count if fit_rows is None else fit_rows
        # a filter: no task holds or sorts the drawn rows
        drawn = rows if count <= fit_rows else rows.filter(F.pmod(F.xxhash64("collection", "doc_id", "vector"), F.lit(count)) < fit_rows)
        if count > fit_rows and drawn.isEmpty():
            drawn = rows
        features = drawn.select(array_to_vector("vector").alias("features"))
        if metric == "cosine":
            # lengths in an expression on arrays would be found anew for every coordinate
            features = Normalizer(inputCol="features", outputCol="scaled").transform(features).select(F.col("scaled").alias("features"))
        fitted = KMeans(k=wanted, seed=seed, maxIter=FIT_ROUNDS).fit(features) if wanted > 1 else None
        if fitted is None:
            first = rows.first()["vector"]
            centroids = np.array([first], float)
        else:
            centroids = np.array(fitted.clusterCenters(), float)
    table = [(i, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(table, "cell int, centroid array<double>").withColumn("metric", F.lit(metric)).write.mode("overwrite").parquet(f"{path}/centroids")
    placed = rows.withColumn("cell", _cell_column(centroids, metric)("vector")) if count else rows.withColumn("cell", F.lit(0))
    # rebalancing splits crowded cells and joins small ones, each folder still written by few tasks
    placed.hint("rebalance", "collection", "cell").write.mode("overwrite").partitionBy("collection", "cell").parquet(f"{path}/rows")
    return VectorIndex(path, centroids, metric)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index stored before."""
    rows = sorted(collect_bounded(spark.read.parquet(f"{path}/centroids"), MAX_CELLS, "cells"))
    return VectorIndex(path, np.array([r["centroid"] for r in rows], float), rows[0]["metric"] if rows else "cosine")


def stored_rows(spark: SparkSession, index: VectorIndex, like: DataFrame, cells: list[int] | None = None) -> DataFrame:
    """Stored ``collection, doc_id, vector, cell`` of some cells; ``like`` gives the collection's type."""
    kind = dict(like.dtypes)
    schema = f"doc_id {kind['doc_id']}, vector array<double>, collection {kind['collection']}, cell int"
    rows = spark.read.schema(schema).parquet(f"{index.path}/rows")
    return rows if cells is None else rows.filter(F.col("cell").isin(cells))


def search(
    index: VectorIndex, queries: DataFrame, like: DataFrame, k: int = 5, probes: int | None = None, vector: str = "embedding",
    max_shared: int = MAX_SHARED,
) -> DataFrame:
    """``query_id, collection, doc_id, distance, rank``: the k nearest of the probed cells per collection.

    ``like`` is a table with the columns ``collection`` and ``doc_id`` of those indexed. Queries beyond ``max_shared`` meet the
    cells they probe in blocks; a stored row is copied once per block of queries that probe its cell.
    """
    spark = queries.sparkSession
    probes = min(probes or index.cells, max(index.cells, 1))
    q = queries.select("query_id", F.col(vector).cast("array<double>").alias("vector"))
    kinds = dict(q.dtypes) | dict(like.dtypes)
    schema = f"query_id {kinds['query_id']}, collection {kinds['collection']}, doc_id {kinds['doc_id']}, distance double"
    if not index.cells:
        found = spark.createDataFrame([], schema)
    else:
        try:
            rows = sorted(collect_bounded(q, max_shared, "queries"))
            found = _search_shared(index, rows, like, k, probes, schema, spark)
        except TooLarge:
            found = _search_blocked(index, q, like, k, probes, schema, kinds)
    order = Window.partitionBy("query_id", "collection").orderBy("distance", "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class _Asked:
    """Which queries probe a cell, from ``(cells, queries)`` of equal lengths; every query if there are no such lists."""

    def __init__(self, cells: np.ndarray | None, queries: np.ndarray | None):
        self.cells = cells
        if cells is not None:
            order = np.argsort(cells, kind="stable")
            self.cells, self.queries = cells[order], queries[order]

    def of(self, cell: int) -> np.ndarray | None:
        if self.cells is None:
            return None
        start, end = np.searchsorted(self.cells, [cell, cell + 1])
        return self.queries[start:end]


def _add(top: _TopK, asked: _Asked, stored: pd.DataFrame) -> None:
    """Compare stored rows with the queries that probe their cells."""
    if asked.cells is None:
        top.add(stored["collection"].to_numpy(), stored["doc_id"].to_numpy(), _matrix(stored["vector"]))
        return
    for cell, part in stored.groupby("cell"):
        mine = asked.of(cell)
        if len(mine):
            top.add(part["collection"].to_numpy(), part["doc_id"].to_numpy(), _matrix(part["vector"]), mine)


def _search_shared(index, rows, like, k, probes, schema, spark):
    if not rows:
        return spark.createDataFrame([], schema)
    ids, vectors = np.array([r["query_id"] for r in rows]), np.array([r["vector"] for r in rows], float)
    if probes < index.cells:
        probed = _ranked_cells(vectors, index.centroids, probes, index.metric)
        asked, wanted = _Asked(probed.ravel(), np.repeat(np.arange(len(ids)), probes)), np.unique(probed).tolist()
    else:
        asked, wanted = _Asked(None, None), None
    shared, metric = share((ids, vectors, asked)), index.metric

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors, asked = shared.value
        top = _TopK(ids, vectors, k, metric)
        for batch in batches:
            if len(batch):
                _add(top, asked, batch)
        yield top.frame()

    return stored_rows(spark, index, like, wanted).mapInPandas(compare, schema)


def _by_nearness(centroids: np.ndarray) -> np.ndarray:
    """The cells in an order in which near ones stand together: halves along the widest direction, halved again."""
    done, pending = [], [np.arange(len(centroids))]
    while pending:
        cells = pending.pop()
        if len(cells) < 3:
            done.append(cells)
            continue
        away = centroids[cells] - centroids[cells].mean(axis=0)
        order = cells[np.argsort(away @ np.linalg.eigh(away.T @ away)[1][:, -1], kind="stable")]
        pending += [order[len(order) // 2 :], order[: len(order) // 2]]
    return np.concatenate(done)


def _regions(index: VectorIndex, stored: DataFrame, tasks: int) -> pd.DataFrame:
    """``cell, region, d_blocks``: neighbouring cells in regions of bounded size; a larger cell is a region of several blocks."""
    counts = {r["cell"]: r["n"] for r in collect_bounded(stored.groupBy("cell").agg(F.count("*").alias("n")), index.cells, "cells")}
    most = min(BLOCK_ROWS, max(1, BLOCK_VALUES // index.centroids.shape[1]), max(ROWS_PER_CELL, -(-sum(counts.values()) // tasks)))
    rows, region, held = [], 0, 0
    for cell in _by_nearness(index.centroids).tolist():
        n = counts.get(cell, 0)
        if held and held + n > most:
            region, held = region + 1, 0
        held += n
        rows.append((cell, region, max(1, -(-n // most))))
    return pd.DataFrame(rows, columns=["cell", "region", "d_blocks"])


def _search_blocked(index, q, like, k, probes, schema, kinds):
    spark, metric, every = q.sparkSession, index.metric, probes >= index.cells
    stored = stored_rows(spark, index, like)
    regions = _regions(index, stored, 2 * spark.sparkContext.defaultParallelism)
    of_cell = np.zeros(index.cells, np.int32)
    of_cell[regions["cell"]] = regions["region"]
    shared = share((index.centroids, of_cell))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every query once for each region that it probes, with the cells there."""
        centroids, of_cell = shared.value
        for batch in batches:
            if not len(batch):
                continue
            cells = _ranked_cells(to_matrix(batch.column("vector")), centroids, probes, metric)
            order = np.argsort(of_cell[cells], axis=1, kind="stable")
            cells = np.take_along_axis(cells, order, axis=1).ravel()
            row, region = np.repeat(np.arange(len(batch)), probes), of_cell[cells]
            starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (region[1:] != region[:-1])])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(cells)].astype(np.int32)), pa.array(cells))
            if every:
                lists = pa.nulls(len(starts), lists.type)
            # a query's vector is repeated for each region: a few hundred queries at a time
            taken, named = row[starts], region[starts]
            for at in range(0, len(starts), 10_000):
                some = slice(at, at + 10_000)
                copies = batch.take(pa.array(taken[some]))
                yield pa.RecordBatch.from_arrays(
                    [*copies.columns, pa.array(named[some]), lists[some]], ["query_id", "vector", "region", "cells"])

    fields = f"query_id {kinds['query_id']}, vector array<double>, region int, cells array<int>"
    asked = q.mapInArrow(place, fields)
    if every:
        n = q.count()
        queries = {r: n for r in regions["region"].unique().tolist()}
    else:
        counted = asked.groupBy("region").agg(F.count("*").alias("n"))
        queries = {r["region"]: r["n"] for r in collect_bounded(counted, index.cells, "regions")}
    together = min(BLOCK_QUERIES, max(1, BLOCK_VALUES // index.centroids.shape[1]))
    sizes = regions.assign(q_blocks=[-(-queries.get(r, 0) // together) for r in regions["region"]])
    blocks = F.broadcast(spark.createDataFrame(
        sizes.groupby("region")[["q_blocks", "d_blocks"]].max().reset_index(), "region int, q_blocks long, d_blocks long"))
    cells = F.broadcast(spark.createDataFrame(regions[["cell", "region"]], "cell int, region int"))

    def blocked(df, own, other, key):
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1))
        mine = F.pmod(F.xxhash64(key), F.col(f"{own}_blocks"))
        return df.join(blocks.filter("q_blocks > 0"), "region").select(*df.columns, mine.alias(f"{own}_block"), each.alias(f"{other}_block"))

    def compare(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(stored):
            return pd.DataFrame(columns=["query_id", "collection", "doc_id", "distance"])
        top = _TopK(asked["query_id"].to_numpy(), _matrix(asked["vector"]), k, metric)
        lists = None if every else asked["cells"].to_numpy()
        _add(top, _Asked(None, None) if every else _Asked(np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])), stored)
        return top.frame()

    by = ["region", "q_block", "d_block"]
    return blocked(asked, "q", "d", "query_id").groupBy(*by).cogroup(
        blocked(stored.join(cells, "cell"), "d", "q", "doc_id").groupBy(*by)).applyInPandas(compare, schema)


def rows_in_reach(index: VectorIndex, queries: DataFrame, like: DataFrame, probes: int, vector: str = "embedding") -> DataFrame:
    """``query_id, n_rows``: the stored rows in the cells that a query probes; of repeated ids the most."""
    counts = np.zeros(index.cells, np.int64)
    counted = stored_rows(queries.sparkSession, index, like).groupBy("cell").agg(F.count("*").alias("n"))
    for row in collect_bounded(counted, max(index.cells, 1), "cells"):
        counts[row["cell"]] = row["n"]
    shared, metric = share((index.centroids, counts)), index.metric

    @F.pandas_udf("long")
    def reached(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int64")
        centroids, counts = shared.value
        return pd.Series(counts[_ranked_cells(_matrix(vectors), centroids, probes, metric)].sum(axis=1))

    return queries.select("query_id", reached(F.col(vector).cast("array<double>")).alias("n_rows")).groupBy("query_id").agg(F.max("n_rows").alias("n_rows"))


def _cell_places(vectors: np.ndarray, cells: np.ndarray, index_centroids: np.ndarray, metric: str) -> np.ndarray:
    """The place of a cell in each vector's order of cells, as ``_ranked_cells`` has it, without sorting."""
    rows = _unit(vectors) if metric == "cosine" else vectors
    own, found = (index_centroids**2).sum(1)[None, :], np.empty(len(rows), np.int32)
    together, numbers = max(1, MATRIX_VALUES // len(index_centroids)), np.arange(len(index_centroids))
    for start in range(0, len(rows), together):
        squared = np.round(own - 2.0 * rows[start : start + together] @ index_centroids.T, 10)
        cell = cells[start : start + together, None]
        mine = np.take_along_axis(squared, cell, axis=1)
        found[start : start + together] = ((squared < mine) | ((squared == mine) & (numbers < cell))).sum(axis=1)
    return found


def probes_for(
    index: VectorIndex, docs: DataFrame, k: int = 5, recall: float = 0.95, vector: str = "embedding", measured: int | None = MEASURED
) -> int:
    """The fewest probes with which so many of the exact neighbours of some stored passages would be found.

    The passages are the ``measured`` ones with the smallest hash of their ids, or all where that is None.
    """
    if not index.cells:
        return 1
    rows = docs.select("doc_id", F.col(vector).alias("embedding"))
    some = rows if measured is None else rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(measured)
    some = some.select(F.col("doc_id").alias("query_id"), "embedding")
    exact = nearest(some, docs.select("collection", "doc_id", F.col(vector).alias("embedding")), k, index.metric).select("query_id", "collection", "doc_id")
    stored = stored_rows(docs.sparkSession, index, docs).select("collection", "doc_id", "cell")
    same = F.col("collection").eqNullSafe(F.col("s_collection")) & (F.col("doc_id") == F.col("s_doc"))
    cells = exact.join(stored.select(F.col("collection").alias("s_collection"), F.col("doc_id").alias("s_doc"), "cell"), same)
    shared, metric = share(index.centroids), index.metric

    @F.pandas_udf("int")
    def place(vectors: pd.Series, cells: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int32")
        return pd.Series(_cell_places(_matrix(vectors), cells.to_numpy(), shared.value, metric))

    placed = cells.join(some, "query_id").select(place("embedding", "cell").alias("place"))
    share_of = placed.agg(F.percentile("place", F.lit(recall))).first()[0]
    return 1 if share_of is None else int(np.ceil(share_of)) + 1
