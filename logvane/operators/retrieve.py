"""Nearest passages per collection, re-ranking, citation tags and context assembly."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logvane.functions.text import clean_tokens
from logvane.session import TooLarge, collect_bounded, share

# up to this many queries are shipped to every executor
MAX_SHARED_QUERIES = 2_000
# rows and coordinates of a block beyond (50,000 vectors of 64), and rows below which a block is not cut for the sake of more tasks
BLOCK_QUERIES = BLOCK_DOCS = 50_000
BLOCK_VALUES, LEAST_BLOCK = 3_200_000, 1_000
# distances held at once (16 MB), and rows compared at once
MATRIX_VALUES = 2_000_000
ROWS_TOGETHER = 5_000
SEPARATOR = "\n\n---\n\n"
# similarities closer than this are ties, resolved by document id
DIGITS = 10


class _TopK:
    """The k nearest documents per (query, collection) among the rows a task has seen."""

    def __init__(self, query_ids: np.ndarray, vectors: np.ndarray, k: int, metric: str):
        self.query_ids, self.k, self.metric = query_ids, k, metric
        self.vectors = _unit(vectors) if metric == "cosine" else vectors
        # per collection: number of the query, distance and document, the best k of each query
        self.best: dict[object, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.waiting: dict[object, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def _near(self, rows: np.ndarray, asked: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of queries, of rows, and distances: the k nearest of every asked query and all ties with the last."""
        found = []
        if self.metric == "cosine":
            rows = _unit(rows)
        own = (rows**2).sum(1)
        every = np.arange(len(self.vectors)) if asked is None else asked
        # a matrix of all queries and rows may be far larger than both
        for part in np.array_split(every, max(1, -(-len(every) * len(rows) // MATRIX_VALUES))):
            mine = self.vectors[part]
            if self.metric == "cosine":
                away = 1.0 - mine @ rows.T
            else:
                squares = (mine**2).sum(1)
                away = np.maximum(squares[:, None] + own[None, :] - 2.0 * mine @ rows.T, 0.0)
            if away.shape[1] > self.k:
                # ties at the limit all stay: the document decides between them
                limit = np.partition(away, self.k - 1, axis=1)[:, self.k - 1]
                if self.metric == "cosine":
                    limit = limit + 2 * 10.0**-DIGITS
                else:
                    # squares from products are off by their rounding
                    blur = 1e-12 * (squares + own.max())
                    limit = (np.sqrt(limit + blur) + 2 * 10.0**-DIGITS) ** 2 + blur
                query, at = np.nonzero(away <= limit[:, None])
            else:
                query, at = (x.ravel() for x in np.indices(away.shape))
            near = away[query, at] if self.metric == "cosine" else _distances(mine, rows, query, at)
            found.append((part[query], at, np.round(near, DIGITS)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def add(self, collections: np.ndarray, ids: np.ndarray, rows: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Compare rows with all queries, or with those of the numbers ``asked``."""
        for name in pd.unique(collections):
            chosen = np.flatnonzero(collections == name)
            # few rows at a time, or ties of many alike rows would be held together
            for start in range(0, len(chosen), ROWS_TOGETHER):
                part = chosen[start : start + ROWS_TOGETHER]
                query, at, near = self._near(rows[part], asked)
                waiting = self.waiting.setdefault(name, [])
                waiting.append((query, near, ids[part][at]))
                if sum(len(w[0]) for w in waiting) > MATRIX_VALUES // 4 + 2 * self.k * len(self.vectors):
                    self._fold(name)

    def _fold(self, name: object) -> None:
        """The best of what a collection has and what waits for it."""
        waiting = self.waiting.pop(name, [])
        if name in self.best:
            waiting.append(self.best[name])
        found = tuple(np.concatenate(x) for x in zip(*waiting))
        order = np.lexsort((found[2], found[1], found[0]))
        query, near, docs = (x[order] for x in found)
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.best[name] = tuple(x[rank < self.k] for x in (query, near, docs))

    def frame(self) -> pd.DataFrame:
        for name in list(self.waiting):
            self._fold(name)
        parts = [
            pd.DataFrame({"query_id": self.query_ids[query], "collection": name, "doc_id": docs, "distance": near})
            for name, (query, near, docs) in self.best.items()
        ]
        return pd.concat(parts) if parts else pd.DataFrame(columns=["query_id", "collection", "doc_id", "distance"])


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1.0)


def _distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of some pairs of rows, from differences: equal rows have distance 0 however they are dealt out."""
    step = max(1, MATRIX_VALUES // max(a.shape[1], 1))
    parts = [np.sqrt(((a[i[s : s + step]] - b[j[s : s + step]]) ** 2).sum(1)) for s in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.empty(0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def nearest(
    queries: DataFrame, docs: DataFrame, k: int = 5, metric: str = "cosine", collection: str = "collection",
    doc_id: str = "doc_id", vector: str = "embedding", max_shared: int = MAX_SHARED_QUERIES,
) -> DataFrame:
    """``query_id, collection, doc_id, distance, rank``: exact k nearest documents per collection.

    ``queries`` holds ``query_id`` and the vector. A query matrix within the
    checked bound goes to every executor and documents stay where they are;
    beyond it both sides are cut into blocks that meet pairwise. Either way a
    task emits only its own k best, never a table of pairs.
    """
    q = queries.select("query_id", F.col(vector).cast("array<double>").alias("vector"))
    d = docs.select(
        F.col(collection).alias("collection"), F.col(doc_id).alias("doc_id"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    types = dict(q.dtypes) | dict(d.dtypes)
    schema = (
        f"query_id {types['query_id']}, collection {types['collection']}, doc_id {types['doc_id']}, distance double"
    )
    try:
        rows = sorted(collect_bounded(q, max_shared, "queries"))
        found = _nearest_shared(rows, d, k, metric, schema)
    except TooLarge:
        found = _nearest_blocked(q, d, k, metric, schema)
    order = Window.partitionBy("query_id", "collection").orderBy("distance", "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _nearest_shared(rows: list, docs: DataFrame, k: int, metric: str, schema: str) -> DataFrame:
    if not rows:
        return docs.sparkSession.createDataFrame([], schema)
    shared = share((np.array([r["query_id"] for r in rows]), np.array([r["vector"] for r in rows])))

    def search(batches):
        top = _TopK(*shared.value, k, metric)
        for batch in batches:
            if len(batch):
                top.add(batch["collection"].to_numpy(), batch["doc_id"].to_numpy(), _matrix(batch["vector"]))
        yield top.frame()

    return docs.mapInPandas(search, schema)


def block_numbers(queries: int, docs: int, width: int, tasks: int) -> tuple[int, int]:
    """Blocks of queries and of documents: bounded in size, and enough pairs of them for all tasks."""
    most, side = max(1, BLOCK_VALUES // max(width or 1, 1)), math.ceil(math.sqrt(2 * tasks))
    blocks = lambda n, rows: max(1, math.ceil(n / min(rows, most)), min(side, n // LEAST_BLOCK))
    return blocks(queries, BLOCK_QUERIES), blocks(docs, BLOCK_DOCS)


def blocks_met(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, width: int):
    """Both sides grouped by pairs of blocks, to be compared by ``cogroup``: a row is copied once per block of the other side."""
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    query_blocks, doc_blocks = block_numbers(queries.count(), docs.count(), width, tasks)
    # small blocks are much work: the adaptive planner would merge them into few tasks
    parts = min(2 * query_blocks * doc_blocks, 2_000)

    def blocked(df, own, own_blocks, key, other, other_blocks):
        placed = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(own_blocks)).cast("int"))
        copied = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))))
        return copied.repartition(parts, "qb", "db").groupBy("qb", "db")

    return blocked(queries, "qb", query_blocks, query_id, "db", doc_blocks).cogroup(blocked(docs, "db", doc_blocks, doc_id, "qb", query_blocks))


def _nearest_blocked(queries: DataFrame, docs: DataFrame, k: int, metric: str, schema: str) -> DataFrame:
    def search(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame(columns=["query_id", "collection", "doc_id", "distance"])
        top = _TopK(q["query_id"].to_numpy(), _matrix(q["vector"]), k, metric)
        top.add(d["collection"].to_numpy(), d["doc_id"].to_numpy(), _matrix(d["vector"]))
        return top.frame()

    width = docs.agg(F.max(F.size("vector"))).first()[0]
    return blocks_met(queries, docs, "query_id", "doc_id", width).applyInPandas(search, schema)


def most_similar(centers: DataFrame, key: str = "topic", vector: str = "centroid", k: int = 10) -> DataFrame:
    """Cosine of every topic to the ``k`` topics most like it, itself among them; ties go to the smaller topic."""
    asked = centers.select(F.col(key).alias("query_id"), F.col(vector).alias("embedding"))
    among = centers.select(F.lit(0).alias("collection"), F.col(key).alias("doc_id"), F.col(vector).alias("embedding"))
    return nearest(asked, among, k).select(
        F.col("query_id").alias(key), F.col("doc_id").alias(f"other_{key}"), (1 - F.col("distance")).alias("similarity"), "rank"
    )


def similarity_matrix(centers: DataFrame, key: str = "topic", vector: str = "centroid") -> DataFrame:
    """Cosine of every topic to every topic, by falling similarity; as many rows as pairs of topics."""
    return most_similar(centers, key, vector, k=max(centers.count(), 1))


# --- re-ranking -------------------------------------------------------------------------------------------------

K1, B = 1.2, 0.75


def bm25(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, key: list[str]) -> DataFrame:
    """Add ``bm25`` to ``candidates`` (``query_id`` and the corpus key columns).

    ``queries``: ``query_id, tokens``; ``corpus``: the key columns and ``tokens``.
    Document frequencies are counted for query terms only, over the whole corpus.
    """
    query_terms = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
    lengths = corpus.agg(
        F.struct(F.count("*").alias("docs"), F.avg(F.size("tokens")).alias("mean"))
    ).scalar()
    frequency = (
        corpus.select(F.explode(F.array_distinct("tokens")).alias("term"))
        .join(query_terms.select("term").distinct(), "term", "left_semi")
        .groupBy("term").agg(F.count("*").alias("df"))
    )
    found = candidates.select("query_id", *key).join(corpus.select(*key, "tokens"), key)
    counted = (
        found.select("query_id", *key, F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
        .join(query_terms, ["query_id", "term"])
        .groupBy("query_id", *key, "length", "term").agg(F.count("*").alias("tf"))
        .join(frequency, "term")
    )
    n = lengths["docs"]
    idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / lengths["mean"])
    scored = counted.groupBy("query_id", *key).agg(F.sum(idf * F.col("tf") * (K1 + 1) / norm).alias("bm25"))
    return candidates.join(scored, ["query_id", *key], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def rerank(candidates: DataFrame, score: str, then: list[str], k: int | None = None) -> DataFrame:
    """``place`` per query by falling score, equal scores in retrieval order; all are kept unless ``k`` is given."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, DIGITS)), *then)
    placed = candidates.withColumn("place", F.row_number().over(order))
    return placed if k is None else placed.filter(F.col("place") <= k)


# --- passages ---------------------------------------------------------------------------------------------------

ID_KEYS = ["tech_id", "d3fend_id", "cve_id", "update_id"]


def citation_tag(meta: Column, collection: Column) -> Column:
    """``[SOURCE: id]`` with the first identifier present, else the title."""
    source = F.upper(F.coalesce(meta["source"], collection))
    found = F.coalesce(*[F.nullif(meta[k], F.lit("")) for k in [*ID_KEYS, "title"]])
    return F.when(found.isNull(), F.concat(F.lit("["), source, F.lit("]"))).otherwise(
        F.concat(F.lit("["), source, F.lit(": "), found, F.lit("]"))
    )


def passage(meta: Column, collection: Column, text: Column) -> Column:
    """Tag line and text, whole as it was ranked."""
    return F.concat(citation_tag(meta, collection), F.lit("\n"), text)


def assemble(placed: DataFrame, name: str = "retrieved_docs") -> DataFrame:
    """One text per query: passages in order of ``place``; a query has at most k per collection of them."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "passage")))
    return placed.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["passage"]), SEPARATOR).alias(name)
    )


def retrieve(
    queries: DataFrame, kb: DataFrame, k: int = 5, metric: str = "cosine", tokens=clean_tokens, reranker=None
) -> DataFrame:
    """``queries(query_id, query, embedding)`` to ranked passages.

    ``kb``: ``collection, doc_id, text, meta, embedding``. Candidates of all
    collections are scored jointly by BM25 over whole texts, or by ``reranker``
    (columns query and text to a score), and reordered; none is dropped. A
    ``tokens`` column stored with the passages saves tokenizing them again.
    """
    key = ["collection", "doc_id"]
    stored = F.col("tokens") if "tokens" in kb.columns else tokens(F.col("text"))
    found = nearest(queries, kb, k, metric)
    if reranker is None:
        scored = bm25(
            found, queries.select("query_id", tokens(F.col("query")).alias("tokens")),
            kb.select(*key, stored.alias("tokens")), key,
        ).withColumnRenamed("bm25", "score")
        scored = scored.join(kb.select(*key, "text", "meta"), key)
    else:
        scored = found.join(kb.select(*key, "text", "meta"), key).join(queries.select("query_id", "query"), "query_id")
        scored = scored.withColumn("score", reranker(F.col("query"), F.col("text"))).drop("query")
    placed = rerank(scored, "score", ["distance", *key])
    return placed.withColumn("passage", passage(F.col("meta"), F.col("collection"), F.col("text")))


def with_context(queries: DataFrame, placed: DataFrame) -> DataFrame:
    """Queries with their assembled passages, '' where nothing was found."""
    return queries.join(assemble(placed), "query_id", "left").withColumn(
        "retrieved_docs", F.coalesce("retrieved_docs", F.lit(""))
    )
