"""Class-based TF-IDF keywords [Grootendorst 2022]."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logvane.session import BROADCAST_ROWS, materialize

MIN_TOPICS = 2


#: words counted at once, and distinct terms that a task holds before it passes them on
WORDS_TOGETHER, TERMS_HELD = 2_000_000, 1_000_000
#: bytes of documents behind a bucket of terms, and buckets at most
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 8_192


class _Numbered(NamedTuple):
    """Counts of terms by number: ``words[first]`` and, where it is not -1, ``words[second]`` in ``topics[topic]``."""

    words: pa.Array
    topics: pa.Array
    topic: np.ndarray
    first: np.ndarray
    second: np.ndarray
    n: np.ndarray


def _numbered(topics: pa.Array, weights: np.ndarray, lists: pa.ListArray) -> _Numbered:
    """The words and pairs of some documents, counted by number."""
    words = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    named = topics.dictionary_encode("encode")
    topic = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
    size = max(len(words.dictionary), 1)
    inside = row[1:] == row[:-1]
    single, pair = topic * size + code, ((topic[:-1] * size + code[:-1]) * size + code[1:])[inside]
    found = []
    for keys, weight, pairs in ((single, weights[row], False), (pair, weights[row[:-1]][inside], True)):
        sums = pa.table({"key": keys, "n": weight}).group_by("key", use_threads=False).aggregate([("n", "sum")])
        key, first = np.divmod(sums["key"].to_numpy(), size)
        second = np.full(len(key), -1)
        if pairs:
            (key, first), second = np.divmod(key, size), first
        found.append((*(x.astype(np.int32) for x in (key, first, second)), sums["n_sum"].to_numpy()))
    return _Numbered(words.dictionary, named.dictionary, *(np.concatenate(x) for x in zip(*found)))


def _spelt(counts: _Numbered) -> pa.Array:
    """The terms as text."""
    first = counts.words.take(pa.array(counts.first))
    pair = pa.array(counts.second >= 0)
    second = counts.words.take(pa.array(np.maximum(counts.second, 0)))
    return pc.if_else(pair, pc.binary_join_element_wise(first, second, " "), first)


def _slice_counts(topics: pa.Array, weights: np.ndarray, lists: pa.ListArray) -> pa.Table:
    """``topic, term, n`` of some documents: words and pairs are counted by number, and only distinct ones are spelt out."""
    counts = _numbered(topics, weights, lists)
    return pa.table({"topic": counts.topics.take(pa.array(counts.topic)), "term": _spelt(counts), "n": counts.n})


def _parted(counts: _Numbered) -> _Numbered:
    """Every term as what is before its first blank and what is behind, so that equal texts have equal numbers."""
    if not pc.any(pc.match_substring(counts.words, " ")).as_py():
        return counts
    parts = [term.partition(" ") for term in _spelt(counts).to_pylist()]
    words = pa.array([w for first, _, second in parts for w in (first, second)], pa.string()).dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    second = np.where([bool(blank) for _, blank, _ in parts], code[1::2], np.int32(-1))
    return counts._replace(words=words.dictionary, first=code[::2], second=second)


def _merged(parts: list[_Numbered]) -> _Numbered:
    """Counts of several pieces by common numbers, ordered by term and topic."""
    def common(name):
        coded = pa.concat_arrays([getattr(p, name) for p in parts]).dictionary_encode("encode")
        ends = np.cumsum([len(getattr(p, name)) for p in parts])[:-1]
        return coded.dictionary, np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), ends)

    (words, of_word), (topics, of_topic) = common("words"), common("topics")
    topic = np.concatenate([of[p.topic] for p, of in zip(parts, of_topic)])
    first = np.concatenate([of[p.first] for p, of in zip(parts, of_word)])
    # the last place of a part's numbers is taken by -1, which stays
    second = np.concatenate([np.r_[of, np.int32(-1)][p.second] for p, of in zip(parts, of_word)])
    n = np.concatenate([p.n for p in parts])
    key = first.astype(np.int64) * (len(words) + 1) + second + 1
    if (len(words) + 1) ** 2 * (len(topics) + 1) >= 1 << 62:
        key = np.unique(key, return_inverse=True)[1]
    key *= len(topics)
    key += topic
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
    some = order[starts]
    return _Numbered(words, topics, topic[some], first[some], second[some], np.add.reduceat(n[order], starts) if len(starts) else n)


def _least(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes as they need."""
    return values.astype(np.min_scalar_type(values.max())) if len(values) and values.dtype.kind in "iu" and values.min() >= 0 else values


def _packed(counts: _Numbered, buckets: int) -> Iterator[pa.RecordBatch]:
    """``bucket, size, packed``: the counts dealt by the hash of their terms, each bucket with its own words, compressed."""
    hashes = pd.util.hash_array(counts.words.to_numpy(zero_copy_only=False), categorize=False)
    mixed = hashes[counts.first] * np.uint64(0x9E3779B97F4A7C15) + np.r_[hashes, np.uint64(1)][counts.second] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    del mixed
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(ends)):
        some = order[ends[b] : ends[b + 1]]
        first, second = counts.first[some], counts.second[some]
        used, word = np.unique(np.r_[-1, first, second], return_inverse=True)
        topics, topic = np.unique(counts.topic[some], return_inverse=True)
        # number 0 is no word
        word = word[1:]
        plain = pickle.dumps((
            counts.words.take(pa.array(used[1:])), counts.topics.take(pa.array(topics)), _least(topic),
            *(_least(x) for x in (word[: len(some)], word[len(some) :], counts.n[some]))), protocol=5)
        yield pa.RecordBatch.from_arrays(
            [pa.array([b], pa.int32()), pa.array([len(plain)], pa.int32()), pa.array([pa.compress(plain, "zstd", asbytes=True)], pa.binary())],
            ["bucket", "size", "packed"])


def _unpacked(packed: bytes, size: int) -> _Numbered:
    words, topics, topic, first, second, n = pickle.loads(pa.decompress(packed, size, "zstd", asbytes=True))
    return _Numbered(words, topics, *(x.astype(np.int32) - np.int32(back) for x, back in ((topic, 0), (first, 1), (second, 1))), n if n.dtype.kind == "f" else n.astype(np.int64))


def _weighed(docs: DataFrame, topic: str, tokens: str, weight: str | None) -> tuple[DataFrame, str]:
    """``topic, w, tokens`` of the documents that count, and the type of the weights: whole or doubles."""
    w = F.col(weight) if weight else F.lit(1)
    rows = docs.select(F.col(topic).alias("topic"), w.alias("w"), F.col(tokens).alias("tokens"))
    kind = "bigint" if dict(rows.dtypes)["w"] in ("tinyint", "smallint", "int", "bigint") else "double"
    return rows.withColumn("w", F.col("w").cast(kind)).filter("w IS NOT NULL AND tokens IS NOT NULL"), kind


def _slices(batch: pa.RecordBatch, together: int) -> Iterator[tuple[pa.Array, np.ndarray, pa.ListArray]]:
    """Topics, weights and words of a batch, about so many words at once."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(batch):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + together, "right")))
        part = batch.slice(start, stop - start)
        yield part.column("topic"), part.column("w").to_numpy(zero_copy_only=False), part.column("tokens")
        start = stop


def partial_counts(docs: DataFrame, topic: str = "topic", tokens: str = "tokens", weight: str | None = None) -> DataFrame:
    """``topic, term, n`` of every task, to be summed by topic and term: a task counts before anything is shuffled.

    A row for each word and pair of each document is never made. A task holds a bounded number of distinct terms and passes
    them on beyond that, so a term may have several rows. Null terms are words like others; weights are whole or doubles.
    """
    rows, kind = _weighed(docs, topic, tokens, weight)

    def fold(parts: list[pa.Table]) -> pa.Table:
        counts = pa.concat_tables(parts).group_by(["topic", "term"], use_threads=False).aggregate([("n", "sum")])
        return counts.select(["topic", "term", "n_sum"]).rename_columns(["topic", "term", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            for part in _slices(batch, WORDS_TOGETHER):
                held.append(_slice_counts(*part))
                waiting += len(held[-1])
                if waiting > 2 * TERMS_HELD:
                    held = [fold(held)]
                    waiting = len(held[0])
                    if waiting > TERMS_HELD:
                        yield from held.pop().combine_chunks().to_batches(max_chunksize=50_000)
                        waiting = 0
        if held:
            yield from fold(held).combine_chunks().to_batches(max_chunksize=50_000)

    return rows.mapInArrow(count, f"topic {dict(rows.dtypes)['topic']}, term string, n {kind}").withColumnRenamed("topic", topic)


def term_counts(
    docs: DataFrame, topic: str = "topic", tokens: str = "tokens", weight: str | None = None, min_topics: int | None = None
) -> DataFrame:
    """How often each word and word pair occurs per topic.

    With ``min_topics`` only the terms found in so many topics, each with the number of its ``topics`` and its ``total``
    over them: the others are never spelt out.
    """
    if min_topics is not None:
        return _shared_counts(docs, topic, tokens, weight, min_topics)
    return partial_counts(docs, topic, tokens, weight).groupBy(topic, "term").agg(F.sum("n").cast("bigint").alias("n"))


def _shared_counts(docs: DataFrame, topic: str, tokens: str, weight: str | None, min_topics: int) -> DataFrame:
    """Tasks count terms by number and pass them on in one compressed piece per bucket of terms; a bucket is one task's work.

    A bucket holds all of a term, so that nothing is joined or counted again. Buckets grow in number with the bytes of the
    documents, not in size. Numbers stand for texts that travel along, never for hashes alone.
    """
    rows, _ = _weighed(docs, topic, tokens, weight)
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = min(MOST_BUCKETS, max(2 * tasks, size // BUCKET_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            for part in _slices(batch, WORDS_TOGETHER // 4):
                held.append(_parted(_numbered(*part)))
                waiting += len(held[-1].n)
                if waiting > TERMS_HELD:
                    held = [_merged(held)]
                    waiting = len(held[0].n)
                    if waiting > TERMS_HELD // 2:
                        yield from _packed(held.pop(), buckets)
                        pa.default_memory_pool().release_unused()
                        waiting = 0
        if held:
            yield from _packed(_merged(held), buckets)

    kind = dict(rows.dtypes)["topic"]
    pieces = rows.mapInArrow(count, "bucket int, size int, packed binary").repartition(buckets, "bucket")

    def sum_up(pieces: pa.Table) -> pa.Table:
        counts = _merged([_unpacked(packed, size) for packed, size in zip(pieces["packed"].to_pylist(), pieces["size"].to_pylist())])
        n = counts.n.astype(np.int64)
        starts = np.flatnonzero(np.r_[len(n) > 0, (counts.first[1:] != counts.first[:-1]) | (counts.second[1:] != counts.second[:-1])])
        topics = np.diff(np.r_[starts, len(n)])
        total = np.add.reduceat(n, starts) if len(starts) else n
        kept = np.repeat(topics >= min_topics, topics)
        some = counts._replace(topic=counts.topic[kept], first=counts.first[kept], second=counts.second[kept], n=n[kept])
        found = pa.table({
            "topic": some.topics.take(pa.array(some.topic)), "term": _spelt(some), "n": some.n,
            "topics": np.repeat(topics, topics)[kept], "total": np.repeat(total, topics)[kept]})
        return pa.Table.from_batches(found.combine_chunks().to_batches(max_chunksize=50_000), found.schema)

    found = pieces.groupBy("bucket").applyInArrow(sum_up, f"topic {kind}, term string, n bigint, topics bigint, total bigint")
    return found.withColumnRenamed("topic", topic)


def vocabulary(counts: DataFrame, min_topics: int = MIN_TOPICS, max_terms: int | None = None) -> DataFrame:
    """Terms found in enough topics: all of them, or the ``max_terms`` most frequent."""
    found = (
        counts.groupBy("term").agg(F.count("*").alias("topics"), F.sum("n").alias("total"))
        .filter(F.col("topics") >= min_topics).select("term", "total")
    )
    return found if max_terms is None else found.orderBy(F.desc("total"), "term").limit(max_terms)


def term_weights(
    counts: DataFrame, topic: str = "topic", min_topics: int = MIN_TOPICS, max_terms: int | None = None
) -> DataFrame:
    """``weight = n / topic length * ln(1 + mean topic length / total n)`` over the vocabulary.

    The counts are stored first: vocabulary, lengths and weights all read them. Counts that carry their totals
    (``term_counts`` with ``min_topics``) need no vocabulary.
    """
    if "total" in counts.columns and max_terms is None:
        kept = materialize(counts.filter(F.col("topics") >= min_topics), "term-counts")
    else:
        counts = materialize(counts.select(topic, "term", "n"), "term-counts")
        kept = counts.join(vocabulary(counts, min_topics, max_terms), "term")
    lengths = materialize(kept.groupBy(topic).agg(F.sum("n").alias("length")), "topic-lengths")
    mean_length = lengths.agg(F.avg("length")).scalar()
    if lengths.count() <= BROADCAST_ROWS:
        lengths = F.broadcast(lengths)
    weight = F.col("n") / F.col("length") * F.log1p(mean_length / F.col("total"))
    return kept.join(lengths, topic).select(topic, "term", "n", weight.alias("weight"))


def top_terms(weights: DataFrame, topic: str = "topic", n: int = 10) -> DataFrame:
    order = Window.partitionBy(topic).orderBy(F.desc(F.round("weight", 12)), "term")
    return weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def keyword_text(top: DataFrame, topic: str = "topic", noise: int | str | None = -1) -> DataFrame:
    """``topic_keywords``: the ranked terms joined by commas, noise left out."""
    if noise is not None:
        top = top.filter(F.col(topic) != noise)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return top.groupBy(topic).agg(F.array_join(F.transform(ranked, lambda s: s["term"]), ", ").alias("topic_keywords"))


def with_keywords(df: DataFrame, keywords: DataFrame, topic: str = "topic", missing: str = "unknown") -> DataFrame:
    """Look the keywords of each row's topic up."""
    return df.join(keywords, topic, "left").withColumn(
        "topic_keywords", F.coalesce("topic_keywords", F.lit(missing))
    )
