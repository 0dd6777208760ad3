"""Quality classifier: a factorization machine over hashed words, structure statistics and metadata.

A text is a sparse vector: its distinct hashed words, scaled to unit length, and
one indicator for the band of every structure statistic and metadata column.
The score is the logistic of ``w0 + <w, x> + 1/2 sum_f ((sum v_if x_i)^2 -
sum v_if^2 x_i^2)``, which takes time linear in the number of words.

The model is fitted on a bounded draw of labelled rows, as many of either
label as fit, and its intercept is moved back to the true odds. Scoring covers
every text whole.

Defined cases: a null text counts as empty; an empty text has no words and is
scored by its bands alone. A null metadata value has a band of its own. Labels
that are null do not count, a text labelled twice is good only if all its
labels are. If one of the labels is missing, the score is the share of good
ones, and 0.5 without any. Repeated rows score alike. Other columns are kept,
those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logvane.llm.text import Texts, chunks, small_batches, texts_of, word_hashes, words_of
from logvane.session import collect_bounded, share

#: bounds of the fit: labelled rows of either label, and sparse entries altogether
ROWS_PER_LABEL = 2_500
MAX_ENTRIES = 6_000_000
WORD_BITS = 16
FACTORS = 8
EPOCHS = 8
BATCH = 128
RATE = 0.05
DECAY_WORDS, DECAY_BANDS = 2e-3, 1e-4
THRESHOLD = 0.7

#: statistic -> upper ends of its bands
BANDS = {
    "words": [1, 5, 20, 50, 100, 200, 400, 800, 1_600, 3_200, 6_400],
    "word_bytes": [2, 3, 4, 5, 6, 7, 8, 10, 12, 16],
    "distinct": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97],
    "top_word": [0.01, 0.02, 0.04, 0.06, 0.08, 0.12, 0.2, 0.35, 0.6],
    "symbols": [0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4],
    "marks": [0.0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.3],
    "bars": [0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.3],
    "capitals": [0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.4, 0.7],
    "digits": [0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.3],
    "stops": [0.002, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.1],
    "line_words": [1, 3, 6, 10, 20, 40, 80, 160, 400],
    "line_repeats": [0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7],
}
META_BANDS = [0, *(2**i for i in range(3, 24))]
WIDTH = 24  # slots for the bands of one statistic or metadata column; the last is for null


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for number, group in enumerate((b"#*$%&<>", b"!?", b"|", bytes(range(0x41, 0x5B)), b"0123456789", b".,;:"), 1):
        table[list(group)] = number
    return table


_CLASSES = _class_table()
_CLASS_NAMES = ["symbols", "marks", "bars", "capitals", "digits", "stops"]
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _distinct_counts(text: np.ndarray, keys: np.ndarray, count: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs with their counts; buckets are the top bits of the keys."""
    packed = np.sort((text.astype(np.uint64) << np.uint64(bits)) | (keys >> np.uint64(64 - bits)))
    fresh = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.empty(0, np.int64)
    times = np.diff(np.append(fresh, len(packed)))
    packed = packed[fresh]
    return (packed >> np.uint64(bits)).astype(np.int64), (packed & np.uint64((1 << bits) - 1)).astype(np.int64), times


@dataclass
class Sparse:
    """Rows of a sparse matrix: entries of row i stand at ``bounds[i]:bounds[i + 1]``."""

    bounds: np.ndarray
    index: np.ndarray
    value: np.ndarray


def features(texts: Texts, meta: np.ndarray) -> Sparse:
    """Sparse vectors of texts; ``meta`` has a row per text, nan for null."""
    n = len(texts)
    words = words_of(texts)
    hashes = word_hashes(texts.data, words)
    row, bucket, times = _distinct_counts(words.text, hashes, n, WORD_BITS)
    distinct = np.bincount(row, minlength=n)
    n_words = np.diff(words.bounds)
    most = np.zeros(n)
    np.maximum.at(most, row, times)
    n_bytes = np.maximum(_per_text(words.ends - words.starts, words.bounds), 1)
    lines = words_of(texts, _NEWLINE)
    line_row, _, line_times = _distinct_counts(lines.text, word_hashes(texts.data, lines), n, 32)
    n_lines, some_words = np.diff(lines.bounds), np.maximum(n_words, 1)
    classes = _CLASSES[texts.data]
    stats = {
        "words": n_words, "word_bytes": n_bytes / some_words, "distinct": distinct / some_words, "top_word": most / some_words,
        "line_words": n_words / np.maximum(n_lines, 1),
        "line_repeats": 1 - np.bincount(line_row, minlength=n) / np.maximum(n_lines, 1),
    }
    for number, name in enumerate(_CLASS_NAMES, 1):
        stats[name] = _per_text(classes == number, texts.offsets) / n_bytes
    stats["line_repeats"][n_lines == 0] = 0
    bands = [np.searchsorted(ends, stats[name], "left") for name, ends in BANDS.items()]
    for column in meta.T:
        bands.append(np.where(np.isnan(column), WIDTH - 1, np.searchsorted(META_BANDS, np.nan_to_num(column), "left")))
    bands = np.stack(bands, 1) + (1 << WORD_BITS) + WIDTH * np.arange(len(bands))
    k = bands.shape[1]
    bounds = np.concatenate([[0], np.cumsum(distinct + k)])
    index, value = np.empty(bounds[-1], np.int32), np.empty(bounds[-1], np.float32)
    at_band = (bounds[1:] - k)[:, None] + np.arange(k)
    index[at_band], value[at_band] = bands, 1.0
    at_word = np.arange(len(row)) + np.repeat(np.arange(n) * k, distinct)
    index[at_word], value[at_word] = bucket, (1 / np.sqrt(np.maximum(distinct, 1)))[row]
    return Sparse(bounds, index, value)


@dataclass
class Machine:
    """A fitted model. ``shift`` moves the log-odds of the draw to those of all labelled rows."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    shift: float

    def logits(self, rows: Sparse) -> np.ndarray:
        return self.bias + self.shift + _raw(self.linear, self.factors, rows)[0]

    def scores(self, rows: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -40, 40)))


def _raw(linear: np.ndarray, factors: np.ndarray, rows: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linear and pairwise part of every row, the factor sums of rows, and the scaled factors of entries."""
    scaled = factors[rows.index] * rows.value[:, None]
    at = rows.bounds[:-1]
    sums = np.add.reduceat(scaled, at, 0)
    squares = np.add.reduceat((scaled * scaled).sum(1), at)
    first = np.add.reduceat(linear[rows.index] * rows.value, at)
    return first + 0.5 * ((sums * sums).sum(1) - squares), sums, scaled


def train(rows: Sparse, labels: np.ndarray, n_meta: int, shift: float) -> Machine:
    """Adaptive gradient descent on the logistic loss, in a fixed order that depends on the seed alone."""
    rng = np.random.default_rng(7)
    size = (1 << WORD_BITS) + WIDTH * (len(BANDS) + n_meta)
    linear, factors, bias = np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32), 0.0
    seen_linear, seen_factors, seen_bias = np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32), 1e-6
    decay = np.full(size, DECAY_WORDS, np.float32)
    decay[1 << WORD_BITS :] = DECAY_BANDS
    lengths = np.diff(rows.bounds)
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for begin in range(0, len(order), BATCH):
            pick = order[begin : begin + BATCH]
            size_of = lengths[pick]
            bounds = np.concatenate([[0], np.cumsum(size_of)])
            take = np.arange(bounds[-1]) + np.repeat(rows.bounds[pick] - bounds[:-1], size_of)
            part = Sparse(bounds, rows.index[take], rows.value[take])
            raw, sums, scaled = _raw(linear, factors, part)
            error = (1 / (1 + np.exp(-np.clip(raw + bias, -40, 40))) - labels[pick]) / len(pick)
            by_entry = np.repeat(error, size_of).astype(np.float32) * part.value
            ids, where = np.unique(part.index, return_inverse=True)
            grad = np.bincount(where, by_entry, len(ids)) + decay[ids] * linear[ids] / len(pick)
            pairwise = by_entry[:, None] * (np.repeat(sums, size_of, 0) - scaled)
            grads = np.stack([np.bincount(where, pairwise[:, f], len(ids)) for f in range(FACTORS)], 1)
            grads += decay[ids, None] * factors[ids] / len(pick)
            seen_linear[ids] += grad**2
            linear[ids] -= RATE * grad / np.sqrt(seen_linear[ids])
            seen_factors[ids] += grads**2
            factors[ids] -= RATE * grads / np.sqrt(seen_factors[ids])
            seen_bias += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(seen_bias)
    return Machine(float(bias), linear, factors, shift)


def _matrix(columns: list[pa.Array], n: int) -> np.ndarray:
    if not columns:
        return np.empty((n, 0))
    return np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1)


def _feature_batches(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Sparse vectors as two binary fields."""
    for text, *meta in parts:
        out, matrix = [], _matrix(meta, len(text))
        for first, piece in chunks(texts_of(text)):
            rows = features(piece, matrix[first : first + len(piece)])
            for i in range(len(piece)):
                a, b = rows.bounds[i], rows.bounds[i + 1]
                out.append({"index": rows.index[a:b].tobytes(), "value": rows.value[a:b].tobytes()})
        yield pa.array(out, pa.struct([("index", pa.binary()), ("value", pa.binary())]))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        meta: tuple[str, ...] = ()) -> Machine | float:
    """A model of ``label`` (1: good), or the share of good rows where a label is missing."""
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("_y"))
    marked = marked.withColumn("_y", (F.col("_y") >= 1).cast("int")).join(docs.select(key).distinct(), key, "left_semi")
    sizes = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}  # at most two rows
    if len(sizes) < 2:
        return float(next(iter(sizes), 0.5))
    rates = {y: min(1.0, ROWS_PER_LABEL / n) for y, n in sizes.items()}
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    drawn = marked.withColumn("_draw", draw).filter(
        F.col("_draw") < F.when(F.col("_y") == 1, rates[1]).otherwise(rates[0])
    ).orderBy("_draw", key).limit(3 * ROWS_PER_LABEL)
    rows = docs.join(F.broadcast(drawn), key).select(
        "_y", "_draw", F.xxhash64(text).alias("_tie"),
        F.arrow_udf(_feature_batches, "index binary, value binary")(F.col(text), *[F.col(m).cast("double") for m in meta]).alias("_x"),
    ).orderBy("_draw", "_tie").limit(4 * ROWS_PER_LABEL)
    total = F.sum(F.octet_length("_x.index") / 4).over(Window.orderBy("_draw", "_tie"))
    kept = collect_bounded(rows.withColumn("_total", total).filter(F.col("_total") <= MAX_ENTRIES), 4 * ROWS_PER_LABEL, "rows")
    index = [np.frombuffer(r["_x"]["index"], np.int32) for r in kept]
    bounds = np.concatenate([[0], np.cumsum([len(i) for i in index])])
    value = np.concatenate([np.frombuffer(r["_x"]["value"], np.float32) for r in kept])
    shift = np.log(rates[0] / rates[1])
    return train(Sparse(bounds, np.concatenate(index), value), np.array([r["_y"] for r in kept], float), len(meta), float(shift))


def score(df: DataFrame, model: Machine | float, text: str = "text", meta: tuple[str, ...] = ()) -> DataFrame:
    """The input with ``score`` (0 to 1) and ``predicted`` (1 where the score reaches the threshold)."""
    small_batches(df.sparkSession)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("score", "predicted")]
    return df.select(*kept, _scored(model, F.col(f"`{text}`"), [F.col(f"`{m}`").cast("double") for m in meta]).alias("score")).select(
        "*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(df: DataFrame, model: Machine | float, text: str = "text", meta: tuple[str, ...] = ()) -> DataFrame:
    """The rows whose score reaches the threshold; all of them if a label was missing, so nothing was learned."""
    if isinstance(model, float):
        return df
    small_batches(df.sparkSession)
    return df.filter(_scored(model, F.col(f"`{text}`"), [F.col(f"`{m}`").cast("double") for m in meta]) >= THRESHOLD)


def _scored(model: Machine | float, text: Column, meta: list[Column]) -> Column:
    if isinstance(model, float):
        return F.lit(model)
    shared = share(model)

    def run(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        machine = shared.value
        for part_text, *columns in parts:
            matrix = _matrix(columns, len(part_text))
            found = [
                machine.scores(features(piece, matrix[first : first + len(piece)]))
                for first, piece in chunks(texts_of(part_text))
            ]
            yield pa.array(np.concatenate(found) if found else np.empty(0), pa.float64())

    def run_alone(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run((p,) for p in parts)

    return F.arrow_udf(run if meta else run_alone, "double")(text, *meta)
