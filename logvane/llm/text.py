"""Numpy views of Arrow text columns: the words, word hashes and shingles of many texts at once.

Texts are taken as UTF-8 bytes. A null text counts as empty. All word rules
here split on ASCII bytes only, so a multi-byte character never breaks.
Hashes are 64 bits wide and depend on nothing but the bytes of the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

ROWS_PER_BATCH = 256
BYTES_PER_BATCH = 16 << 20
CHUNK_BYTES = 1 << 20

# space, tab, line feed, vertical tab, form feed, carriage return
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
# bytes that belong to no letter or digit word: every ASCII byte but 0-9 and a-z (texts are lower-cased first)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[:0x80] = True
SYMBOLS[0x30:0x3A] = SYMBOLS[0x61:0x7B] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_STEP = 0x9E3779B97F4A7C15 | 1
_BYTE_KEYS = np.random.default_rng(20_240).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM_KEYS = np.random.default_rng(20_241).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: a batch of long texts must fit into a worker many times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def unused(columns: list[str], name: str) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(keys: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    keys = keys ^ (keys >> np.uint64(31))
    keys = keys * np.uint64(0xBF58476D1CE4E5B9)
    keys = keys ^ (keys >> np.uint64(27))
    keys = keys * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the step and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < size:
        size = max(size, CHUNK_BYTES + 1)
        inverse = pow(_STEP, -1, 1 << 64)
        for name, base in (("up", _STEP), ("down", inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Texts:
    """Some consecutive texts: their bytes, and where each begins and ends."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts_of(column: pa.Array) -> Texts:
    """The bytes of a string column without copying them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def chunks(texts: Texts, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, Texts]]:
    """Runs of whole texts of about ``limit`` bytes, with the number of the first; a longer text stands alone."""
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(texts.offsets, texts.offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        begin, end = texts.offsets[first], texts.offsets[last]
        yield first, Texts(texts.data[begin:end], texts.offsets[first : last + 1] - begin)
        first = last


@dataclass
class Words:
    """Words of some texts in order: byte range, number of the text, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


def words_of(texts: Texts, separators: np.ndarray = SPACES) -> Words:
    inside = ~separators[texts.data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = texts.offsets[(texts.offsets > 0) & (texts.offsets < len(inside))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, texts.offsets)
    return Words(starts, ends, np.repeat(np.arange(len(texts)), np.diff(bounds)), bounds)


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """One 64-bit hash per word, from sums of byte keys times powers of an odd step."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[data] * up[: len(data)], out=sums[1:])
    keys = (sums[words.ends] - sums[words.starts]) * down[words.starts]
    return mix(keys + (words.ends - words.starts).astype(np.uint64))


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte keys times powers of the step up to every place, from which any range is hashed."""
    up, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[data] * up[: len(data)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every range, the same wherever they stand."""
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text, and the number of the text of each."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys = hashes[:count] * _GRAM_KEYS[0]
    for j in range(1, size):
        keys = keys + hashes[j : j + count] * _GRAM_KEYS[j]
    whole = words.text[:count] == words.text[size - 1 :]
    return mix(keys[whole]), words.text[:count][whole]


def distinct_pairs(text: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, key) pairs, sorted, with the number of times each occurs."""
    if not len(keys):
        return text, keys, np.empty(0, np.int64)
    order = np.lexsort((keys, text))
    text, keys = text[order], keys[order]
    fresh = np.empty(len(keys), bool)
    fresh[0] = True
    np.logical_or(text[1:] != text[:-1], keys[1:] != keys[:-1], out=fresh[1:])
    at = np.flatnonzero(fresh)
    return text[at], keys[at], np.diff(np.append(at, len(keys)))


def lowered(texts: Texts) -> Texts:
    """A-Z as a-z; every other byte stays."""
    return Texts(LOWER[texts.data], texts.offsets)
