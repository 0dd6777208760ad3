"""Document vectors: signed feature hashing by default, or any Arrow function."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.functions.arrays import from_matrix
from logvane.functions.text import clean_tokens

DIMENSIONS = 64


def hashed_slots(tokens: Column, dimensions: int = DIMENSIONS) -> Column:
    """Per token a signed slot: ``slot + 1``, negative for half of the tokens.

    MD5 rather than an engine's own hash, so any tool can recompute a vector.
    """

    numbers = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 9), 16, 10).cast("bigint"))

    def slot(number):
        place = F.floor(number / 16) % dimensions + 1
        return F.when(number % 16 < 8, place).otherwise(-place).cast("int")

    return F.transform(numbers, slot)


def _signed_slot(token: str, dimensions: int) -> int:
    """``hashed_slots`` of one token."""
    number = int(hashlib.md5(token.encode()).hexdigest()[:9], 16)
    place = number // 16 % dimensions + 1
    return place if number % 16 < 8 else -place


def hashed_vector(tokens: Column, dimensions: int = DIMENSIONS) -> Column:
    """Unit vector of signed token counts; all zero for a document without tokens."""

    @F.arrow_udf("array<double>")
    def collect(words: pa.Array) -> pa.Array:
        rows = len(words)
        lengths = np.diff(words.offsets.to_numpy())
        # a batch repeats its words: each distinct one is hashed once
        coded = words.flatten().dictionary_encode()
        slots = np.array([_signed_slot(word, dimensions) for word in coded.dictionary.to_pylist()], dtype=np.int64)
        signed = slots[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, dtype=np.int64)
        row = np.repeat(np.arange(rows), lengths)
        matrix = np.bincount(
            row * dimensions + np.abs(signed) - 1, weights=np.sign(signed), minlength=rows * dimensions
        ).reshape(rows, dimensions)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return from_matrix(matrix / np.where(norms > 0, norms, 1.0))

    return collect(tokens)


def embed(
    df: DataFrame, text_col: str, name: str = "embedding", embedder: Callable[[Column], Column] | None = None,
    dimensions: int = DIMENSIONS, tokens: str | None = None,
) -> DataFrame:
    """Add a vector per document; ``embedder`` maps the text column to an array<double> column.

    ``tokens`` names a column that holds the text's clean words already, so that they are not made twice.
    """
    words = F.col(tokens) if tokens else clean_tokens(F.col(text_col))
    vector = embedder(F.col(text_col)) if embedder else hashed_vector(words, dimensions)
    return df.withColumn(name, vector)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long arrays; 0 where one is all zero."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0)), F.lit(0.0))
