"""Language identification by compression.

Every language has a raw-content dictionary made of snippets of its training
texts. A text's letters are encoded once with each dictionary; the one that leaves the
fewest bytes names the language. The margin to the second best decides whether
the answer is accepted.

Defined cases: a null text and a text without a letter give ``und`` with score
0, margin 0 and ``rejected``. Ties go to the language with more training texts,
then to the alphabetically first. A single trained language always wins with score 1. A table without
training rows gives ``und`` for every text. Very long texts are encoded whole.
Columns of the input that carry the name of a result column are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logvane.llm.text import small_batches
from logvane.session import collect_bounded

UNKNOWN = "und"
#: bounds of the fit: bytes of one dictionary, texts drawn per language, characters taken of a drawn text
DICTIONARY_BYTES = 112 << 10
TEXTS_PER_LANGUAGE = 600
SNIPPET_CHARS = 600
MAX_LANGUAGES = 256
#: error of the number of distinct texts of a language, far below what the share of the draw leaves room for
DISTINCT_ERROR = 0.05
LEVEL = 5
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: a text is rejected when the second best dictionary needs less than this many more bytes
NARROW_BYTES = 2
#: odds between two dictionaries per byte of difference, as a natural logarithm
NATS_PER_BYTE = 0.5


def fit(training: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries of all languages, the most frequent first, from a bounded draw of the training texts.

    The draw is by hash of the text: equal texts count once, and neither the
    order nor the partitions of the table matter. A first share, of about four
    times as many distinct texts as are wanted, keeps the rest from the shuffle.
    """
    rows = training.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        "lang is not null and text is not null"
    )
    key = F.xxhash64("text")
    found = collect_bounded(rows.groupBy("lang").agg(
        F.count("*").alias("n"), F.approx_count_distinct(key, DISTINCT_ERROR).alias("texts")
    ), MAX_LANGUAGES, "languages")
    if not found:
        return {}
    sizes = {r["lang"]: r["n"] for r in found}
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, 4 * TEXTS_PER_LANGUAGE / max(1, r["texts"])))])
    draw = F.pmod("key", F.lit(1 << 30)) / float(1 << 30)
    drawn = (
        rows.withColumn("key", key).withColumn("draw", draw)
        .filter(F.col("draw") < share[F.col("lang")])
        .select("lang", "draw", "key", F.expr(
            f"substring(text, cast(1 + draw * 997 % 1 * greatest(length(text) - {SNIPPET_CHARS}, 0) as int), {SNIPPET_CHARS})"
        ).alias("snippet"))
        .dropDuplicates(["lang", "key"])
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "key"))
    kept = drawn.withColumn("rank", rank).filter(F.col("rank") <= TEXTS_PER_LANGUAGE).drop("rank")
    parts: dict[str, list[str]] = {}
    for r in sorted(collect_bounded(kept, MAX_LANGUAGES * TEXTS_PER_LANGUAGE, "snippets"), key=lambda r: (r["lang"], r["draw"], r["key"])):
        parts.setdefault(r["lang"], []).append(r["snippet"])
    order = sorted(parts, key=lambda k: (-sizes[k], k))
    contents = {k: _letters("\n".join(parts[k]))[:DICTIONARY_BYTES] for k in order}
    return {k: v for k, v in contents.items() if v.strip()}


def _letters(text: str) -> bytes:
    """Lower-cased letters; whatever stands between them is one space."""
    return NOT_LETTERS.sub(" ", f" {text.lower()} ").encode()


class Encoders:
    """Compressors of one worker, one for each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.encoders = []
        for name in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(
                dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False, level=LEVEL
            ))

    def judge(self, text: str | None) -> tuple[str, float, int, bool]:
        """Language, score, margin in bytes and whether the margin is too narrow."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0, True
        raw = _letters(text)
        sizes = [len(e.compress(raw)) for e in self.encoders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        margin = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] + 1_000) - sizes[best]
        score = 1 / sum(math.exp(-NATS_PER_BYTE * min(s - sizes[best], 1_000)) for s in sizes)
        return self.langs[best], score, margin, margin < NARROW_BYTES


_RESULT = pa.struct([
    ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.int64()), ("rejected", pa.bool_()),
])


def judged(dictionaries: dict[str, bytes], text) -> F.Column:
    """A struct column ``lang_pred, score, margin, rejected`` for a text column."""

    @F.arrow_udf("lang_pred string, score double, margin long, rejected boolean")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoders = Encoders(dictionaries)
        for part in parts:
            rows = [encoders.judge(t) for t in part.to_pylist()]
            yield pa.array([dict(zip(("lang_pred", "score", "margin", "rejected"), r)) for r in rows], _RESULT)

    return run(text)


def identify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """The input with ``lang_pred, score, margin, rejected``."""
    small_batches(df.sparkSession)
    names = ("lang_pred", "score", "margin", "rejected")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*kept, judged(dictionaries, F.col(f"`{text}`")).alias("_judged")).select(
        *kept, *[F.col(f"_judged.{n}") for n in names]
    )
