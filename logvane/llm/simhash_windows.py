"""Benchmark decontamination by SimHash windows of item size, in DataFrame expressions only.

Texts and items are lower-cased words of letters and digits, taken as bags of
five-word shingles. A window has as many words as an item. Windows without any
shingle of an item have similarity 0, so windows are laid where a text holds
some item's shingle, each item's start lined up with its own. Equal windows are
judged once, however many texts share them.

A window's fingerprint has 128 bits. Two fingerprints at most ``RADIUS`` bits
apart agree up to ``RADIUS // BLOCKS`` bits on one of their blocks; items are
filed under all block values up to two bits away and windows look up all values
one bit away, so every item within the radius is found. Candidates are checked
by the exact weighted similarity: the weight of the shingles both hold over the
weight of all, a shingle in ``df`` of ``n`` items weighing ``ln(1 + n / df)``
and a window's shingle outside the item as much as one of a single item.

Defined cases: null and empty texts match nothing. An item of fewer than five
words has no shingle and matches nothing; null items neither. A text shorter
than an item is one window. Items that are equal all match. Rows that repeat
get the verdict of their text. An empty benchmark leaves every text clean.
Texts are searched whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.session import collect_bounded, fence, free_name, materialize

WORDS = 5
SIMILARITY = 0.8
#: at similarity 0.8 fingerprints are 19 bits apart on average, with a deviation of 4
RADIUS = 31
BLOCKS = 8
_BLOCK_BITS = 128 // BLOCKS
#: the gate of shingles: bits for each shingle of the benchmark, within fixed bounds, and probes
GATE_BITS_EACH, GATE_LEAST, GATE_MOST, PROBES = 128, 16, 22, 3
#: benchmark shingles up to this number are sent to every task; more are joined by a shuffle
BROADCAST_SHINGLES = 200_000
_SEPARATORS = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def shingled(df: DataFrame, text: str, kept: list[str]) -> DataFrame:
    """Columns ``kept`` and ``_s``: the hashes of all five-word shingles in order, empty below five words."""
    words = f"filter(split(lower(coalesce(`{text}`, '')), '{_SEPARATORS}', -1), w -> w <> '')"
    columns = [F.col(f"`{c}`") for c in kept]
    out = df.select(*columns, F.expr(f"transform({words}, w -> xxhash64(w))").alias("_k1"))
    # a shingle's hash is made of those of its parts; each array is walked once
    out = out.select("*", F.expr("zip_with(_k1, slice(_k1, 2, greatest(size(_k1), 1)), (a, b) -> xxhash64(a, b))").alias("_k2"))
    out = out.select("*", F.expr("zip_with(_k2, slice(_k2, 3, greatest(size(_k1), 1)), (a, b) -> xxhash64(a, b))").alias("_k4"))
    return out.select(*columns, F.expr(
        f"slice(zip_with(_k4, slice(_k1, {WORDS}, greatest(size(_k1), 1)), (a, b) -> xxhash64(a, b)), 1, greatest(size(_k1) - {WORDS - 1}, 0))"
    ).alias("_s"))


def _gate(shingles: DataFrame) -> tuple[str, int]:
    """An array of longs as SQL, with the bits of all shingles set, and the number of its bits' index."""
    count = shingles.count()
    bits = min(max(GATE_LEAST, (count * GATE_BITS_EACH).bit_length()), GATE_MOST)
    probes = ", ".join(_probe("_h", i, bits) for i in range(PROBES))
    places = shingles.select(F.explode(F.expr(f"array({probes})")).alias("p"))
    words = places.groupBy(F.expr("shiftright(p, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v"))
    table = [0] * (1 << (bits - 6))
    for r in collect_bounded(words, len(table), "gate words"):
        table[r["word"]] = r["v"]
    return f"cast(split('{','.join(map(str, table))}', ',') as array<bigint>)", bits


def _probe(h: str, i: int, bits: int) -> str:
    """The ``i``-th place of a shingle in the gate."""
    return f"(shiftright({h}, {20 * i}) & {(1 << bits) - 1}L)"


def fingerprints(s: str) -> str:
    """SQL for the two halves of the fingerprint of an array of shingle hashes: the majority of each bit."""
    half = lambda x: (
        f"aggregate(transform(sequence(0, 63), b -> if(2 * aggregate({s}, 0, (n, x) -> n + getbit({x}, b)) > size({s}), shiftleft(1L, b), 0L)),"
        " 0L, (a, v) -> a | v)"
    )
    return f"named_struct('f0', {half('x')}, 'f1', {half('xxhash64(x, 1)')})"


def _blocks(reach: int) -> str:
    """SQL for all ``(block, value)`` of a fingerprint ``_f`` with up to ``reach`` bits turned."""
    values = [
        f"named_struct('block', {i}, 'v', cast(shiftrightunsigned(_f.f{i * _BLOCK_BITS // 64}, {i * _BLOCK_BITS % 64}) & {(1 << _BLOCK_BITS) - 1}L as int))"
        for i in range(BLOCKS)
    ]
    turned = f"filter(sequence(0, {(1 << _BLOCK_BITS) - 1}), m -> bit_count(m) <= {reach})"
    return f"flatten(transform(array({', '.join(values)}), p -> transform({turned}, m -> named_struct('block', p.block, 'v', p.v ^ m))))"


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
            item_text: str = "text") -> DataFrame:
    """``key, text_key, item, similarity`` for every text and item it holds a window of; ``text_key`` is a hash of the text."""
    items = materialize(
        shingled(benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("text")), "text", ["item"])
        .filter("size(_s) > 0"), "benchmark_items",
    )
    total = max(1, items.count())
    places = items.select("item", F.expr(f"size(_s) + {WORDS - 1}").alias("words"), F.posexplode("_s").alias("at", "_h"))
    weights = places.groupBy("_h").agg(F.log1p(F.lit(total) / F.countDistinct("item")).alias("w"))
    gate, bits = _gate(weights.select("_h"))
    tests = " and ".join(f"getbit(_g[cast(shiftright({_probe('h', i, bits)}, 6) as int)], cast({_probe('h', i, bits)} & 63 as int)) = 1" for i in range(PROBES))
    tests = tests.replace("_g[", f"{gate}[")

    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"))
    gated = shingled(source, "text", ["key", "text_key"]).select(
        "*", F.expr(f"array_compact(transform(_s, (h, i) -> if({tests}, i, null)))").alias("_at")
    )
    # without the fence the filter would hold, and compute again, all steps from the text on
    held = materialize(fence(gated).filter("size(_at) > 0"), "benchmark_texts")
    lay = places.select("_h", "at", "words").distinct()
    lay = F.broadcast(lay) if lay.count() <= BROADCAST_SHINGLES else lay
    spots = held.select("key", "text_key", F.size("_s").alias("n"), F.explode(F.expr("transform(_at, i -> named_struct('i', i, 'h', _s[i]))")).alias("x"))
    laid = spots.select("key", "text_key", "n", F.col("x.i").alias("i"), F.col("x.h").alias("_h")).join(lay, "_h").select(
        "key", "text_key",
        # the window in shingles: its first one and their number, pushed inside the text
        F.expr(f"greatest(0, least(i - at, n - least(n, words - {WORDS - 1})))").alias("first"),
        F.expr(f"least(n, words - {WORDS - 1})").alias("length"),
    ).distinct()
    laid = laid.groupBy("key", "text_key").agg(F.collect_list(F.struct("first", "length")).alias("_windows"))
    same = [F.col("h.key").eqNullSafe(F.col("l.key")), F.col("h.text_key").eqNullSafe(F.col("l.text_key"))]
    cut = held.dropDuplicates(["key", "text_key"]).alias("h").join(laid.alias("l"), same).select(
        "h.key", "h.text_key", F.explode(F.expr("transform(_windows, x -> slice(_s, x.first + 1, x.length))")).alias("_s")
    )
    windows = materialize(cut.select("key", "text_key", F.xxhash64("_s").alias("window"), "_s"), "benchmark_windows")

    distinct = materialize(
        windows.groupBy("window").agg(F.first("_s").alias("_s")).select("window", "_s", F.expr(fingerprints("_s")).alias("_f")), "benchmark_distinct"
    )
    weighted = places.join(weights, "_h").groupBy("item").agg(
        F.collect_set(F.struct(F.col("_h").alias("h"), "w")).alias("_weights")
    )
    filed = materialize(items.select("item", F.expr(fingerprints("_s")).alias("_f")), "benchmark_fingerprints")
    near = RADIUS // BLOCKS
    index = filed.select("item", "_f", F.inline(F.expr(_blocks(near - 1))))
    looked = distinct.select("window", F.col("_f").alias("_wf"), "_f", F.inline(F.expr(_blocks(1)))).drop("_f")
    pairs = looked.join(index, ["block", "v"]).filter(
        f"bit_count(_wf.f0 ^ _f.f0) + bit_count(_wf.f1 ^ _f.f1) <= {RADIUS}"
    ).select("window", "item").distinct()
    shared = "filter(_weights, x -> array_contains(_s, x.h))"
    add = lambda a: f"aggregate({a}, 0D, (n, x) -> n + x.w)"
    outside = f"(size(array_distinct(_s)) - size({shared})) * ln(1D + {total})"
    verified = pairs.join(distinct.select("window", "_s"), "window").join(weighted, "item").select(
        "window", "item", F.expr(f"{add(shared)} / ({add('_weights')} + {outside})").alias("similarity")
    ).filter(F.col("similarity") >= SIMILARITY)
    return windows.select("key", "text_key", "window").join(materialize(verified, "benchmark_verified"), "window").groupBy(
        "key", "text_key", "item"
    ).agg(F.max("similarity").alias("similarity")).select(
        F.col("key").alias(key), "text_key", F.col("item").alias(item), "similarity"
    )


def verdicts(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """One row per row of ``docs``: ``key, contaminated, n_items, best_similarity, items``."""
    found = matches(docs, benchmark, key, text, item).groupBy(key, "text_key").agg(
        F.count("*").alias("n_items"), F.max("similarity").alias("best_similarity"),
        F.array_join(F.array_sort(F.collect_list(item)), ",").alias("items"),
    )
    rows = docs.select(F.col(f"`{key}`").alias(key), F.xxhash64(F.col(f"`{text}`")).alias("text_key"))
    same = [F.col(f"d.{key}").eqNullSafe(F.col(f"f.{key}")), F.col("d.text_key") == F.col("f.text_key")]
    return rows.alias("d").join(found.alias("f"), same, "left").select(
        f"d.{key}", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("best_similarity", F.lit(0.0)).alias("best_similarity"), F.coalesce("items", F.lit("")).alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with all their columns."""
    own, hashed = free_name(docs, "hit_key"), free_name(docs, "hit_text_key")
    found = materialize(matches(docs, benchmark, key, text).select(F.col(key).alias(own), F.col("text_key").alias(hashed)).distinct(), "benchmark_hits")
    same = [F.col(f"`{key}`").eqNullSafe(F.col(own)), F.xxhash64(F.col(f"`{text}`")) == F.col(hashed)]
    return docs.join(found, same, "left_anti")
