"""Large rule tables: every rule filed under the rarest piece of its text, events looked up by their pieces."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.operators.rules import RULE_FIELDS
from logvane.session import collect_bounded, free_name, materialize, merged_if_large

#: characters of the shortest piece a rule is filed under; shorter rules are filed under their whole text
PIECE = 4
#: lengths of pieces: with short ones alone, as many rules as events would share the pieces, and candidates grow as their product
PIECES = (PIECE, 16)
#: sums in which longer pieces are counted
SLOTS = 1 << 20
#: bits of the map of filed pieces
BITS = 1 << 26
INDEX_SCHEMA = "event_id long, field string, piece string, text string, rule_ids array<int>"


def _pieces(text: Column, size: int) -> Column:
    """All distinct pieces of ``size`` characters; the empty text is the piece of size 0."""
    if size == 0:
        return F.array(F.lit(""))
    places = F.sequence(F.lit(1), F.length(text) - (size - 1))
    cut = F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size))))
    return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))


def field_values(events: DataFrame, fields: list[str]) -> DataFrame:
    """``event_id, field, value``: each distinct lower-cased value of the fields once, null as ''.

    A value on a third of all events is one row here, combined before the shuffle.
    """
    values = F.array(*[
        F.struct(F.lit(name).alias("field"), F.lower(F.coalesce(F.col(name), F.lit(""))).alias("value")) for name in fields
    ])
    return events.select(F.col("event_id").cast("long").alias("event_id"), F.inline(values)).distinct()


def _lists() -> list[Column]:
    return [F.collect_list("rule_id").alias("rule_ids")]


def _totals() -> list[Column]:
    rule = F.col("rule_id").cast("long")
    return [F.count(rule).alias("n_rules"), F.min(rule).alias("first_rule"), F.sum(rule).alias("rule_sum")]


def index_rules(
    rules: DataFrame, events: DataFrame, fields: list[str] = RULE_FIELDS, sizes: tuple[int, ...] = PIECES, totals: bool = False
) -> DataFrame:
    """``event_id, field, piece, text, rule_ids``: where each rule of a rule table is looked up.

    A text is filed under a piece of the longest of ``sizes`` that it has, or whole where it is shorter than all: the piece
    in the fewest distinct values of ``events`` (ties: the smaller piece). Whatever events are matched later, a value
    containing the text also contains the piece, so an index can be stored and used again. Pieces of up to ``PIECE``
    characters are counted exactly, longer ones by hash in ``SLOTS`` sums; only the choice depends on them.
    Rules alike in all but their id share a row; with ``totals`` it holds ``n_rules, first_rule, rule_sum`` and no list.
    Rules without an event id name whole base names and have no piece; rules without text or field match nothing and are
    left out.
    """
    ids = _totals() if totals else _lists()
    known = rules.filter(F.col("substring").isNotNull() & F.col("field").isNotNull())
    named = names_only(rules).groupBy(F.col("substring").alias("text")).agg(*ids)
    named = named.select(F.lit(None).cast("long").alias("event_id"), F.lit("image_base").alias("field"),
                         F.lit(None).cast("string").alias("piece"), "*")
    texts = (
        known.filter(F.col("event_id").isNotNull() & F.col("field").isin(fields))
        .groupBy(F.col("event_id").cast("long").alias("event_id"), "field", F.lower("substring").alias("text"))
        .agg(*ids)
    )
    texts = materialize(texts, "rule_texts")
    filed = _filed(texts, field_values(events, fields), sizes).select(*named.columns)
    return materialize(filed.unionByName(named), "rule_index")


def _filed(texts: DataFrame, values: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """The texts with the piece that each is filed under."""
    own = F.when(F.length("text") < min(sizes), F.array("text"))
    for size in sorted(sizes):
        own = F.when(F.length("text") >= size, _pieces(F.col("text"), size)).otherwise(own)
    pieces = texts.withColumn("piece", F.explode(own))
    used = _sizes(pieces)
    # a short piece has a slot of its own
    short = _short_counts(values, [size for size in used if size <= PIECE]).select(_slot().alias("slot"), "n")
    long = _probes(values, [size for size in used if size > PIECE]).groupBy(_slot().alias("slot")).agg(F.count("*").alias("n"))
    counts = short.unionByName(long)
    # combined before the shuffle: the pieces of a text lie in one task
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece"))["piece"].alias("piece")
    key = ["event_id", "field", "text"]
    chosen = pieces.select(*key, "piece", _slot().alias("slot")).join(counts, "slot", "left").groupBy(*key).agg(rarest)
    return merged_if_large(texts).join(chosen, key)


def _key(text: str) -> Column:
    return F.xxhash64("event_id", "field", text)


def _slot() -> Column:
    """Where a piece is counted: short ones by themselves, longer ones with others of their hash."""
    return F.when(F.length("piece") <= PIECE, _key("piece")).otherwise(F.pmod(_key("piece"), F.lit(SLOTS)))


def names_only(rules: DataFrame) -> DataFrame:
    """The rules that compare base names whole."""
    return rules.filter(F.col("event_id").isNull() & F.col("substring").isNotNull())


def _sizes(pieces: DataFrame) -> list[int]:
    """The lengths of pieces in use: whole texts below the shortest length, and the lengths."""
    rows = collect_bounded(pieces.select(F.length("piece").alias("size")).distinct(), PIECE + len(PIECES), "sizes of pieces")
    return sorted(row["size"] for row in rows)


def _probes(values: DataFrame, sizes: list[int]) -> DataFrame:
    """A row per value and distinct piece of it."""
    if not sizes:
        return values.withColumn("piece", F.lit(None).cast("string")).filter(F.lit(False))
    return values.withColumn("piece", F.explode(F.concat(*[_pieces(F.col("value"), size) for size in sizes])))


#: characters compared at once, and distinct pieces that a task holds before it passes them on
CHARS_TOGETHER, PIECES_HELD = 1_000_000, 1_000_000


def _counted_pieces(values: list[str], group: np.ndarray, size: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Group, piece and number of the values with that piece, every value once."""
    lengths = np.array([len(v) for v in values])
    codes = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, letter = np.unique(codes, return_inverse=True)
    bits, row_bits = max(1, len(letters).bit_length()), max(len(values).bit_length(), int(group.max()).bit_length() + 1)
    if not size or bits * size + row_bits > 62 or (len(letters) and letters[0] == 0):
        found = Counter((g, v[i : i + size]) for g, v in zip(group.tolist(), values) for i in {v[j : j + size]: j for j in range(len(v) - size + 1)}.values())
        return np.array([g for g, _ in found], np.int64), [piece for _, piece in found], np.array([*found.values()], np.int64)
    ends, row = np.cumsum(lengths), np.repeat(np.arange(len(values)), lengths)
    start = np.flatnonzero(np.arange(len(codes)) + size <= ends[row])
    key = np.zeros(len(start), np.int64)
    for j in range(size):
        key = key << bits | letter[start + j]
    once = np.sort(row[start] << bits * size | key)
    once = once[np.flatnonzero(np.r_[len(once) > 0, once[1:] != once[:-1]])]
    mask = (1 << bits * size) - 1
    found, n = np.unique(group[once >> bits * size] << bits * size | once & mask, return_counts=True)
    spelt = letters[np.stack([found >> bits * (size - 1 - j) & (1 << bits) - 1 for j in range(size)], axis=1)]
    return found >> bits * size, np.ascontiguousarray(spelt, "<u4").view(f"<U{size}").ravel().tolist(), n


def _short_counts(values: DataFrame, sizes: list[int]) -> DataFrame:
    """``event_id, field, piece, n``: in how many of the distinct values each piece of some short lengths is.

    A task counts the pieces of many values by the numbers of their characters before any piece is a row.
    """
    def fold(parts: list[pa.Table]) -> pa.Table:
        counts = pa.concat_tables(parts).group_by(["event_id", "field", "piece"], use_threads=False).aggregate([("n", "sum")])
        return counts.rename_columns({"n_sum": "n"}).select(["event_id", "field", "piece", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            texts = batch.column("value").to_pylist()
            ids, fields = (batch.column(name).dictionary_encode("encode") for name in ("event_id", "field"))
            width = max(len(fields.dictionary), 1)
            group = ids.indices.to_numpy().astype(np.int64) * width + fields.indices.to_numpy()
            ends, start = np.cumsum([len(t) for t in texts]), 0
            while start < len(texts):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHARS_TOGETHER, "right")))
                for size in sizes:
                    g, piece, n = _counted_pieces(texts[start:stop], group[start:stop], size)
                    of_id, of_field = np.divmod(g, width)
                    held.append(pa.table({
                        "event_id": ids.dictionary.take(pa.array(of_id)), "field": fields.dictionary.take(pa.array(of_field)),
                        "piece": pa.array(piece, pa.string()), "n": n}))
                    waiting += len(n)
                start = stop
            if waiting > 2 * PIECES_HELD:
                held = [fold(held)]
                waiting = len(held[0])
                if waiting > PIECES_HELD:
                    yield from held.pop().combine_chunks().to_batches(max_chunksize=50_000)
                    waiting = 0
        if held:
            yield from fold(held).combine_chunks().to_batches(max_chunksize=50_000)

    rows = values.select("event_id", "field", "value")
    counted = (rows if sizes else rows.filter(F.lit(False))).mapInArrow(count, "event_id long, field string, piece string, n long")
    return counted.groupBy("event_id", "field", "piece").agg(F.sum("n").alias("n"))


def candidates(values: DataFrame, index: DataFrame) -> DataFrame:
    """The rules filed under a piece of a value, each once, with the value.

    Pieces meet by their hashes; the join on event id, field and piece refuses equal hashes of unequal pieces.
    """
    filed = merged_if_large(index.filter(F.col("piece").isNotNull()))
    probes = _perhaps_filed(_probes(values, _sizes(filed)), filed)
    return probes.join(filed, ["event_id", "field", "piece"]).drop("piece")


def _perhaps_filed(probes: DataFrame, filed: DataFrame) -> DataFrame:
    """The probes whose bit is set in a bitmap of the filed pieces, so that few of a value's pieces are shuffled.

    The bitmap is sent to all tasks: at most ``BITS / 64`` rows, however many pieces are filed.
    """
    bit = F.pmod(_key("piece"), F.lit(BITS))
    place = F.col("bit").bitwiseAND(F.lit(63)).cast("int")
    word = F.shiftright("bit", 6).alias("word")
    words = filed.select(bit.alias("bit")).groupBy(word).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("bits"))
    met = probes.withColumn("bit", bit).withColumn("word", word).join(F.broadcast(words), "word")
    return met.filter(F.getbit("bits", place) == 1).drop("bit", "word", "bits")


def value_hits(values: DataFrame, index: DataFrame) -> DataFrame:
    """``event_id, field, value, rule_ids`` (or the totals) for the values that some rule matches."""
    found = candidates(values, index).filter(F.col("value").contains(F.col("text"))).drop("text")
    names = index.filter(F.col("piece").isNull()).drop("event_id", "piece").withColumnRenamed("text", "value")
    named = values.join(merged_if_large(names), ["field", "value"])
    both = found.unionByName(named)
    if "rule_ids" in index.columns:
        merged = [F.flatten(F.collect_list("rule_ids")).alias("rule_ids")]
    else:
        merged = [F.sum("n_rules").alias("n_rules"), F.min("first_rule").alias("first_rule"), F.sum("rule_sum").alias("rule_sum")]
    return both.groupBy("event_id", "field", "value").agg(*merged)


def match_indexed(events: DataFrame, index: DataFrame, fields: list[str] = RULE_FIELDS) -> DataFrame:
    """Add ``rule_ids`` as ``rules.match_rules`` does, for rule tables of any size; of an index of totals, number, smallest
    and sum of the ids in their place.

    Distinct values, not events, meet the rules, and only rules that share a piece with them; the hits go back to the
    events by one left join a field of the index, on tables that hold only values with hits. Spark broadcasts these where
    they have few rows and splits hot values otherwise. No row is multiplied. ``fields`` must be those of the index.
    Lists grow with every rule that an event matches; where rules are as many as events, totals do not.
    """
    values = materialize(field_values(events, fields), "rule_values")
    hits = materialize(value_hits(values, index), "rule_hits")
    kept = hits.columns[3:]
    used = {row["field"] for row in collect_bounded(index.select("field").distinct(), len(fields) + 1, "fields of the index")}
    matched, found = events, []
    for name in fields:
        if name not in used:
            continue
        of_event, of_value, *here = (free_name(events, f"{part}_{name}") for part in ("hit_event", "hit_value", *(f"hit_{k}" for k in kept)))
        side = hits.filter(F.col("field") == name).select(
            F.col("event_id").alias(of_event), F.col("value").alias(of_value), *[F.col(k).alias(h) for k, h in zip(kept, here)])
        same = F.col("event_id").cast("long").eqNullSafe(F.col(of_event)) & (
            F.lower(F.coalesce(F.col(name), F.lit(""))) == F.col(of_value))
        matched = matched.join(merged_if_large(side), same, "left").drop(of_event, of_value)
        found.append(here)
    merged = {name: _merged(name, list(parts)) for name, parts in zip(kept, zip(*found))} or {k: _merged(k, []) for k in kept}
    return matched.withColumns(merged).drop(*[name for here in found for name in here])


def _merged(kind: str, found: list[str]) -> Column:
    """What the fields of an event have found together."""
    if kind == "rule_ids":
        none = F.array().cast("array<int>")
        return F.array_sort(F.concat(none, *[F.coalesce(F.col(name), none) for name in found]))
    if kind == "first_rule":
        return F.array_min(F.array(*[F.col(name) for name in found]).cast("array<long>"))
    return reduce(Column.__add__, [F.coalesce(F.col(name), F.lit(0)) for name in found], F.lit(0).cast("long"))


def candidate_counts(events: DataFrame, index: DataFrame, fields: list[str] = RULE_FIELDS) -> DataFrame:
    """One row: rule texts, distinct values, pairs that a join on event id and field would test, pairs that the index
    gives, and pairs that match.

    Pairs that the index gives are counted by piece, not made; those that match are found by long pieces.
    """
    values = materialize(field_values(events, fields), "rule_values")
    filed = index.filter(F.col("piece").isNotNull())
    per_side = [side.groupBy("event_id", "field").agg(F.count("*").alias(name)) for side, name in ((filed, "n_texts"), (values, "n_values"))]
    all_pairs = per_side[0].join(per_side[1], ["event_id", "field"]).select(F.col("n_texts") * F.col("n_values"))
    piece = ["event_id", "field", "piece"]
    used = _sizes(filed)
    long = _probes(values, [size for size in used if size > PIECE]).groupBy(*piece).agg(F.count("*").alias("n"))
    per_value = _short_counts(values, [size for size in used if size <= PIECE]).unionByName(long)
    met = filed.groupBy(*piece).agg(F.count("*").alias("n_texts")).join(per_value.withColumnRenamed("n", "n_values"), piece).select((F.col("n_texts") * F.col("n_values")).alias("n"))
    refiled = materialize(_filed(filed.select("event_id", "field", "text"), values, PIECES), "rule_index")
    matches = candidates(values, refiled).filter(F.col("value").contains(F.col("text")))
    parts = [
        filed.agg(F.count("*").alias("n_texts")), values.agg(F.count("*").alias("n_values")), all_pairs.toDF("pairs").agg(F.sum("pairs").alias("n_pairs")),
        met.agg(F.sum("n").alias("n_candidates")), matches.agg(F.count("*").alias("n_matches")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # every count stands in one of the five rows
    return rows.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in rows.columns])
