"""Removal of repeated passages by prefix-free parsing and suffix arrays.

A passage is ``length`` consecutive bytes of one text. Its trigger is the
``width`` bytes inside it with the least rolling hash, so equal passages have
equal triggers at equal places. Passages of a text that share a trigger follow
one another; together they are a phrase, and a text is parsed into phrases.
Distinct phrases are the dictionary, their places in document order the parse.

Every passage lies inside one phrase. The dictionary's suffix array, sorted to
``length`` bytes, brings equal passages together; each entry of the parse
stands for all passages of its phrase, in document order. Both give the
corpus's suffixes in order, equal ones by position: all but the first of each
run are repeats. The parse alone decides later places of a phrase, whose
passages are all repeats. Suffixes are sorted only for phrases with a trigger
that other phrases share too, so the work after the parse grows with what is
repeated and not with the corpus.

A phrase that a text repeats is one row with its later places. Triggers that
occur once are dropped by counts with partial sums. A suffix array is sorted by
the task that holds a trigger's phrases; a trigger in more than ``SPLIT``
phrases is dealt out by phrase, and the firsts of its parts, by now at most one
of a kind and part, meet by digest, dealt out again. Texts travel twice, by document: to fetch the phrases
to be sorted, and to take the repeats out.

Defined cases: a null text counts as empty. A text shorter than a passage keeps
all. Documents are ordered by key (null first), those with equal keys by a hash
of the text; rows that repeat both key and text are one document, and all give
its result. Overlapping repeats are removed as one run, and passages are judged
on the input. Long texts are parsed in overlapping slices. Columns of the input
that are named like results are replaced; an empty table gives no rows.
Triggers and phrases are compared by 64-bit hashes each, passages by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.llm.text import CHUNK_BYTES, Texts, byte_sums, chunks, range_hashes, small_batches, texts_of
from logvane.session import materialize

LENGTH, WIDTH = 100, 32
#: distinct phrases of a trigger that one task sorts, and phrases sorted at once
SPLIT, TOGETHER = 20_000, 6_000
RESULT = ["n_bytes", "n_removed", "n_spans", "kept"]


# ---- parsing


def _least(keys: np.ndarray, size: int) -> np.ndarray:
    """The minimum of every ``size`` consecutive keys, by doubling."""
    reach = 1
    while 2 * reach <= size:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    return np.minimum(keys[: len(keys) - (size - reach)], keys[size - reach :]) if size > reach else keys


def _phrases(texts: Texts, length: int, width: int, whole: bool) -> tuple[np.ndarray, ...]:
    """Text number, place, passages, trigger hash and, if ``whole``, phrase hash of every phrase of some texts."""
    size = len(texts.data)
    if size < length:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    sums = byte_sums(texts.data)
    at = np.arange(size - width + 1)
    hashes = range_hashes(sums, at, at + width)
    # 32 bits of the hash, then the place: of equal hashes the first counts
    order = (hashes >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    trigger = (_least(order, length - width + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    passages = np.flatnonzero(owner[: size - length + 1] == owner[length - 1 :])
    trigger = trigger[passages]
    heads = np.flatnonzero(np.diff(trigger, prepend=-1) != 0)
    start, n = passages[heads], np.diff(np.append(heads, len(passages)))
    key = range_hashes(sums, start, start + n + (length - 1)) if whole else start
    number = owner[start]
    return number, start - texts.offsets[number], n, hashes[trigger[heads]].view(np.int64), key.view(np.int64)


def parse(texts: Texts, length: int = LENGTH, width: int = WIDTH, whole: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """Phrases of texts, about a megabyte at a time; longer texts in slices that overlap by a passage less a byte."""
    for first, some in chunks(texts):
        if len(some.data) <= CHUNK_BYTES or len(some) > 1:
            number, *rest = _phrases(some, length, width, whole)
            yield first + number, *rest
            continue
        for a in range(0, len(some.data) - length + 1, CHUNK_BYTES):
            piece = some.data[a : a + CHUNK_BYTES + length - 1]
            number, start, *rest = _phrases(Texts(piece, np.array([0, len(piece)])), length, width, whole)
            yield first + number, start + a, *rest


# ---- suffix array of the dictionary


def suffix_array(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``starts``, to ``length`` bytes, and which equal the one before; ties keep their order."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, bool)
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    places = [*range(0, length - 8, 8), length - 8]
    words = [np.ascontiguousarray(eight[starts + p]).view(">u8")[:, 0].astype(np.uint64) for p in places]
    order = np.lexsort(words[::-1])
    same = np.ones(len(order), bool)
    same[0] = False
    for w in words:
        w = w[order]
        same[1:] &= w[1:] == w[:-1]
    return order, same


def repeats(phrases: list[bytes], places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrase and offset of every passage, whether it is a repeat, and whether it is the first of its kind.

    Phrases come in document order; equal ``places`` are one place listed twice.
    """
    sizes = np.array([len(p) for p in phrases])
    n = sizes - length + 1
    owner = np.repeat(np.arange(len(phrases)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = (np.cumsum(sizes) - sizes)[owner] + offset
    order, same = suffix_array(np.frombuffer(b"".join(phrases), np.uint8), starts, length)
    heads = np.flatnonzero(~same)
    first = np.repeat(order[heads], np.diff(np.append(heads, len(order))))
    repeat = np.empty(len(order), bool)
    repeat[order] = (places[owner[first]] != places[owner[order]]) | (offset[first] != offset[order])
    lead = np.zeros(len(order), bool)
    lead[order[heads]] = True
    return owner, offset, repeat, lead


# ---- jobs

_RUN = pa.struct([("start", pa.int64()), ("n", pa.int64())])
_PARSE = pa.schema([("trigger", pa.int64()), ("phrase", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("n", pa.int64()),
                    ("again", pa.list_(_RUN))])
_TRIGGERS = pa.schema([("trigger", pa.int64()), ("times", pa.int64())])
_FETCHED = pa.schema([("trigger", pa.int64()), ("part", pa.int64()), ("parts", pa.int64()), ("doc", pa.int64()), ("key", pa.int64()),
                      ("start", pa.int64()), ("bytes", pa.binary())])
#: runs of repeats; and, of triggers in several parts, firsts as packed digests and places
_FOUND = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("trigger", pa.int64()), ("bucket", pa.int64()),
                    ("firsts", pa.binary())])
_FIRST = np.dtype([("digest", "S16"), ("offset", "<i8")])


def _sql(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.list_(_RUN): "array<struct<start:long,n:long>>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _runs(at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads and sizes of runs of consecutive places of one owner."""
    breaks = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0))
    return breaks, np.diff(np.append(breaks, len(at)))


def _once(number: np.ndarray, start: np.ndarray, n: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The first place of each phrase of each text, and its later places in that text, adjoining ones as one run."""
    order = np.lexsort((start, phrase, number))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (phrase[order][1:] != phrase[order][:-1]) | (number[order][1:] != number[order][:-1])
    group = np.cumsum(fresh) - 1
    later = np.flatnonzero(~fresh)
    begin, size, group_of = start[order][later], n[order][later], group[later]
    joined = np.ones(len(later), bool)
    joined[1:] = (group_of[1:] != group_of[:-1]) | (begin[1:] != begin[:-1] + size[:-1])
    heads = np.flatnonzero(joined)
    sizes = np.add.reduceat(size, heads) if len(heads) else size
    counts = np.bincount(group_of[heads], minlength=int(fresh.sum()))
    runs = pa.StructArray.from_arrays([pa.array(begin[heads]), pa.array(sizes)], fields=list(_RUN))
    offsets = pa.array(np.append([0], np.cumsum(counts)).astype(np.int32))
    return order[fresh], pa.ListArray.from_arrays(offsets, runs, mask=pa.array(counts == 0))


def _parsed(docs: DataFrame, length: int, width: int, whole: bool) -> DataFrame:
    """The parse of all documents, or its triggers alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, start, n, trigger, phrase in parse(texts_of(batch.column("text")), length, width, whole):
                if whole:
                    kept, again = _once(number, start, n, phrase)
                    doc, key = (batch.column(c).take(pa.array(number[kept])) for c in ("doc", "key"))
                    columns = [pa.array(c[kept]) for c in (trigger, phrase, start, n)]
                    yield pa.RecordBatch.from_arrays([*columns[:2], doc, key, *columns[2:], again], schema=_PARSE)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(trigger, return_counts=True)], schema=_TRIGGERS)

    rows = docs if whole else docs.select("text")
    return rows.mapInArrow(run, _sql(_PARSE if whole else _TRIGGERS))


def _fetched(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of phrases, read from their documents."""
    by_doc = wanted.groupBy("doc", "key").agg(F.collect_list(F.struct("trigger", "part", "parts", "start", "n")).alias("wanted"))
    w = by_doc.select(F.col("doc").alias("w_doc"), F.col("key").alias("w_key"), "wanted")
    both = w.join(docs, F.col("w_doc").eqNullSafe(F.col("doc")) & (F.col("w_key") == F.col("key"))).select("doc", "key", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = texts_of(batch.column("text")), batch.column("wanted")
            items, owner = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            start, n = items.field("start").to_numpy(), items.field("n").to_numpy()
            at = texts.offsets[owner] + start
            raw = texts.data.data
            parts = [bytes(raw[a : a + m + length - 1]) for a, m in zip(at.tolist(), n.tolist())]
            doc, key = (batch.column(c).take(pa.array(owner)) for c in ("doc", "key"))
            yield pa.RecordBatch.from_arrays(
                [items.field("trigger"), items.field("part"), items.field("parts"), doc, key, items.field("start"), pa.array(parts, pa.binary())],
                schema=_FETCHED,
            )

    return both.mapInArrow(run, _sql(_FETCHED))


def _in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows in document order, null documents first, and a number of each place."""
    table = table.append_column("known", pa.array(table["doc"].is_valid().to_numpy().astype(np.int8)))
    table = table.sort_by([(c, "ascending") for c in ("known", "doc", "key", "start")])
    where = np.stack([table["doc"].fill_null(0).to_numpy(), *(table[c].to_numpy() for c in ("known", "key", "start"))], 1)
    return table, np.cumsum(np.append([False], (where[1:] != where[:-1]).any(1)))


def _found(table: pa.Table, rows: np.ndarray, offset: np.ndarray, n: np.ndarray, **more: pa.Array) -> pa.RecordBatch:
    """A batch of results about some rows."""
    taken = table.select(["doc", "key", "start", "trigger"]).take(pa.array(rows)).combine_chunks().to_batches()
    if not taken:
        return pa.RecordBatch.from_pylist([], _FOUND)
    doc, key, start, trigger = taken[0].columns
    filled = {"doc": doc, "key": key, "start": pa.array(start.to_numpy() + offset), "n": pa.array(n), "trigger": trigger, **more}
    return pa.RecordBatch.from_arrays([filled.get(f.name, pa.nulls(len(rows), f.type)) for f in _FOUND], schema=_FOUND)


def _judged(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Runs of repeats of some whole triggers, and the firsts of those that have other parts."""
    table, place = _in_order(table)
    phrases = table["bytes"].to_pylist()
    owner, offset, repeat, lead = repeats(phrases, place, length)
    at = np.flatnonzero(repeat)
    heads, sizes = _runs(at, owner[at])
    yield _found(table, owner[at][heads], offset[at][heads], sizes)

    parts = table["parts"].to_numpy()
    leads = np.flatnonzero(lead & (parts[owner] > 1))
    if len(leads):
        packed = np.empty(len(leads), _FIRST)
        packed["digest"] = [hashlib.blake2b(phrases[owner[i]][offset[i] : offset[i] + length], digest_size=16).digest() for i in leads.tolist()]
        packed["offset"] = offset[leads]
        bucket = np.frombuffer(packed["digest"].tobytes(), "<u8")[::2] % parts[owner[leads]].astype(np.uint64)
        order = np.lexsort((bucket, owner[leads]))
        bucket, of = bucket[order].astype(np.int64), owner[leads][order]
        breaks = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(bucket, prepend=-1) != 0))
        firsts = pa.array([p.tobytes() for p in np.split(packed[order], breaks[1:])], pa.binary())
        yield _found(table, of[breaks], np.zeros(len(breaks), np.int64), np.zeros(len(breaks), np.int64),
                     bucket=pa.array(bucket[breaks]), firsts=firsts)


def _judged_across(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Repeats among the firsts of different parts, some whole buckets of triggers."""
    table, place = _in_order(table)
    packed = [np.frombuffer(p, _FIRST) for p in table["firsts"].to_pylist()]
    owner, all_firsts = np.repeat(np.arange(len(packed)), [len(p) for p in packed]), np.concatenate(packed)
    trigger, offset = table["trigger"].to_numpy()[owner], all_firsts["offset"]
    # rows are in document order and places of a row ascend, so a stable sort leaves the earliest place first
    order = np.lexsort((offset, place[owner], all_firsts["digest"], trigger))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (all_firsts["digest"][order][1:] != all_firsts["digest"][order][:-1]) | (trigger[order][1:] != trigger[order][:-1])
    first = np.repeat(order[fresh], np.diff(np.append(np.flatnonzero(fresh), len(order))))
    again = np.sort(order[(place[owner[first]] != place[owner[order]]) | (offset[first] != offset[order])])
    again = again[np.lexsort((offset[again], owner[again]))]
    heads, sizes = _runs(offset[again], owner[again])
    yield _found(table, owner[again][heads], offset[again][heads], sizes)


def _by_groups(rows: DataFrame, part: str, judge, length: int) -> DataFrame:
    """Rows dealt out by trigger and part, and judged some whole groups at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < TOGETHER:
                continue
            table = pa.Table.from_batches(held)
            trigger, number = table["trigger"].to_numpy(), table[part].to_numpy()
            # the last group may go on in the next batch
            ends = np.flatnonzero((trigger[1:] != trigger[:-1]) | (number[1:] != number[:-1])) + 1
            if len(ends):
                yield from judge(table.slice(0, ends[-1]), length)
                table = table.slice(ends[-1]).combine_chunks()
            held, size = table.to_batches(), table.num_rows
        if size:
            yield from judge(pa.Table.from_batches(held), length)

    return rows.repartition("trigger", part).sortWithinPartitions("trigger", part).mapInArrow(run, _sql(_FOUND))


def repeated_runs(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, split: int = SPLIT) -> DataFrame:
    """``doc, key, start, n``: runs of n passages of documents ``doc, key, text`` that also stand earlier."""
    place, run = F.struct("doc", "key", "start"), ["doc", "key", "start", "n"]
    often = _parsed(docs, length, width, False).groupBy("trigger").agg(F.sum("times").alias("times")).filter("times > 1").select("trigger")
    parsed = materialize(_parsed(docs, length, width, True).join(often, "trigger", "left_semi"), "pfp_parse")
    dictionary = materialize(parsed.groupBy("trigger", "phrase").agg(
        F.min(place).alias("first"), F.count("*").alias("times"), F.first("n").alias("n")
    ), "pfp_dictionary")
    elsewhere = parsed.join(dictionary.filter("times > 1").select("trigger", "phrase", "first"), ["trigger", "phrase"])
    later = elsewhere.filter(~place.eqNullSafe(F.col("first"))).select(*run)
    again = parsed.filter("again IS NOT NULL").select("doc", "key", F.inline("again"))

    shared = dictionary.groupBy("trigger").agg(F.count("*").alias("phrases")).filter("phrases > 1")
    parts = F.ceil(F.col("phrases") / split)
    wanted = dictionary.join(shared, "trigger").select(
        "trigger", F.pmod("phrase", parts).alias("part"), parts.alias("parts"), "first.doc", "first.key", "first.start", "n"
    )
    found = materialize(_by_groups(_fetched(wanted, docs, length), "part", _judged, length), "pfp_found")
    across = _by_groups(found.filter("firsts IS NOT NULL"), "bucket", _judged_across, length)
    repeated = found.filter("firsts IS NULL")
    return later.unionByName(again).unionByName(repeated.select(*run)).unionByName(across.select(*run))


def _without(raw: memoryview, start: np.ndarray, end: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs, and what is left of a text without some ranges."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.append([True], start[1:] > reach[:-1]))
    begins, stops = start[fresh].tolist(), reach[np.append(fresh[1:] - 1, len(start) - 1)].tolist()
    left = [raw[a:b] for a, b in zip([0, *stops], [*begins, len(raw)])]
    return sum(stops) - sum(begins), len(begins), b"".join(left)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, width: int = WIDTH, split: int = SPLIT) -> DataFrame:
    """The input without its text, with ``n_bytes, n_removed, n_spans`` and the bytes ``kept``."""
    small_batches(df.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = {c: f"c{i}" for i, c in enumerate(df.columns) if c not in (text, *RESULT)}
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.xxhash64(body).alias("key"), body.alias("text"),
                     *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    runs = repeated_runs(rows.select("doc", "key", "text"), length, width, split)
    by_doc = runs.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    by_doc = by_doc.select(F.col("doc").alias("r_doc"), F.col("key").alias("r_key"), "runs")
    joined = rows.join(by_doc, F.col("r_doc").eqNullSafe(F.col("doc")) & (F.col("r_key") == F.col("key")), "left")
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, runs in parts:
            texts, lists = texts_of(column), runs.to_pylist()
            rows = []
            for i, found in enumerate(lists):
                raw = texts.data[texts.offsets[i] : texts.offsets[i + 1]].data
                if found:
                    start = np.array([r["start"] for r in found])
                    rows.append((len(raw), *_without(raw, start, start + np.array([r["n"] for r in found]) + (length - 1))))
                else:
                    rows.append((len(raw), 0, 0, bytes(raw)))
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)] if rows else
                                             [pa.array([], f.type) for f in kind], fields=list(kind))

    without = F.arrow_udf(run, "n_bytes long, n_removed long, n_spans long, kept binary")
    kept = [F.col(n).alias(c) for c, n in names.items()]
    return joined.select(*names.values(), without(F.col("text"), F.col("runs")).alias("found")).select(*kept, *[F.col(f"found.{c}") for c in RESULT])
