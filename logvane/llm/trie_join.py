"""Set similarity join on word n-grams by prefix trees.

Texts with equal n-gram sets form a class and are joined once. All n-grams have
one global order, rare ones first. Two sets that link must share an n-gram
among the first tenth of each, so classes meet by those; a histogram of every
set gives a lower bound of the difference of two and keeps strangers apart.
What remains connected is a cluster, and only its sets are shipped, once.

Inside a cluster the ordered sets are a trie: sets that begin alike share one
path. A walk down the trie carries the overlaps of the path with all sets at
once, so sets below a node share the partial overlaps counted above it, and a
subtree is left where the overlap so far and the length that remains can reach
no required overlap. Clusters of more than ``BLOCK`` sets are walked by pairs
of blocks in separate tasks. Links become components by star contraction.

Defined cases: a null or empty text has an empty set and links with nothing; it
is its own component. A text with fewer words than the n-gram size has its
whole sequence as its only n-gram. Rows that repeat a text, with the same key
or another, are one class. Null keys are members, but a component is named by
its smallest key that is not null. Very long texts are taken whole. N-grams and
sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.llm.text import Texts, chunks, lowered, mix, shingles, small_batches, texts_of, word_hashes, words_of
from logvane.operators.graph import connected_components
from logvane.session import collect_bounded, free_name, materialize, share

SIZE = 3
#: sets link where 100 * intersection >= PERCENT * union
PERCENT = 90
#: n-grams are counted in so many hashed buckets; counts only decide the order, never a result
ORDER_BITS = 18
#: classes of candidates are marked in a bitmap of so many bits before their sets are shipped
MARK_BITS = 24
BLOCK = 4_000
#: rows that go, up to which they are sent to all tasks
BROADCAST_ROWS = 1_000_000
#: groups of classes around one n-gram up to this size are compared pair by pair
SMALL_GROUP = 48


# ---- sets


def sets_of(texts: Texts, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of every text."""
    texts = lowered(texts)
    words = words_of(texts)
    hashes = word_hashes(texts.data, words)
    grams, owner = shingles(hashes, words, size)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    found = []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        if a == b and words.bounds[i] < words.bounds[i + 1]:
            whole = hashes[words.bounds[i] : words.bounds[i + 1]]
            key = np.array([len(whole)], np.uint64)
            for h in whole:
                key = mix(key * np.uint64(31) + h)
            found.append(key)
        else:
            found.append(np.unique(grams[a:b]))
    return found


def class_key(grams: np.ndarray) -> int:
    """One number for a set: equal sets have equal keys."""
    mixed = mix(grams)
    key = mixed.sum(keepdims=True) * np.uint64(3) ^ np.bitwise_xor.reduce(mixed, keepdims=True) ^ np.uint64(len(grams))
    return int(mix(key).view(np.int64)[0])


def least_overlap(a, b, percent: int = PERCENT):
    """The smallest intersection with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Among so many first n-grams of a set of n stands one that any linked set has among its own first."""
    return n - -(-percent * n // 100) + 1


def cells(n: int, percent: int = PERCENT) -> int:
    """Cells of a set's histogram: enough that strangers of that size differ by half more than linked sets may.

    Two unrelated sets of n differ by about 1.128 * sqrt(n * cells) in their cells.
    """
    allowed = 2 * (100 - percent) / (100 + percent) * n
    need = (1.5 * allowed / 1.128) ** 2 / max(n, 1)
    return 1 << min(max(int(np.ceil(np.log2(max(need, 1)))), 4), 12)


def histogram(grams: np.ndarray, count: int) -> np.ndarray:
    """How many n-grams fall into each cell, at most 255; the sum of differences bounds the symmetric difference."""
    shift = np.uint64(64 - int(count).bit_length() + 1)
    return np.minimum(np.bincount((grams >> shift).astype(np.int64), minlength=count), 255).astype(np.uint8)


def _each_set(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        found = []
        for _, piece in chunks(texts_of(batch.column("text"))):
            found += sets_of(piece, size)
        yield batch, found


# ---- first pass: classes, and how frequent the n-grams of each bucket are


def _first_pass(size: int, percent: int):
    schema = pa.schema([
        ("id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("cells", pa.binary()), ("bucket", pa.int64()), ("times", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        for batch, sets in _each_set(batches, size):
            if sets:
                places, times = np.unique(np.concatenate(sets) >> np.uint64(64 - ORDER_BITS), return_counts=True)
                counts[places.astype(np.int64)] += times
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("text_key"), pa.array([len(g) for g in sets], pa.int64()),
                pa.array([class_key(g) if len(g) else None for g in sets], pa.int64()),
                pa.array([histogram(g, cells(len(g), percent)).tobytes() for g in sets], pa.binary()), none, none,
            ], schema=schema)
        for part in np.array_split(np.flatnonzero(counts), 32):
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(counts[part])], schema=schema
            )

    return run, "id long, text_key long, n long, key long, cells binary, bucket long, times long"


# ---- second pass: classes by the n-grams of their prefix


def in_order(grams: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """The set in the global order: by the count of the n-gram's bucket, then by the n-gram."""
    return grams[np.argsort(frequency[(grams >> np.uint64(64 - ORDER_BITS)).astype(np.int64)], kind="stable")]


def _prefixes(shared, size: int, percent: int):
    schema = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, seen = shared.value, set()
        for _, sets in _each_set(batches, size):
            grams, keys, sizes = [], [], []
            for s in sets:
                if not len(s) or (key := class_key(s)) in seen:
                    continue
                seen.add(key)
                first = in_order(s, frequency)[: prefix_length(len(s), percent)]
                grams.append(first)
                keys.append(np.full(len(first), key))
                sizes.append(np.full(len(first), len(s)))
            if grams:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes)),
                ], schema=schema)

    return run, "gram long, key long, n long"


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by n-gram, in runs that never part the rows of one."""
    held = None
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
        # the last n-gram may go on in the next batch
        cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        if cut:
            yield [r[:cut] for r in rows]
        held = [r[cut:] for r in rows]
    if held is not None and len(held[0]):
        yield held


def _shared_grams(percent: int):
    """Rows, sorted by n-gram, size and class, whose n-gram another class of a size that may link has, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, key, n in _groups(batches, ["gram", "key", "n"]):
            fresh = np.concatenate([[True], (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])])
            gram, key, n = gram[fresh], key[fresh], n[fresh]
            pair = (gram[1:] == gram[:-1]) & (percent * n[1:] <= 100 * n[:-1])
            kept = np.concatenate([pair, [False]]) | np.concatenate([[False], pair])
            if kept.any():
                yield pa.RecordBatch.from_arrays([pa.array(gram[kept]), pa.array(key[kept]), pa.array(n[kept])], ["gram", "key", "n"])

    return run, "gram long, key long, n long"


class Forest:
    """Union-find over class keys; the smallest key of a tree is its root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, key: int) -> int:
        path = []
        while (up := self.parent.get(key, key)) != key:
            path.append(key)
            key = up
        for p in path:
            self.parent[p] = key
        return key

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            a, b = min(a, b), max(a, b)
            self.parent[b] = a
            self.parent.setdefault(a, a)

    def stars(self) -> list[tuple[int, int]]:
        return [(k, r) for k in self.parent if (r := self.root(k)) != k]


def _near(n: np.ndarray, sketch: np.ndarray, other_n, other_sketch, percent: int) -> np.ndarray:
    """Whether sets may link, by their sizes and histograms."""
    difference = n + other_n - 2 * least_overlap(n, other_n, percent)
    return (percent * np.maximum(n, other_n) <= 100 * np.minimum(n, other_n)) & (
        np.abs(sketch - other_sketch).sum(-1) <= difference
    )


def _coarse(raw: list[bytes], width: int) -> np.ndarray:
    """Histograms brought to one width; cells of a finer one are summed."""
    out = np.empty((len(raw), width), np.int16)
    for i, r in enumerate(raw):
        h = np.frombuffer(r, np.uint8)
        out[i] = h if len(h) == width else np.minimum(h.reshape(width, -1).sum(1, dtype=np.int64), 255)
    return out


def _group_edges(keys: np.ndarray, n: np.ndarray, raw: list[bytes], percent: int, forest: Forest) -> None:
    """Connect the classes around one n-gram that may link: from each class on to all not reached yet."""
    order = np.argsort(n, kind="stable")
    keys, n, raw = keys[order], n[order].astype(np.int64), [raw[i] for i in order]
    sketches: dict[int, np.ndarray] = {}
    left = np.ones(len(keys), bool)
    for i in range(len(keys)):
        if not left[i]:
            continue
        frontier = [i]
        left[i] = False
        while frontier:
            j = frontier.pop()
            low = np.searchsorted(n, -(-percent * n[j] // 100), "left")
            high = np.searchsorted(n, 100 * n[j] // percent, "right")
            others = low + np.flatnonzero(left[low:high])
            if not len(others):
                continue
            # widths grow with size: the coarsest around is that of the smallest
            width = len(raw[low])
            if width not in sketches:
                sketches[width] = _coarse([r if len(r) >= width else b"\0" * width for r in raw], width)
            own = sketches[width]
            reached = others[_near(n[others], own[others], n[j], own[j], percent)]
            left[reached] = False
            for k in reached:
                forest.join(int(keys[j]), int(keys[k]))
            frontier += reached.tolist()


def _meetings(percent: int):
    """Candidate edges from rows sorted by n-gram; one star per connected group of the partition."""

    def flush(rows: list[np.ndarray], forest: Forest) -> None:
        gram, keys, n, raw = rows
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        ends = np.append(starts[1:], len(gram))
        sizes = ends - starts
        for lag in range(1, SMALL_GROUP):
            # all pairs of small groups, a distance at a time
            chosen = (sizes > lag) & (sizes <= SMALL_GROUP)
            if not chosen.any():
                break
            first = np.arange(sum(sizes[chosen] - lag)) + np.repeat(
                starts[chosen] - np.concatenate([[0], np.cumsum(sizes[chosen] - lag)[:-1]]), sizes[chosen] - lag
            )
            second = first + lag
            a, b = n[first].astype(np.int64), n[second].astype(np.int64)
            fits = (keys[first] != keys[second]) & (percent * np.maximum(a, b) <= 100 * np.minimum(a, b))
            for i, j in zip(first[fits].tolist(), second[fits].tolist()):
                if forest.root(int(keys[i])) != forest.root(int(keys[j])):
                    width = min(len(raw[i]), len(raw[j]))
                    pair = _coarse([raw[i], raw[j]], width)
                    if _near(n[i : i + 1].astype(np.int64), pair[:1], int(n[j]), pair[1], percent)[0]:
                        forest.join(int(keys[i]), int(keys[j]))
        for a, b in zip(starts[sizes > SMALL_GROUP], ends[sizes > SMALL_GROUP]):
            once = np.unique(keys[a:b], return_index=True)[1] + a
            _group_edges(keys[once], n[once], [raw[i] for i in once], percent, forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for rows in _groups(batches, ["gram", "key", "n", "cells"]):
            flush(rows, forest)
        stars = forest.stars()
        for i in range(0, len(stars), 10_000):
            part = stars[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in part], pa.int64()), pa.array([s[1] for s in part], pa.int64())], ["a", "b"])

    return run, "a long, b long"


# ---- third pass: the sets of clusters


def _cluster_sets(shared_marks, shared_frequency, size: int):
    schema = pa.schema([("key", pa.int64()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, frequency, seen = shared_marks.value, shared_frequency.value, set()
        for _, sets in _each_set(batches, size):
            keys, grams = [], []
            for s in sets:
                if not len(s) or (key := class_key(s)) in seen:
                    continue
                place = key & ((1 << MARK_BITS) - 1)
                if marks[place >> 6] >> np.uint64(place & 63) & np.uint64(1):
                    seen.add(key)
                    keys.append(key)
                    grams.append(in_order(s, frequency).tobytes())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(grams, pa.binary())], schema=schema)

    return run, "key long, grams binary"


def _marks(members: DataFrame) -> np.ndarray:
    """A bitmap of the members' keys; its size does not grow with their number."""
    place = F.col("key").bitwiseAND((1 << MARK_BITS) - 1)
    words = members.groupBy(F.shiftrightunsigned(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast((key & {(1 << MARK_BITS) - 1}) & 63 as int))")).alias("bits")
    )
    marks = np.zeros(1 << (MARK_BITS - 6), np.uint64)
    for r in collect_bounded(words, len(marks), "marks"):
        marks[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return marks


# ---- the trie


def trie_links(sets: list[np.ndarray], queries: list[np.ndarray], percent: int = PERCENT) -> list[np.ndarray]:
    """For every set the numbers of the queries it links with, itself included if it is among them.

    N-grams are numbered by falling frequency among the sets, so that the
    trie's upper paths are the long common parts of near copies.
    """
    every, flat = np.unique(np.concatenate(sets), return_inverse=True)
    rank = np.empty(len(every), np.int64)
    rank[np.argsort(-np.bincount(flat, minlength=len(every)), kind="stable")] = np.arange(len(every))
    paths = [np.sort(rank[part]) for part in np.split(flat, np.cumsum([len(s) for s in sets])[:-1])]
    # who holds an n-gram: query numbers, grouped by n-gram
    held = np.concatenate(queries)
    at = np.minimum(np.searchsorted(every, held), len(every) - 1)
    known = every[at] == held
    owners = np.repeat(np.arange(len(queries)), [len(q) for q in queries])[known]
    gram = rank[at[known]]
    by_gram = np.argsort(gram, kind="stable")
    owners, bounds = owners[by_gram], np.searchsorted(gram[by_gram], np.arange(len(every) + 1))

    lengths = np.array([len(p) for p in paths])
    query_lengths = np.array([len(q) for q in queries])
    order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
    ordered = [paths[i] for i in order]
    common = [0] + [_common(a, b) for a, b in zip(ordered, ordered[1:])] + [0]  # with the path before
    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(paths)
    stack = [(0, len(ordered), 0, np.zeros(len(queries), np.int32))]
    while stack:
        low, high, depth, overlap = stack.pop()
        # the run that all paths of the range share from here on
        end = min(common[low + 1 : high], default=len(ordered[low])) if high - low > 1 else len(ordered[low])
        if end > depth:
            run = ordered[low][depth:end]
            touched = np.concatenate([owners[bounds[g] : bounds[g + 1]] for g in run])
            overlap = overlap + np.bincount(touched, minlength=len(queries)).astype(np.int32)
        members = lengths[order[low:high]] if high - low > 1 else lengths[order[low] : order[low] + 1]
        reach = overlap + np.minimum(members.max() - end, query_lengths)
        if not (reach >= least_overlap(members.min(), query_lengths, percent)).any():
            continue  # no set below can link with any query
        if high - low == 1:
            i = order[low]
            union = lengths[i] + query_lengths - overlap
            found[i] = np.flatnonzero(100 * overlap.astype(np.int64) >= percent * union)
            continue
        begin = low
        for k in range(low + 1, high + 1):
            if k == high or common[k] <= end:
                stack.append((begin, k, end, overlap))
                begin = k
    return found


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    different = np.flatnonzero(a[:n] != b[:n])
    return int(different[0]) if len(different) else n


def _joined(percent: int):
    """Links of whole groups, from rows sorted by cluster and pair of blocks."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[2])
        first, second = rows[0][0][1], rows[0][0][2]
        left = [r for r in rows if r[1] == first]
        right = left if first == second else [r for r in rows if r[1] == second]
        weight = {r[2]: 0 for r in rows}
        forest = Forest()
        if left and right:
            found = trie_links([r[4] for r in left], [r[4] for r in right], percent)
            for row, others in zip(left, found):
                for o in others.tolist():
                    if row[2] != (other := right[o])[2]:
                        forest.join(row[2], other[2])
                        weight[row[2]] += other[3]
                        if first != second:
                            weight[other[2]] += row[3]
        keys = [k for k, w in weight.items() if w]
        return pa.RecordBatch.from_arrays([
            pa.array(keys, pa.int64()), pa.array([forest.root(k) for k in keys], pa.int64()), pa.array([weight[k] for k in keys], pa.int64()),
        ], ["key", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("cluster", "first", "second", "block", "key", "copies", "grams")]):
                group = r[:3]
                if held and held[0][0] != group:
                    yield links(held)
                    held = []
                held.append((group, r[3], r[4], r[5], np.frombuffer(r[6], np.uint64)))
        if held:
            yield links(held)

    return run, "key long, root long, links long"


# ---- the join


def _components(df: DataFrame, key: str, text: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows as ``id, text_key, n, key`` (``key`` names the class of equal sets, null for empty ones), and classes as
    ``key, copies, component, component_id, links``."""
    spark = df.sparkSession
    small_batches(spark)
    whole = F.col(f"`{text}`")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(whole).alias("text_key"), whole.alias("text"))
    counted = materialize(rows.mapInArrow(*_first_pass(size, percent)), "join_classes")
    documents = counted.filter("n is not null").select("id", "text_key", "n", "key")
    frequency = np.zeros(1 << ORDER_BITS, np.int64)
    buckets = counted.filter("bucket is not null").groupBy("bucket").agg(F.sum("times").alias("times"))
    for part in collect_bounded(buckets, len(frequency), "buckets"):
        frequency[part["bucket"]] = part["times"]
    shared = share(frequency)

    texts = rows.select("text")
    order = ["gram", "n", "key"]
    prefixes = texts.mapInArrow(*_prefixes(shared, size, percent)).repartition("gram").sortWithinPartitions(*order)
    sketches = counted.filter("key is not null").groupBy("key").agg(F.first("cells").alias("cells"))
    meetings = materialize(prefixes.mapInArrow(*_shared_grams(percent)), "join_meetings").join(sketches, "key")
    meetings = meetings.repartition("gram").sortWithinPartitions(*order)
    near = materialize(meetings.mapInArrow(*_meetings(percent)).distinct(), "join_candidates")
    clusters = materialize(connected_components(near).select(F.col("node").alias("key"), F.col("component").alias("cluster")), "join_clusters")

    classes = documents.filter("key is not null").groupBy("key").agg(F.min("id").alias("smallest"), F.count("*").alias("copies"))
    sets = texts.mapInArrow(*_cluster_sets(share(_marks(clusters)), shared, size)).groupBy("key").agg(F.first("grams").alias("grams"))
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = clusters.join(sizes, "cluster").join(classes, "key").select(
        "key", "cluster", "copies", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block")
    )
    paired = members.join(sets, "key").select(
        "key", "cluster", "copies", "block", "grams", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    ).select("*", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second")).drop("other")
    group = ["cluster", "first", "second"]
    linked = materialize(
        paired.repartition(*group).sortWithinPartitions(*group).mapInArrow(*_joined(percent)), "join_links"
    )
    named = connected_components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    component = classes.join(named.select(F.col("node").alias("key"), "component"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    ).join(linked.groupBy("key").agg(F.sum("links").alias("links")), "key", "left")
    names = component.groupBy("component").agg(F.min("smallest").alias("component_id"))
    return documents, component.join(names, "component").select(
        "key", "copies", "component", "component_id", F.coalesce("links", F.lit(0)).alias("links")
    )


def join_components(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``key, n_shingles, component_id, n_links`` for every row."""
    documents, classes = _components(df, key, text, size, percent)
    alone = documents.filter("key is null").select("id", "n", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    met = documents.filter("key is not null").join(classes, "key").select(
        "id", "n", "component_id", (F.col("copies") - 1 + F.col("links")).alias("n_links")
    )
    return met.unionByName(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", "n_links")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The input with one row of each component: that with the smallest key (null last), then the smallest text hash.

    Texts without a word all stay. Rows that go are few or many; up to
    ``BROADCAST_ROWS`` of them are sent to all tasks, more are joined by a shuffle.
    """
    own, hashed = free_name(df, "member_id"), free_name(df, "member_text_key")
    documents, classes = _components(df, key, text, size, percent)
    met = documents.filter("key is not null").join(classes.select("key", "component"), "key").groupBy("component", "id", "text_key").agg(
        F.count("*").alias("times")
    )
    met = materialize(met, "join_members")
    first = met.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("first"))
    placed = met.join(first, "component").select(
        F.col("id").alias(own), F.col("text_key").alias(hashed), "times",
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key"))).alias("stays"),
    ).filter("not stays or times > 1")
    touched = materialize(placed, "join_touched")
    same = [F.col(f"`{key}`").cast("long").eqNullSafe(F.col(own)), F.xxhash64(F.col(f"`{text}`")) == F.col(hashed)]
    count = touched.count()
    hint = F.broadcast if count <= BROADCAST_ROWS else (lambda t: t)
    untouched = df.join(hint(touched.select(own, hashed)), same, "left_anti")
    repeated = touched.filter("stays").select(own, hashed)
    if repeated.isEmpty():
        return untouched
    once = df.join(hint(repeated), same).dropDuplicates([own, hashed]).drop(own, hashed)
    return untouched.unionByName(once)
