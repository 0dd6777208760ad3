"""Packing token sequences by bin completion with branch and bound.

Documents longer than a sequence are cut into full pieces; only the last piece
may be shorter. What is packed are lengths, not documents: the number of
pieces of every length below the capacity is a table of at most ``capacity``
numbers whatever the corpus holds. Around the largest length left, undominated
fillings of the rest of the sequence are enumerated depth first, with the
best-fit filling as incumbent and fillings pruned that cannot waste less. The
filling is repeated as often as its lengths last, so a plan has a few entries
per length. Pieces get their places by their rank within their length; ranks
are counted in salted parts, so one length may hold most of the rows.

Defined cases: a null or empty text has no ids but the closing one and is a
piece of one token. Repeated rows are packed each on their own. An empty table
gives no rows. A piece as long as the capacity fills a sequence alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logvane.llm.subword import subwords
from logvane.llm.text import small_batches
from logvane.session import collect_bounded, materialize, share

CAPACITY = 2048
CLOSING = b"\0\0\0\0"
#: fillings tried around one length before the best so far is taken
MAX_NODES = 2_000
#: pieces of one length that are ranked together
RANKED_TOGETHER = 50_000

PIECE = ["piece", "start", "length", "ids_crc32"]
PLACE = ["sequence_id", "offset"]


# ---- cutting


def pieces_of(ids: bytes, capacity: int) -> list[dict]:
    """Pieces of a document's 32-bit ids."""
    size = 4 * capacity
    return [
        {"piece": n, "start": n * capacity, "length": len(ids[a : a + size]) // 4, "ids_crc32": zlib.crc32(ids[a : a + size])}
        for n, a in enumerate(range(0, len(ids), size))
    ]


def cut(df: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the other columns of the input with ``piece, start, length, ids_crc32``."""
    small_batches(df.sparkSession)
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = subwords(tokenizer)
        for part in parts:
            yield pa.array([pieces_of(words.encode(t or "") + CLOSING, capacity) for t in part.to_pylist()], kind)

    # a deterministic function would be copied into a filter below the generator, and every text encoded twice
    pieces = F.arrow_udf(run, "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>").asNondeterministic()
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (text, *PIECE, *PLACE)]
    return df.select(*kept, pieces(F.col(f"`{text}`")).alias("_pieces")).select(*kept, F.inline("_pieces"))


# ---- planning on the table of lengths


def best_fit(counts: np.ndarray, room: int) -> list[int]:
    """Lengths that fill ``room`` greedily: always the largest that fits, while it lasts."""
    chosen, length = [], min(room, len(counts) - 1)
    while length > 0:
        if counts[length] and length <= room:
            times = min(int(counts[length]), room // length)
            chosen += [length] * times
            room -= times * length
        length = min(length - 1, room)
    return chosen


def completion(counts: np.ndarray, room: int, max_nodes: int = MAX_NODES) -> list[int]:
    """The filling of ``room`` that wastes least.

    Lengths go in by falling size. A branch ends where even the best-fit
    remainder of smaller lengths cannot beat the incumbent, or where the
    filling is dominated: some length left out would still fit beside it.
    """
    best = best_fit(counts, room)
    best_waste = room - sum(best)
    if best_waste == 0:
        return best
    present = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    total = [0] * (len(present) + 1)  # tokens of the lengths from place i on
    for i in range(len(present) - 1, -1, -1):
        total[i] = total[i + 1] + present[i] * int(min(counts[present[i]], room // present[i]))
    nodes = 0
    stack = [(0, room, ())]
    while stack and best_waste and nodes < max_nodes:
        place, left, chosen = stack.pop()
        nodes += 1
        if left < best_waste:
            best, best_waste = [x for x, n in chosen for _ in range(n)], left
        while place < len(present) and present[place] > left:
            place += 1
        if place == len(present) or left - total[place] >= best_waste:
            continue  # nothing fits any more, or all of it together wastes as much as the incumbent
        length = present[place]
        most = min(int(counts[length]), left // length)
        # fewest first, so that the branch with the most copies is tried next
        for times in range(0, most + 1):
            stack.append((place + 1, left - times * length, (*chosen, (length, times)) if times else chosen))
    return best


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Entries ``(length, first rank, sequences, first sequence, copies, offset)`` of the whole packing.

    An entry gives ranks ``first .. first + sequences * copies`` of its length
    to as many sequences, ``copies`` each, from ``offset`` on.
    """
    counts = counts.astype(np.int64).copy()
    ranks = np.zeros(len(counts), np.int64)
    entries, sequence = [], 0
    while len(rest := np.flatnonzero(counts)):
        largest = int(rest[-1])
        counts[largest] -= 1
        filling = completion(counts, capacity - largest)
        counts[largest] += 1
        lengths, copies = np.unique([largest, *filling], return_counts=True)
        times = int((counts[lengths] // copies).min())
        offset = 0
        for length, n in zip(lengths[::-1].tolist(), copies[::-1].tolist()):
            entries.append((length, int(ranks[length]), times, sequence, n, offset))
            ranks[length] += times * n
            counts[length] -= times * n
            offset += n * length
        sequence += times
    return entries


# ---- placing


def _ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Pieces with ``_rank`` within their length, from 0 without gaps.

    Frequent lengths are ranked in parts; the parts' sizes shift the ranks.
    """
    parts = np.ones(max(counts, default=0) + 1, int)
    for length, n in counts.items():
        parts[length] = -(-n // RANKED_TOGETHER)
    table = F.lit(",".join(map(str, parts.tolist())))
    columns = [c for c in pieces.columns]
    salted = pieces.withColumn("_parts", F.split(table, ",")[F.col("length").cast("int")].cast("long")).withColumn(
        "_part", F.pmod(F.xxhash64(*columns), F.col("_parts"))
    ).drop("_parts")
    sizes = salted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    shifts = sizes.select("length", "_part", (
        F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")
    ).alias("_shift"))
    order = Window.partitionBy("length", "_part").orderBy(*columns)
    return salted.withColumn("_at", F.row_number().over(order) - 1).join(shifts, ["length", "_part"]).withColumn(
        "_rank", F.col("_at") + F.col("_shift")
    ).drop("_at", "_shift", "_part")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``."""
    columns = [c for c in pieces.columns if c not in PLACE]
    pieces = materialize(pieces.select(*columns), "pieces")
    counts = {r["length"]: r["n"] for r in collect_bounded(
        pieces.groupBy("length").agg(F.count("*").alias("n")), capacity, "lengths"
    )}
    table = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        table[length] = n
    entries = np.array(plan(table, capacity), np.int64).reshape(-1, 6)
    entries = entries[np.lexsort((entries[:, 1], entries[:, 0]))]
    shared = share(entries)

    def place(lengths: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        found = shared.value
        keys = found[:, 0] << 48 | found[:, 1]
        for length, rank in lengths:
            length, rank = length.to_numpy(), rank.to_numpy()
            entry = found[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            nth = rank - entry[:, 1]
            yield pa.StructArray.from_arrays(
                [pa.array(entry[:, 3] + nth // entry[:, 4]), pa.array(entry[:, 5] + nth % entry[:, 4] * length)], PLACE
            )

    at = F.arrow_udf(place, "sequence_id long, offset long")(F.col("length"), F.col("_rank"))
    ranked = _ranked(pieces, counts)
    return ranked.select(*columns, at.alias("_place")).select(*columns, *[F.col(f"_place.{c}") for c in PLACE])
