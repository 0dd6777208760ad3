"""Fill-in-middle transformation with a compressed set of character boundaries.

Where the code points of a text begin, and where the last one ends, is a set of
byte offsets. It is kept as a row of containers, one per 64 KiB of text, each
in the smallest of three forms: a sorted array of 16-bit places, a bitmap, or
runs (plain ASCII is one run). Cumulative cardinalities stand beside the
containers: the offset of the k-th boundary is found by a search for the
container and a select inside it. Both cuts of a text are looked up at once,
and prefix, middle and suffix are slices of the text's own bytes.

A narrow operation: no shuffle, and a batch of texts in memory at a time.

Defined cases: a null or empty text has no code points and stays plain, and a
null is given back as an empty text. A text that contains a marker stays plain,
so every output can be taken apart again. A null key draws from the seed alone.
Equal keys draw equal numbers; repeated rows give equal results. Very long
texts are cut whole. Columns of the input that are named like results are
replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.llm.text import small_batches, texts_of, unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: of 100 texts, so many keep their order, and of the others so many are written suffix first
PLAIN_PERCENT, SPM_PERCENT = 10, 20
SPAN = 1 << 16
RESULT = ["n", "form", "prefix_chars", "middle_chars", "output"]

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class ArrayContainer:
    """Sorted places."""

    def __init__(self, places: np.ndarray):
        self.places = places.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.places[k])


class BitmapContainer:
    """One bit per place, with the number of bits before each byte."""

    def __init__(self, places: np.ndarray):
        present = np.zeros(SPAN, bool)
        present[places] = True
        self.bits = np.packbits(present, bitorder="little")
        self.before = np.zeros(len(self.bits) + 1, np.int32)
        np.cumsum(_ONES[self.bits], out=self.before[1:])

    def select(self, k: int) -> int:
        byte = int(np.searchsorted(self.before, k, "right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.bits[byte : byte + 1], bitorder="little"))
        return 8 * byte + int(inside[k - self.before[byte]])


class RunContainer:
    """First places of runs, with the number of places before each run."""

    def __init__(self, first: np.ndarray, before: np.ndarray):
        self.first, self.before = first.astype(np.uint16), before.astype(np.int32)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[run]) + k - int(self.before[run])


def container(places: np.ndarray):
    """The smallest form of some sorted places: 2 bytes a place, 8 KiB, or 4 bytes a run."""
    run_heads = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    if 4 * len(run_heads) <= min(2 * len(places), SPAN // 8):
        return RunContainer(places[run_heads], run_heads)
    return ArrayContainer(places) if 2 * len(places) <= SPAN // 8 else BitmapContainer(places)


class Boundaries:
    """The byte offsets between the code points of a text, its two ends included."""

    def __init__(self, data: np.ndarray):
        self.spans, self.containers, counts = [], [], [0]
        starts = np.append((data & 0xC0) != 0x80, True)
        for span, a in enumerate(range(0, len(starts), SPAN)):
            places = np.flatnonzero(starts[a : a + SPAN])
            if len(places):
                self.spans.append(span)
                self.containers.append(container(places))
                counts.append(counts[-1] + len(places))
        self.cumulative = np.array(counts, np.int64)

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def select(self, wanted: list[int]) -> list[int]:
        """Offsets of the boundaries with these numbers."""
        at = np.searchsorted(self.cumulative, wanted, "right") - 1
        return [
            self.spans[i] * SPAN + self.containers[i].select(k - int(self.cumulative[i])) for i, k in zip(at.tolist(), wanted)
        ]


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of seed and key."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _cut(data: np.ndarray, h: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
    raw, bounds = data.tobytes(), Boundaries(data)
    n = len(bounds) - 1
    if n == 0 or h[2] % 100 >= 100 - PLAIN_PERCENT or any(m.encode() in raw for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = bounds.select([first, second])
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h[3] % 100 < SPM_PERCENT:
        return n, "spm", first, second - first, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", first, second - first, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """The input without its text, with code points, form, lengths in code points and the ``output`` text."""
    small_batches(df.sparkSession)
    kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for column, *hashes in parts:
            texts, drawn = texts_of(column), np.stack([h.to_numpy() for h in hashes], 1).tolist()
            rows = [_cut(texts.data[texts.offsets[i] : texts.offsets[i + 1]], h) for i, h in enumerate(drawn)]
            fields = list(zip(*rows)) if rows else [()] * len(RESULT)
            arrays = [pa.array(values, f.type if f.name != "output" else pa.binary()) for values, f in zip(fields, kind)]
            yield pa.StructArray.from_arrays([*arrays[:-1], arrays[-1].cast(pa.string())], fields=list(kind))

    cut = F.arrow_udf(run, "n long, form string, prefix_chars long, middle_chars long, output string")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (text, *RESULT)]
    made = unused(df.columns, "_fim")
    cuts = df.select(*kept, cut(F.col(f"`{text}`"), *draws(F.col(f"`{key}`"), seed)).alias(made))
    return cuts.select(*kept, *[F.col(f"{made}.{c}") for c in RESULT])


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone: no part contains a marker, so the first of each is the border."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    first = F.split(body, F.when(form == "psm", SUFFIX).otherwise(PREFIX), 2)
    second = F.split(first[1], F.lit(MIDDLE), 2)
    psm = F.concat(first[0], second[1], second[0])
    spm = F.concat(second[0], second[1], first[0])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
