"""Language model scores: a small causal self-attention model over subword ids, and word counts as a base.

Counts of words and of subword ids cover all training texts. The ids are put
into classes by frequency; the model predicts the class of the next id from
the ids before it, and the counts give the id within its class, so the
probabilities of all ids sum to one. Training is local descent with averaging:
in every round each task starts from the same parameters, learns from its
rows of the round's part of the training texts, and Spark sums what the tasks
arrive at, weighted by their tokens. The parts of all rounds together are all
training texts, each once.

Every text is encoded once; its ids are stored and read by all later passes.
Scoring cuts a text into windows that overlap: a window's first ids are context
only, except in the first window, so every id is scored once. Windows of many
texts are attended to in one batch under a causal mask.

Base scores need the count of every word. The most frequent words' counts are
sent to all tasks, a table of fixed size; all other words are looked up by a
shuffle join.

Defined cases: a null or empty text is its end alone. Without training texts
all counts are 0 and every id is equally likely. Repeated rows score alike.
Texts are scored whole, however long. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.llm.subword import forget, subwords
from logvane.llm.text import chunks, lowered, small_batches, texts_of, word_hashes, words_of
from logvane.session import collect_bounded, materialize, share

VOCABULARY = 49_408
END = 49_407
#: frequent ids that are a class of their own, and classes that the others share
OWN_CLASSES, SHARED_CLASSES = 40, 24
CLASSES = OWN_CLASSES + SHARED_CLASSES
#: ids with an input vector of their own; the others enter by their class
INPUT_IDS = 4_096
WIDTH, HIDDEN = 16, 32
WINDOW, CONTEXT = 64, 16
#: windows of a step of learning, and of a scoring pass, whose scores do not hang on it
TOGETHER, SCORED_TOGETHER = 32, 64
#: rounds of learning, each from its own part of the training texts
ROUNDS = 2
LEAST_STEPS, RATE = 150, 0.01
#: words whose counts every task holds
HELD_WORDS = 1 << 17
WORDS_TOGETHER = 4_000_000
END_KEY = np.int64(0x5EED0E0D)
LOG10 = np.log(10.0)
#: column of a text's ids as 16-bit numbers, next to the text
IDS = "_lm_ids"


# ---- ids


def encoded(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """The input with the ids of its texts in ``IDS``, stored: counting, learning and scoring read the ids from there."""
    if IDS in df.columns:
        return df
    small_batches(df.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = subwords(tokenizer)
        for batch in batches:
            ids = [np.frombuffer(own.encode(t or ""), "<u4").astype("<u2").tobytes() for t in batch.column(text).to_pylist()]
            yield batch.append_column(IDS, pa.array(ids, pa.binary()))

    return materialize(df.mapInArrow(run, f"{kinds}, {IDS} binary"), "lm_ids")


def _ids_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(ids, "<u2").astype(np.int64) for ids in batch.column(IDS).to_pylist()]


# ---- counts


def word_ends(tokenizer: str) -> np.ndarray:
    """Which ids end a word."""
    whole = subwords(tokenizer).tokenizer
    return np.array([(whole.id_to_token(i) or "").endswith("</w>") for i in range(VOCABULARY)])


def _opens(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether an id begins a word: the id before ends one, or there is none."""
    return np.concatenate([[True], ends[ids[:-1]]]) if len(ids) else np.empty(0, bool)


def _counting(ends: np.ndarray):
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def batch(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, size, texts, ids = [], 0, 0, np.zeros(2 * VOCABULARY, np.int64)
        for part in batches:
            column = part.column("text")
            texts += len(column)
            for _, piece in chunks(texts_of(column)):
                piece_low = lowered(piece)
                held.append(word_hashes(piece_low.data, words_of(piece_low)))
                size += len(held[-1])
            coded = [found + VOCABULARY * _opens(found, ends) for found in _ids_of(part)]
            if coded:
                ids += np.bincount(np.concatenate(coded), minlength=2 * VOCABULARY)
            if size > WORDS_TOGETHER:
                yield batch(0, *_times(held))
                held, size = [], 0
        if held:
            yield batch(0, *_times(held))
        if texts:
            ids[END + VOCABULARY] += texts
            yield batch(0, np.array([END_KEY]), np.array([texts]))
            seen = np.flatnonzero(ids)
            yield batch(1, seen, ids[seen])

    return run, "kind int, key long, n long"


def _times(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.unique(np.concatenate(held), return_counts=True)
    return keys.view(np.int64), n


@dataclass
class Counts:
    """Word counts as a table, and what is small: totals, frequent words, id counts."""

    words: DataFrame
    total: int
    distinct: int
    held_keys: np.ndarray
    held_counts: np.ndarray
    ids: np.ndarray


def _most_frequent(words: DataFrame) -> DataFrame:
    """At most ``HELD_WORDS`` of the most frequent words: all above a count found from a histogram of counts."""
    level = F.floor(16 * F.log2("n"))
    sizes = collect_bounded(words.groupBy(level.alias("level")).agg(F.count("*").alias("words")), 1_024, "levels")
    lowest, held = None, 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        held += r["words"]
        if held > HELD_WORDS:
            break
        lowest = r["level"]
    return words.filter(level >= lowest) if lowest is not None else words.filter("false")


def count_corpus(texts: DataFrame, tokenizer: str) -> Counts:
    small_batches(texts.sparkSession)
    counted = materialize(
        encoded(texts, tokenizer).select("text", IDS).mapInArrow(*_counting(word_ends(tokenizer))).groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm_counts"
    )
    words = counted.filter("kind = 0").select("key", "n")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = _most_frequent(words).toArrow()
    keys, times = top.column("key").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(keys)
    ids = np.zeros(2 * VOCABULARY, np.int64)
    for r in collect_bounded(counted.filter("kind = 1"), 2 * VOCABULARY, "ids"):
        ids[r["key"]] = r["n"]
    return Counts(
        words, int(totals["n"]), int(totals["v"]), keys[order], times[order], ids.reshape(2, VOCABULARY),
    )


# ---- the model


@dataclass
class Model:
    """Classes of ids, the log share of each id in its class inside and at the start of words, input rows, parameters.

    The share is that among the ids of the class at a like place, so it is a
    distribution over the class whatever stands before.
    """

    of_class: np.ndarray
    ends: np.ndarray
    within: np.ndarray
    row: np.ndarray
    vector: np.ndarray


SHAPES = {
    "e": (1 + INPUT_IDS + CLASSES, WIDTH), "p": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH),
    "o": (WIDTH, WIDTH), "h": (WIDTH, HIDDEN), "hb": (HIDDEN,), "g": (HIDDEN, WIDTH), "u": (WIDTH, CLASSES), "ub": (CLASSES,),
}
SIZE = sum(math.prod(s) for s in SHAPES.values())
_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def parameters(vector: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the parts of a vector."""
    parts, at = {}, 0
    for name, shape in SHAPES.items():
        size = math.prod(shape)
        parts[name] = vector[at : at + size].reshape(shape)
        at += size
    return parts


def new_model(ids: np.ndarray, ends_word: np.ndarray) -> Model:
    """Classes and shares from id counts; parameters at random from a fixed seed, biases at the classes' odds."""
    by_place, ids = ids, ids.sum(0)
    order = np.argsort(-ids, kind="stable")
    of_class = np.empty(VOCABULARY, np.int64)
    of_class[order[:OWN_CLASSES]] = np.arange(OWN_CLASSES)
    rest, half = order[OWN_CLASSES:], SHARED_CLASSES // 2
    for side in (False, True):
        # ids inside and at the end of words apart, each cut into classes of equal mass
        part = rest[ends_word[rest] == side]
        mass = np.cumsum(ids[part] + 0.5)
        of_class[part] = OWN_CLASSES + half * side + np.minimum((mass / mass[-1] * half).astype(int), half - 1) if len(part) else 0
    # an id's share at a place leans on its share anywhere
    mass = np.bincount(of_class, ids + 0.5, CLASSES)
    smoothed = by_place + 4 * (ids + 0.5) / mass[of_class]
    shares = np.stack([s / np.bincount(of_class, s, CLASSES)[of_class] for s in smoothed])
    row = 1 + INPUT_IDS + of_class
    row[order[:INPUT_IDS]] = 1 + np.arange(INPUT_IDS)
    vector = np.random.default_rng(11).normal(0, 0.1, SIZE).astype(np.float32)
    parts = parameters(vector)
    parts["hb"][:] = 0
    parts["ub"][:] = np.log((mass + 0.5) / (mass + 0.5).sum())
    return Model(of_class, ends_word, np.log(shares), row, vector)


def _forward(w: dict[str, np.ndarray], x: np.ndarray) -> tuple:
    """Logits of the next class after every place of the windows ``x`` of input rows, and what went before."""
    h = w["e"][x] + w["p"]
    q, k, v = h @ w["q"], h @ w["k"], h @ w["v"]
    a = q @ k.transpose(0, 2, 1)
    a *= np.float32(WIDTH**-0.5)
    a += _MASK
    a -= a.max(-1, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(-1, keepdims=True)
    c = a @ v
    o = h + c @ w["o"]
    m = np.maximum(o @ w["h"] + w["hb"], 0)
    z = o + m @ w["g"]
    return z @ w["u"] + w["ub"], h, q, k, v, a, c, o, m, z


def _log_normal(logits: np.ndarray) -> np.ndarray:
    top = logits.max(-1, keepdims=True)
    return top + np.log(np.exp(logits - top).sum(-1, keepdims=True))


#: exponents of 32-bit numbers stay finite below this, and sums of exponents are sound between these
EXP_LIMIT, LEAST_SUM, MOST_SUM = 80, 1e-30, 1e30
_BELOW = np.tril(np.ones((WINDOW, WINDOW), np.float32))
#: a place's query and value stand side by side; behind them stands a one in learning, the input in scoring
_Q, _V, _V1, _H = slice(0, WIDTH), slice(WIDTH, 2 * WIDTH), slice(WIDTH, 2 * WIDTH + 1), slice(2 * WIDTH, 3 * WIDTH)
_QV, _ROW = slice(0, 2 * WIDTH), 3 * WIDTH


class _Space(dict):
    """Buffers by name that are used again: fresh memory for every product costs more than many of the products."""

    def __init__(self, dtype=np.float32):
        super().__init__()
        self.dtype = dtype

    def take(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self or len(self[name]) < size:
            self[name] = np.empty(size, self.dtype)
        return self[name][:size].reshape(shape)

    def product(self, name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.matmul(a, b, out=self.take(name, *a.shape[:-1], b.shape[-1]))

    def rows(self, name: str, a: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.take(a, at, axis=0, out=self.take(name, *at.shape, a.shape[1]), mode="clip")


def _longest(rows: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max(initial=0)))


def _sound(sums: np.ndarray) -> bool:
    """Whether sums of exponents neither overflowed nor vanished."""
    return sums.min() > LEAST_SUM and sums.max() < MOST_SUM


def _side_by_side(w: dict[str, np.ndarray]) -> np.ndarray:
    """What gives queries and values from inputs, side by side.

    Queries are taken through the keys' matrix and values through the outputs', so the inputs themselves are the keys
    and the attended values are added to them as they are.
    """
    return np.concatenate([w["q"] @ w["k"].T * np.asarray(WIDTH**-0.5, w["q"].dtype), w["v"] @ w["o"]], 1)


def _attended(
    queries: np.ndarray, keys: np.ndarray, values: np.ndarray, skip: int, space: _Space
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unnormalized attention of the queries from place ``skip`` on, what it gives, and its sums."""
    for steep in (False, True):
        a = space.product("a", queries, keys.transpose(0, 2, 1))
        if steep:
            a += _MASK[skip:]
            a -= a.max(-1, keepdims=True)
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(a, out=a)
            a *= _BELOW[skip:]
            sums = a @ np.ones(WINDOW, a.dtype)
        if _sound(sums):  # trained scores are far from the limits
            break
    return a, space.product("c", a, values), sums[:, :, None]


def _classes(w: dict[str, np.ndarray], o: np.ndarray, target: np.ndarray, space: _Space) -> tuple[np.ndarray, ...]:
    """Hidden rows, outputs, exponents of the classes, their sums, places of the targets and their log probabilities."""
    m = space.product("m", o, w["h"])
    m += w["hb"]
    np.maximum(m, 0, out=m)
    z = space.product("z", m, w["g"])
    z += o
    spot = np.arange(0, len(z) * CLASSES, CLASSES)
    spot += target
    for steep in (False, True):
        d = space.product("d", z, w["u"])
        d += w["ub"]
        if steep:
            d -= d.max(-1, keepdims=True)
        found = d.reshape(-1)[spot]
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(d, out=d)
            sums = d @ np.ones(CLASSES, d.dtype)
        if _sound(sums):
            break
    return m, z, d, sums, spot, found - np.log(sums)


def gradient(
    w: dict[str, np.ndarray], x: np.ndarray, target: np.ndarray, counted: np.ndarray, space: _Space | None = None
) -> tuple[np.ndarray, float]:
    """Gradient of the mean loss over the places that count, as a vector, and that loss.

    Behind the attention only the places that count are looked at. The vector is the space's own.
    """
    space = _Space(w["e"].dtype) if space is None else space
    vector = space.take("vector", SIZE)
    vector[:] = 0
    g, at = parameters(vector), np.flatnonzero(counted)
    if not len(at):
        return vector, 0.0
    n, side = len(at), _side_by_side(w)
    h = space.rows("h", w["e"], x)
    h += w["p"]
    rows = space.take("rows", *x.shape, _ROW)
    flat, inputs = rows.reshape(-1, _ROW), h.reshape(-1, WIDTH)
    np.matmul(inputs, side, out=flat[:, _QV])
    flat[:, 2 * WIDTH] = 1
    a, c, inverse = _attended(rows[:, :, _Q], h, rows[:, :, _V], 0, space)
    np.reciprocal(inverse, out=inverse)
    c *= inverse
    c, inverse = space.rows("c_at", c.reshape(-1, WIDTH), at), inverse.ravel()[at]
    o = space.rows("o", inputs, at)
    o += c
    m, z, d, total, spot, found = _classes(w, o, target.ravel()[at], space)
    total *= n
    d /= total[:, None]
    d.reshape(-1)[spot] -= np.asarray(1 / n, d.dtype)
    ones = np.ones(n, d.dtype)
    g["u"][:], g["ub"][:] = (d.T @ z).T, ones @ d
    dz = space.product("dz", d, w["u"].T)
    g["g"][:] = m.T @ dz
    dm = space.product("dm", dz, w["g"].T)
    dm *= np.greater(m, 0, out=m)
    g["h"][:], g["hb"][:] = o.T @ dm, ones @ dm
    dz += space.product("do", dm, w["h"].T)
    # a row of the softmax takes its own mean off: a last column that meets the values' ones
    dc = space.take("dc", n, WIDTH + 1)
    np.einsum("ij,ij->i", dz, c, out=dc[:, WIDTH])
    dc[:, WIDTH] *= -inverse
    np.multiply(dz, inverse[:, None], out=dc[:, :WIDTH])
    back = space.take("back", *x.shape, WIDTH + 1)
    back[:] = 0
    back.reshape(-1, WIDTH + 1)[at] = dc
    ds = space.product("ds", back, rows[:, :, _V1].transpose(0, 2, 1))
    ds *= a
    drows = space.take("drows", *x.shape, 2 * WIDTH)
    np.matmul(ds, h, out=drows[:, :, _Q])
    np.matmul(a.transpose(0, 2, 1), back[:, :, :WIDTH], out=drows[:, :, _V])
    keys = space.product("dk", ds.transpose(0, 2, 1), rows[:, :, _Q]).reshape(-1, WIDTH)
    drows = drows.reshape(-1, 2 * WIDTH)
    sides = (drows.T @ inputs).T
    scores, values = sides[:, _Q] * np.asarray(WIDTH**-0.5, d.dtype), sides[:, _V]
    g["q"][:], g["k"][:] = scores @ w["k"], scores.T @ w["q"]
    g["v"][:], g["o"][:] = values @ w["o"].T, w["v"].T @ values
    dh = space.product("dh", drows, side.T)
    dh += keys
    dh[at] += dz
    g["p"][:] = dh.reshape(h.shape).sum(0)
    # one-dimensional sums are many times faster than additions of rows
    spots = np.add.outer(x.ravel() * WIDTH, np.arange(WIDTH)).ravel()
    g["e"].reshape(-1)[:] = np.bincount(spots, dh.ravel(), g["e"].size)
    return vector, -float(found.sum()) / n


def windows_of(ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input rows, next ids and the places that count, of a text's windows; its end is the last next id."""
    following = np.append(ids, END)
    before = np.concatenate([[0], row[ids]])
    step = WINDOW - CONTEXT
    count = 1 + max(0, -(-(len(following) - WINDOW) // step))
    at = step * np.arange(count)[:, None] + np.arange(WINDOW)
    there = at < len(following)
    at = np.minimum(at, len(following) - 1)
    there[1:, :CONTEXT] = False
    return before[at], following[at], there


def learn(model: Model, windows: list[tuple], seed: int) -> tuple[np.ndarray, int]:
    """Parameters after passing over the windows, and the number of places they were learned from."""
    x, nxt, there = (np.concatenate([w[i] for w in windows]) for i in range(3))
    target = model.of_class[nxt]
    vector = model.vector.copy()
    w = parameters(vector)
    mean, square = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32)
    rng, step, space, change = np.random.default_rng(seed), 0, _Space(), np.empty(SIZE, np.float32)
    steps = max(LEAST_STEPS, -(-len(x) // TOGETHER))
    while step < steps:
        order = rng.permutation(len(x))
        for begin in range(0, len(order), TOGETHER):
            pick = order[begin : begin + TOGETHER]
            g, _ = gradient(w, x[pick], target[pick], there[pick], space)
            step += 1
            np.subtract(g, mean, out=change)
            change *= 0.1
            mean += change
            np.multiply(g, g, out=change)
            change -= square
            change *= 0.01
            square += change
            rate = RATE * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            np.sqrt(square, out=change)
            change += 1e-8
            np.divide(mean, change, out=change)
            change *= np.float32(rate)
            vector -= change
            if step >= steps:
                break
    return vector, int(there.sum())


def parts_of(texts: DataFrame) -> list[DataFrame]:
    """The texts of every round; each row is in one of them.

    The part hangs on all columns but the ids, so copies of a text under other
    keys are dealt over the rounds. Texts with ids are given by their ids alone.
    """
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in texts.columns if c != IDS]), F.lit(ROUNDS))
    return [texts.filter(part == number).select(IDS if IDS in texts.columns else "text") for number in range(ROUNDS)]


def _learning(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own, windows = shared.value, []
        sums, weight = np.zeros(SIZE), 0
        for batch in batches:
            windows += [windows_of(ids, own.row) for ids in _ids_of(batch)]
            if sum(len(w[0]) for w in windows) > 20_000:
                vector, n = learn(own, windows, 1)
                sums, weight, windows = sums + vector.astype(float) * n, weight + n, []
        if windows:
            vector, n = learn(own, windows, 1)
            sums, weight = sums + vector.astype(float) * n, weight + n
        if weight:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, SIZE)), pa.array(np.concatenate([[float(weight)], sums]))], ["place", "value"]
            )

    return run


def train(texts: DataFrame, model: Model, tokenizer: str) -> Model:
    """Rounds of learning in all tasks and averaging; place -1 holds the weight."""
    for part in parts_of(encoded(texts, tokenizer)):
        rows = part.mapInArrow(_learning(share(model)), "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
        got = collect_bounded(rows, SIZE + 1, "parameters")
        if got:
            vector = np.zeros(SIZE + 1)
            for r in got:
                vector[r["place"] + 1] = r["value"]
            model = Model(model.of_class, model.ends, model.within, model.row, (vector[1:] / vector[0]).astype(np.float32))
    return model


class _Scorer:
    """The forward pass alone: what `_forward` gives, with fewer passes over memory.

    Queries and values are linear in the input rows, so each is worked out once
    for every row and place and looked up; inputs stand behind them.
    """

    def __init__(self, model: Model):
        self.w, self.space = parameters(model.vector), _Space()
        wide = np.concatenate([_side_by_side(self.w), np.eye(WIDTH, dtype=np.float32)], 1)
        self.rows, self.places = self.w["e"] @ wide, self.w["p"] @ wide
        longest = [_longest(self.rows[:, part]) + _longest(self.places[:, part]) for part in (_Q, _H)]
        self.sharpest = longest[0] * longest[1]

    def __call__(self, x: np.ndarray, target: np.ndarray, skip: int) -> np.ndarray:
        """Natural logarithms of the class probabilities of the targets from place ``skip`` on."""
        rows = self.space.rows("rows", self.rows, x)
        rows += self.places
        _, c, sums = _attended(rows[:, skip:, _Q], rows[:, :, _H], rows[:, :, _V], skip, self.space)
        c /= sums
        c += rows[:, skip:, _H]
        return _classes(self.w, c.reshape(-1, WIDTH), target[:, skip:].ravel(), self.space)[-1].reshape(len(x), WINDOW - skip)


def log10_scores(model: Model, texts: list[np.ndarray], scorer: _Scorer | None = None) -> np.ndarray:
    """The log10 probability of every text of ids, its end included."""
    scorer = scorer or _Scorer(model)
    parts = [windows_of(ids, model.row) for ids in texts]
    number = np.array([len(p[0]) for p in parts])
    owner = np.repeat(np.arange(len(texts)), number)
    x, nxt, there = (np.concatenate([p[i] for p in parts]) for i in range(3))
    target, first = model.of_class[nxt], np.zeros(len(x), bool)
    first[np.cumsum(number) - number] = True
    sums = np.zeros(len(x))
    # a later window's first places are context only: nothing is asked of them
    for skip, windows in ((0, np.flatnonzero(first)), (CONTEXT, np.flatnonzero(~first))):
        for begin in range(0, len(windows), SCORED_TOGETHER):
            part = windows[begin : begin + SCORED_TOGETHER]
            found = scorer(x[part], target[part], skip)
            sums[part] = (found * there[part, skip:]).sum(1, dtype=np.float64)
    # the share of an id in its class, by whether it begins a word
    stream = np.concatenate([np.append(ids, END) for ids in texts])
    size = np.array([len(ids) + 1 for ids in texts])
    opens = np.empty(len(stream), np.int64)
    opens[1:] = model.ends[stream[:-1]]
    opens[np.cumsum(size) - size] = 1
    shares = np.add.reduceat(model.within[opens, stream], np.cumsum(size) - size)
    return (np.bincount(owner, sums, len(texts)) + shares) / LOG10


# ---- scoring


def _scoring(shared):
    kinds = pa.schema([
        ("row_id", pa.int64()), ("n_tokens", pa.int64()), ("held_known", pa.int64()), ("held_score", pa.float64()),
        ("rare", pa.list_(pa.int64())), ("score", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        model, keys, logs, known = shared.value
        scorer, row = _Scorer(model), TaskContext.get().partitionId() << 40
        for batch in batches:
            column, others = batch.column("text"), [c for c in batch.schema.names if c not in ("text", IDS)]
            tokens, held_known, held_score, rare = [], [], [], []
            for _, piece in chunks(texts_of(column)):
                piece = lowered(piece)
                words = words_of(piece)
                hashes = word_hashes(piece.data, words).view(np.int64)
                # the end stands before the next text's words
                hashes = np.insert(hashes, words.bounds[1:], END_KEY)
                bounds = words.bounds + np.arange(len(piece) + 1)
                at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0)) if len(keys) else np.zeros(len(hashes), np.int64)
                here = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
                add = np.concatenate([[0.0], np.cumsum(np.where(here, logs[at], 0.0) if len(keys) else np.zeros(len(hashes)))])
                is_known = np.concatenate([[0], np.cumsum(here & known[at] if len(keys) else here)])
                tokens += np.diff(bounds).tolist()
                held_score += (add[bounds[1:]] - add[bounds[:-1]]).tolist()
                held_known += (is_known[bounds[1:]] - is_known[bounds[:-1]]).tolist()
                unheld = np.flatnonzero(~here)
                rare += np.split(hashes[unheld], np.searchsorted(unheld, bounds[1:-1]))
            ids = _ids_of(batch)
            score = log10_scores(model, ids, scorer) if ids else []
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + len(column))), pa.array(tokens, pa.int64()), pa.array(held_known, pa.int64()),
                pa.array(held_score, pa.float64()), pa.array(rare, pa.list_(pa.int64())), pa.array(score, pa.float64()),
            ] + [batch.column(c) for c in others], names=[*kinds.names, *others])
            row += len(column)

    return run


def score(df: DataFrame, counts: Counts, model: Model, tokenizer: str, text: str = "text") -> DataFrame:
    """The input without its text, with ``n_tokens, n_known, train_tokens, base_score, score``."""
    small_batches(df.sparkSession)
    df = encoded(df, tokenizer, text)
    added = [IDS, "row_id", "n_tokens", "n_known", "held_known", "held_score", "rare", "train_tokens", "base_score", "score"]
    kept = [c for c in df.columns if c not in (text, *added)]
    bottom = counts.total + 0.5 * (counts.distinct + 1)
    logs = np.log10((counts.held_counts + 0.5) / bottom)
    shared = share((model, counts.held_keys, logs, counts.held_counts > 0))
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("text"), IDS)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in kept]).schema)
    scored = materialize(rows.mapInArrow(
        _scoring(shared),
        "row_id long, n_tokens long, held_known long, held_score double, rare array<long>, score double" + (", " + kinds if kinds else ""),
    ), "lm_scored")
    rare = scored.select("row_id", F.explode("rare").alias("key")).join(counts.words, "key", "left")
    sums = rare.groupBy("row_id").agg(
        F.count("n").alias("rare_known"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / bottom)).alias("rare_score")
    )
    return scored.drop("rare").join(sums, "row_id", "left").select(
        *[F.col(f"`{c}`") for c in kept], "n_tokens", (F.col("held_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("held_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"), "score",
    )


def fit(texts: DataFrame, tokenizer: str) -> tuple[Counts, Model]:
    """Counts and model of the training texts."""
    texts = encoded(texts, tokenizer)
    counts = count_corpus(texts, tokenizer)
    return counts, train(texts, new_model(counts.ids, word_ends(tokenizer)), tokenizer)
