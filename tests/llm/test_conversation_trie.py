"""The conversation trie against a trie of tuples."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from logvane.llm import conversation_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0), role, hashlib.md5(text.encode()).hexdigest(), text))
    said = {c: [(t[1], t[3]) for t in sorted(ts)] for c, ts in turns.items()}
    members = collections.defaultdict(list)
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt = tuple(said.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(rebuilt) + 1):
            members[rebuilt[:d]].append((c, d == len(rebuilt)))
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * (len(WORD.findall(k[-1][1])) if k else 0)
    first = {k: min(c for c, _ in m) for k, m in members.items()}
    return collections.Counter(
        (first[k], len(k), first[k[:-1]] if k else None, len(m), children[k], leaves[k], saved[k],
         hashlib.sha256(",".join(map(str, sorted(c for c, end in m if end))).encode()).hexdigest())
        for k, m in members.items()
    )


def conversations(seed, n=120):
    rng = random.Random(seed)
    texts = ["", None, "yes", "no", "go on\tplease", "wörds  and words", "a b c d e", "  "]
    rows, known = [], []
    for c in rng.sample(range(400), n):
        turns = [("user" if i % 2 == 0 else "assistant", rng.choice(texts)) for i in range(rng.choice([0, 1, 2, 3, 5, 9]))]
        if known and rng.random() < 0.5:
            turns = list(rng.choice(known))[: rng.choice([2, 4, 99])] + turns[: rng.randrange(3)]
        known.append(turns)
        places = list(range(len(turns)))
        if rng.random() < 0.1 and places:
            places[0] = None
        rows += [(c, p, r, t) for p, (r, t) in zip(places, turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,light", [(1, 50_000), (2, 3), (3, 1)])
def test_equals_a_trie_of_tuples(spark, seed, light):
    rows = conversations(seed)
    path = conversation_trie.paths(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = collections.Counter(map(tuple, conversation_trie.trie(path, light=light).collect()))
    assert got == by_hand(rows)


def test_long_and_hot_conversations(spark):
    rows = [(c, i, "user", f"turn {i}") for c in (3, 4, 9) for i in range(300)]
    rows += [(c, i, "user", t) for c in range(1_000, 1_200) for i, t in enumerate(["same", "first", "words"])]
    rows += [(c, i, "user", t) for c in range(2_001, 2_100) for i, t in enumerate(["same", "first", f"other {c}"])]
    path = conversation_trie.paths(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert collections.Counter(map(tuple, conversation_trie.trie(path, light=50).collect())) == by_hand(rows)


def test_odd_rows_and_empty_tables(spark):
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, None, None, None), (5, 1, "a", "tie"), (5, 1, "a", "tied"), (5, 1, "B", "x"),
            (-20, 0, "user", "negative id"), (-20, 1, "user", "two"), (40, 0, "user", "é " * 5_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "depth", "base", "h", "words")})
    assert collections.Counter(map(tuple, conversation_trie.trie(conversation_trie.paths(df)).collect())) == by_hand(rows)
    assert conversation_trie.trie(conversation_trie.paths(df.filter("false"))).count() == 0
