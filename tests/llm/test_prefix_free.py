"""Removal of repeated passages against a scan of all passages."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logvane.llm import prefix_free, text as text_module
from logvane.llm.text import Texts


def by_hand(rows, length=prefix_free.LENGTH):
    """Key, bytes, removed, runs and what is kept, per distinct document; documents in order."""
    seen, found = set(), []
    for key, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            passage = raw[i : i + length]
            if passage in seen:
                gone[i : i + length] = True
            seen.add(passage)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        found.append((key, len(raw), int(gone.sum()), runs, bytes(b for b, g in zip(raw, gone) if not g)))
    return found


def corpus(seed):
    rng = random.Random(seed)
    words = [f"wörd{i}" if i % 7 == 0 else f"term{i}" for i in range(400)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    common, shared = line(18), [line(rng.choice([12, 15, 30, 80])) for _ in range(6)]
    texts = [None, "", "short", "a" * 99, "a" * 100, "b" * 700, "ab" * 300, "b" * 350, line(4_000)]
    for _ in range(70):
        parts = [line(rng.randrange(1, 40))]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice([common, *shared]), line(rng.randrange(3))]
        texts.append("\n".join(parts))
    texts += rng.choices(texts, k=12)
    for t in rng.choices([t for t in texts if t and len(t) > 300], k=25):
        at = rng.randrange(len(t))
        texts.append(t[:at] + rng.choice(["", "x", "é"]) + t[at + 1 :])
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,split", [(1, 20_000), (2, 3)])
def test_equals_a_scan(spark, monkeypatch, seed, split):
    monkeypatch.setattr(prefix_free, "TOGETHER", 40)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = prefix_free.remove_repeats(df, split=split).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == sorted(by_hand(rows))


@pytest.mark.parametrize("length,width", [(100, 32), (40, 8), (33, 32), (64, 64)])
def test_equal_passages_get_equal_triggers_and_every_passage_a_phrase(length, width):
    texts = [(t or "").encode() for _, t in corpus(3)]
    whole = Texts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    trigger_of, count = {}, 0
    for number, start, n, trigger, _ in prefix_free.parse(whole, length, width):
        for d, s, m, t in zip(number, start, n, trigger):
            for i in range(s, s + m):
                assert trigger_of.setdefault(texts[d][i : i + length], t) == t
                assert len(texts[d][i : i + length]) == length
            count += m
    assert count == sum(max(len(t) - length + 1, 0) for t in texts)


def test_suffix_array_is_sorted_to_its_length():
    data = np.frombuffer(bytes(random.Random(4).choices(b"ab", k=3_000)), np.uint8)
    starts = np.arange(0, 2_980)
    order, same = prefix_free.suffix_array(data, starts, 20)
    raw = data.tobytes()
    suffixes = [raw[i : i + 20] for i in order]
    assert suffixes == sorted(suffixes)
    assert same.tolist() == [False, *(a == b for a, b in zip(suffixes, suffixes[1:]))]


def test_long_texts_in_slices(spark, monkeypatch):
    monkeypatch.setattr(prefix_free, "CHUNK_BYTES", 500)
    rng = random.Random(5)
    part = "".join(rng.choices("abcdefgh ", k=1_700))
    rows = [(1, part + "".join(rng.choices("xyz", k=333)) + part[100:900]), (2, "q" * 77 + part[50:1_500] + "tail")]
    monkeypatch.setattr(text_module, "CHUNK_BYTES", 500)
    parsed = list(prefix_free.parse(Texts(np.frombuffer(rows[0][1].encode(), np.uint8), np.array([0, len(rows[0][1])]))))
    assert len(parsed) > 1 and sum(int(n.sum()) for _, _, n, _, _ in parsed) == len(rows[0][1]) - 99
    got = prefix_free.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == by_hand(rows)


def test_odd_and_empty_tables(spark, odd, none):
    clashing = odd.withColumns({c: F.lit("clash") for c in [*prefix_free.RESULT, "doc", "key", "start", "c0", "r_doc", "runs", "found"]})
    got = prefix_free.remove_repeats(clashing).collect()
    # rows that repeat key and text are one document; null keys come first
    distinct = sorted({(r["doc_id"], r["text"]) for r in odd.collect()}, key=lambda r: (r[0] is not None, r[0] or 0))
    expected = {r[0]: r[1:] for r in by_hand(distinct)}
    assert len(got) == odd.count()
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == expected[r["doc_id"]] for r in got)
    assert {r["runs"] for r in got} == {"clash"}
    assert prefix_free.remove_repeats(none).count() == 0


def test_query_keeps_its_columns(spark):
    from logvane.llm import queries

    df = queries.op12_prefix_free(spark, "/root/testdata/sf0.001")
    rows = df.collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    expected = {k: (n, gone, runs, hashlib.sha256(kept).hexdigest()) for k, n, gone, runs, kept in by_hand(sorted((r["doc_id"], r["text"]) for r in docs))}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == expected
    assert sum(v[1] for v in expected.values()) > 0
