"""Joins, decontamination, packing, archives and the language model against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from plans import plan_of
from pyspark.sql import functions as F

from logvane.llm import attention_lm, bin_completion, secret_lexer, simhash_windows, trie_join, warc_revisit
from logvane.llm.queries import tokenizer_path
from logvane.llm.subword import Subwords, forget, subwords

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- set join


def grams(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def near_copies(seed):
    rng = random.Random(seed)
    words, texts = [f"w{i}" for i in range(300)], []
    for _ in range(8):
        base = rng.choices(words, k=rng.choice([12, 40, 90, 200]))
        for _ in range(rng.choice([1, 2, 5, 60])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(" ".join(text))
    texts += ["", None, "  ", "a", "A", "a b", "A\tB", "x y z"] + ["p q r s t u v w x y z a b c d e f g " + f"u{i}" for i in range(55)]
    rng.shuffle(texts)
    return texts


def links_by_hand(texts, k, percent):
    sets, parent, links = [grams(t, k) for t in texts], list(range(len(texts))), collections.Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links.update([i, j])
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(len(sets[i]), root(i), links[i]) for i in range(len(texts))]


@pytest.mark.parametrize("k, percent, block", [(3, 90, 4_000), (5, 80, 9)])
def test_components_against_all_pairs(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(trie_join, "BLOCK", block)
    texts = near_copies(k)
    expected = links_by_hand(texts, k, percent)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = trie_join.join_components(df, size=k, percent=percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in rows) == [(i, *e) for i, e in enumerate(expected)]
    kept = trie_join.keep_one(df, size=k, percent=percent).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({e[1] for e in expected})


def test_trie_against_intersections():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(80) > drop], rng.integers(0, 1 << 60, extra).astype(np.uint64)]))
            for drop, extra in [(0.0, 0), (0.02, 1), (0.05, 2), (0.3, 5), (0.0, 0), (0.9, 70)] * 4]
    for percent in (50, 80, 90):
        for s, found in zip(sets, trie_join.trie_links(sets, sets, percent)):
            expected = [j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= percent * len(np.union1d(s, t))]
            assert found.tolist() == expected


def test_sizes_that_just_link():
    for percent in (80, 90):
        for a in range(1, 60):
            for b in range(a, 60):
                need = trie_join.least_overlap(a, b, percent)
                assert 100 * need >= percent * (a + b - need) and not 100 * (need - 1) >= percent * (a + b - need + 1)
                if need <= a:
                    assert a - need < trie_join.prefix_length(a, percent) and b - need < trie_join.prefix_length(b, percent)


def clashing(df):
    """The table with columns named like those used inside the stages."""
    names = ["_id", "_key", "_text_key", "member_id", "member_text_key", "hit_key", "hit_text_key", "key", "n", "component", "stays", "_s", "redacted_text"]
    return df.select("*", *[F.lit(name).alias(name) for name in names])


def test_stages_take_columns_with_names_used_inside(odd, spark):
    df = clashing(odd)
    bench = spark.createDataFrame([(1, "the same text twice"), (3, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7")], "item_id long, text string")
    for stage in (trie_join.keep_one, secret_lexer.redact, lambda t: simhash_windows.decontaminate(t, bench)):
        out, plain = stage(df), stage(odd)
        assert out.columns == df.columns and out.filter("member_id = 'member_id' and _key = '_key'").count() == plain.count() > 0
    assert trie_join.join_components(df).count() == odd.count() and simhash_windows.verdicts(df, bench).count() == odd.count()


def test_join_of_odd_rows(odd, none, spark):
    rows = trie_join.join_components(odd).collect()
    assert len(rows) == odd.count()
    copies = [r for r in rows if r["doc_id"] in (6, 7)]
    assert len(copies) == 4 and {(r["component_id"], r["n_links"]) for r in copies} == {(6, 3)}
    assert {(r["component_id"], r["n_links"]) for r in rows if r["n_shingles"] == 0 and r["doc_id"] == 1} == {(1, 0)}
    kept = trie_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["0", "1", "2", "None", "4", "5", "6", "8"])
    assert trie_join.join_components(none).count() == 0 and trie_join.keep_one(none).count() == 0


# ---- decontamination

FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def five(text):
    words = FOLDED.findall((text or "").lower())
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def similarity_by_hand(text, items, item):
    df = collections.Counter(x for t in items.values() for x in set(five(t)))
    n = sum(1 for t in items.values() if five(t))
    weight = {x: math.log1p(n / c) for x, c in df.items()}
    own, seen, size = set(five(items[item])), five(text), len(five(items[item]))
    best = 0.0
    for a in range(max(1, len(seen) - size + 1)) if own else []:
        window = set(seen[a : a + size])
        both = sum(weight[x] for x in window & own)
        best = max(best, both / (sum(weight[x] for x in own) + len(window - own) * math.log1p(n)))
    return best


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("an", "er", "is", "ot", "ul", "em")]
    say = lambda n: rng.choices(words, k=n)
    items = {i: " ".join(say(rng.randint(14, 60))) for i in range(30)}
    items |= {30: "too short here", 31: None, 32: items[0], 33: "", 34: items[1] + " " + " ".join(say(2))}
    texts = []
    for i in range(30):
        copy = items[i].split()
        if i % 3 == 1:
            copy[len(copy) // 2] = "changed"
        if i % 3 == 2:
            copy[0], copy[-1] = copy[0].upper() + ",", copy[-1] + "!"
        texts.append(" ".join(say(rng.randint(0, 80)) + copy + say(rng.randint(0, 80))))
        texts.append(" ".join(say(100) + items[i].split()[: len(items[i].split()) // 3] + say(50)))
    texts += [None, "", items[2], items[2], "x " * 3_000 + items[3], " ".join(say(20_000)) + " " + items[4]]
    return texts, items


def test_windows_against_all_windows(spark, planted):
    texts, items = planted
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in simhash_windows.matches(docs, bench).collect()}
    inverse = collections.defaultdict(set)
    for i, t in items.items():
        for x in five(t):
            inverse[x].add(i)
    expected = {}
    for d, t in enumerate(texts):
        for i in set().union(*[inverse[x] for x in set(five(t)) & inverse.keys()] or [set()]):
            if (s := similarity_by_hand(t, items, i)) >= 0.8:
                expected[d, i] = s
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)
    clean = simhash_windows.decontaminate(docs, bench)
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in expected}


def test_decontamination_of_odd_and_empty_tables(spark, odd, none, planted):
    bench = spark.createDataFrame([(1, "the same text twice"), (2, None), (3, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7")], "item_id long, text string")
    out = simhash_windows.decontaminate(odd, bench)
    assert out.columns == odd.columns and sorted(str(r["doc_id"]) for r in out.collect()) == sorted(["0", "1", "2", "None", "4", "6", "6", "6", "7", "8"])
    assert simhash_windows.decontaminate(none, bench).count() == 0
    assert simhash_windows.decontaminate(odd, bench.filter("false")).count() == odd.count()
    assert simhash_windows.verdicts(odd, bench).count() == odd.count()


def test_all_fingerprints_in_the_radius_share_a_block():
    rng = random.Random(0)
    width = 128 // simhash_windows.BLOCKS
    for _ in range(200):
        flipped = rng.sample(range(128), simhash_windows.RADIUS)
        least = min(collections.Counter({i: 0 for i in range(simhash_windows.BLOCKS)} | collections.Counter(b // width for b in flipped)).values())
        assert least <= simhash_windows.RADIUS // simhash_windows.BLOCKS == 3  # two bits filed, one looked up


# ---- packing


def test_ids_equal_the_tokenizer(odd):
    own = Subwords(tokenizer_path())
    texts = [r["text"] or "" for r in odd.collect()] + [
        "It's <|endoftext|> Ünḯ x y ² ½ ªº µ don't\x0bcan\x0cWON'T 12345 __a-b__ \x1c \x85\xa0 a İstanbul ΣΑΣ 漢字 😀", "Straße ÀÉÎÕÜÝÞß ÿ ×÷ «q»", "é x́",
    ]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_completion_against_all_fillings():
    rng = random.Random(5)
    for _ in range(60):
        room = rng.randint(1, 24)
        counts = np.zeros(40, np.int64)
        for length in rng.sample(range(1, 30), rng.randint(1, 6)):
            counts[length] = rng.randint(1, 3)
        sums = {0}
        for length, n in enumerate(counts.tolist()):
            sums |= {s + length * m for s in sums for m in range(n + 1) if s + length * m <= room}
        filling = bin_completion.completion(counts, room)
        assert sum(filling) == max(sums) and all(filling.count(x) <= counts[x] for x in filling)


def check_packing(rows, texts, capacity):
    own = Subwords(tokenizer_path())
    for doc_id, text in texts.items():
        ids = own.encode(text or "") + bin_completion.CLOSING
        pieces = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids) // 4, capacity))
        for r in pieces:
            part = ids[4 * r["start"] : 4 * (r["start"] + r["length"])]
            assert len(part) == 4 * r["length"] and zlib.crc32(part) == r["ids_crc32"]
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_is_whole_gapless_and_tight(spark, monkeypatch):
    monkeypatch.setattr(bin_completion, "RANKED_TOGETHER", 7)
    rng = random.Random(6)
    texts = {i: " ".join(rng.choices(["word", "an", "it"], k=rng.choice([0, 3, 9, 9, 9, 30, 70, 150]))) for i in range(400)}
    texts[400] = None
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = bin_completion.pack(bin_completion.cut(df, tokenizer_path(), capacity=64), capacity=64).collect()
    bound = -(-sum(r["length"] for r in rows) // 64)
    assert bound <= check_packing(rows, texts, 64) <= bound + 2


def test_tokenizers_are_forgotten():
    own = subwords(tokenizer_path())
    assert subwords(tokenizer_path()) is own
    forget()
    assert subwords(tokenizer_path()) is not own


def test_texts_are_encoded_once(odd):
    assert plan_of(bin_completion.cut(odd, tokenizer_path())).count("ArrowEvalPython") == 1


def test_packing_odd_and_empty_tables(odd, none):
    rows = bin_completion.pack(bin_completion.cut(odd, tokenizer_path()))
    got = rows.collect()
    assert sum(r["piece"] == 0 for r in got) == odd.count() and {r["length"] for r in got if r["doc_id"] in (0, 1, 2)} == {1}
    assert bin_completion.pack(bin_completion.cut(none, tokenizer_path())).count() == 0


# ---- archives


def test_archives_round_trip(spark):
    big, odd_payload = "x" * 1_200, "y\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é漢😀" * 400
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (9, None, big), (2, "http://b", "small"), (3, "http://c", "small"), (4, "u\r\nv", None),
            (6, "http://d", odd_payload), (7, "http://e", odd_payload), (7, "http://e", odd_payload), (None, "http://f", big), (8, "http://g", "é" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = warc_revisit.write_archives(pages, "page_id", "url", "html", "2025-01-01T00:00:00Z")
    records = warc_revisit.read_archives(spark, path).cache()
    payloads = sorted((r["record_key"], bytes(r["payload"])) for r in records.filter("record_type = 'response'").collect())
    assert payloads == sorted((str(k), (h or "").encode()) for k, _, h in rows if k in (9, 2, 3, 4, 8) or (k, h) == (7, odd_payload))
    got = collections.Counter(tuple(r) for r in warc_revisit.with_originals(records).select(
        "record_key", "record_type", "payload_bytes", "payload_digest", "refers_to").collect())
    expected = collections.Counter()
    for k, _, h in rows:
        raw, top = (h or "").encode(), {big: 9, odd_payload: 7}.get(h, k)
        kind = "response" if k == top else "revisit"
        expected[None if k is None else str(k), kind, len(raw), hashlib.sha1(raw).hexdigest(), None if k == top else str(top)] += 1
    assert got == expected
    assert records.filter("uri = 'u%0Av'").count() == 1


def test_empty_archives(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = warc_revisit.write_archives(pages, "page_id", "url", "html", "2025-01-01T00:00:00Z")
    assert warc_revisit.read_archives(spark, path).count() == 0


def test_a_cut_archive_is_an_error():
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 90\r\n\r\nshort\r\n\r\n"
    with pytest.raises(ValueError, match="ends inside"):
        list(warc_revisit.parse(gzip.compress(record)))


def test_blocks_that_end_around_the_end_of_a_part(monkeypatch):
    import gzip

    monkeypatch.setattr(warc_revisit, "PART_BYTES", 1000)
    for total in range(985, 1015):
        records = []
        for n in (total, 3, 900, 0):
            head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {{n}}\r\n\r\n"
            body = n - len(head.format(n=n)) if n == total else n
            records.append((head.format(n=body) + "z" * body + "\r\n\r\n", body))
        got = list(warc_revisit.parse(gzip.compress("".join(r for r, _ in records).encode())))
        assert [len(block) for _, block in got] == [n for _, n in records], total


def test_large_payloads_get_archives_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(warc_revisit, "BYTES_PER_FILE", 20_000_000)
    rows = [(i, f"http://p/{i}", ("é" * 40_000 if i % 10 == 0 else "small") + str(i)) for i in range(600)] + [(700, "u", "L" * 9_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = warc_revisit.write_archives(pages, "page_id", "url", "html", "2025-01-01T00:00:00Z")
    records = warc_revisit.read_archives(spark, path)
    got = {int(r["record_key"]): r["payload_digest"] for r in records.select("record_key", "payload_digest").collect()}
    assert got == {k: hashlib.sha1(h.encode()).hexdigest() for k, _, h in rows}
    sizes = warc_revisit.read_archives(spark, path, payloads=False).groupBy(warc_revisit.F.input_file_name().alias("f")).agg(
        warc_revisit.F.sum("payload_bytes").alias("n")).collect()
    assert sum(r["n"] for r in sizes) == sum(len(h.encode()) for _, _, h in rows)


# ---- language model


def test_gradient_and_normal_probabilities():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 1_000, (2, attention_lm.VOCABULARY))
    model = attention_lm.new_model(ids, rng.random(attention_lm.VOCABULARY) < 0.4)
    for place in (0, 1):
        assert np.allclose(np.bincount(model.of_class, np.exp(model.within[place]), attention_lm.CLASSES), 1)
    x, following, there = attention_lm.windows_of(rng.integers(0, attention_lm.VOCABULARY, 150), model.row)
    assert there.sum() == 151  # every id and the end, once
    vector = model.vector.astype(float)
    loss = lambda: attention_lm.gradient(attention_lm.parameters(vector), x, model.of_class[following], there)
    exact = loss()[0]
    for i in rng.choice(np.flatnonzero(exact), 25, replace=False):
        vector[i] += 1e-4
        up = loss()[1]
        vector[i] -= 2e-4
        down = loss()[1]
        vector[i] += 1e-4
        assert exact[i] == pytest.approx((up - down) / 2e-4, rel=1e-3, abs=1e-8)


def test_overlapping_windows_score_like_single_places():
    rng = np.random.default_rng(2)
    model = attention_lm.new_model(rng.integers(0, 50, (2, attention_lm.VOCABULARY)), rng.random(attention_lm.VOCABULARY) < 0.5)
    ids = rng.integers(0, attention_lm.VOCABULARY, 200)
    total, stream = 0.0, np.append(ids, attention_lm.END)
    rows = np.concatenate([[0], model.row[ids]])
    for t, target in enumerate(stream):
        step = attention_lm.WINDOW - attention_lm.CONTEXT
        begin = 0 if t < 64 else step * ((t - attention_lm.CONTEXT) // step)
        x = np.zeros((1, 64), np.int64)
        part = rows[begin : t + 1]
        x[0, : len(part)] = part
        logits = attention_lm._forward(attention_lm.parameters(model.vector), x)[0][0, t - begin].astype(float)
        opens = int(t == 0 or model.ends[stream[t - 1]])
        c = model.of_class[target]
        total += logits[c] - np.log(np.exp(logits).sum()) + model.within[opens, target]
    assert attention_lm.log10_scores(model, [ids, ids[:3]])[0] == pytest.approx(total / np.log(10), rel=1e-5)


@pytest.mark.parametrize("steep", [1, 8])
def test_scores_and_losses_equal_the_plain_pass(steep):
    rng = np.random.default_rng(3)
    model = attention_lm.new_model(rng.integers(0, 50, (2, attention_lm.VOCABULARY)), rng.random(attention_lm.VOCABULARY) < 0.5)
    model.vector *= np.float32(steep)  # the steep one has exponents beyond 32-bit numbers
    w, space, scorer = attention_lm.parameters(model.vector), attention_lm._Space(), attention_lm._Scorer(model)
    assert (scorer.sharpest > attention_lm.EXP_LIMIT) == (steep > 1)
    for size in (700, 40, 900):  # buffers of one batch are taken again by smaller and larger ones
        x, following, there = attention_lm.windows_of(rng.integers(0, attention_lm.VOCABULARY, size), model.row)
        target = model.of_class[following]
        logits = attention_lm._forward(w, x)[0].astype(float)
        logits -= logits.max(-1, keepdims=True)
        plain = np.take_along_axis(logits - np.log(np.exp(logits).sum(-1, keepdims=True)), target[..., None], -1)[..., 0]
        for skip in (0, attention_lm.CONTEXT):
            assert np.allclose(scorer(x, target, skip), plain[:, skip:], rtol=1e-3, atol=1e-3)
        shared, loss = attention_lm.gradient(w, x, target, there, space)
        assert loss == pytest.approx(-plain[there].mean(), rel=1e-3)
        assert np.array_equal(shared, attention_lm.gradient(w, x, target, there)[0]) and np.isfinite(shared).all()


def test_two_matrices_give_scores_and_values():
    w = attention_lm.parameters(np.random.default_rng(4).normal(0, 1, attention_lm.SIZE))
    h, width = w["e"][:50], attention_lm.WIDTH
    side = h @ attention_lm._side_by_side(w)
    assert side.shape == (50, 2 * width)  # before, keys and outputs had products of their own
    assert np.allclose(side[:, :width] @ h.T, (h @ w["q"]) @ (h @ w["k"]).T / width**0.5)
    assert np.allclose(side[:, width:], h @ w["v"] @ w["o"])


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(7)
    words = ["the", "a", "runs", "dog", "cat", "sees", "House", "Élan"]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(0, 40))) for i in range(120)}
    texts |= {120: None, 121: "", 122: " \n", 123: "unseen " * 300}
    return texts, spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4).cache()


def test_base_scores_against_counts(spoken, monkeypatch):
    texts, df = spoken
    monkeypatch.setattr(attention_lm, "HELD_WORDS", 3)  # most words take the shuffle
    counts, model = attention_lm.fit(df.filter("doc_id < 100"), tokenizer_path())
    words = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in texts.items()}
    seen = collections.Counter(w for i, ws in words.items() if i < 100 for w in ws)
    n, v = sum(seen.values()), len(seen)
    rows = attention_lm.score(df, counts, model, tokenizer_path()).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        own = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(seen[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert r["score"] < 0 and math.isfinite(r["score"])
    # what was heard is likelier than what was not, per id
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[123] / 300 < sum(by_id[i] / max(1, len(words[i])) for i in range(100, 120)) / 20


def test_every_training_text_is_learned_from(spoken, spark):
    texts, df = spoken
    parts = [[r["text"] for r in part.collect()] for part in attention_lm.parts_of(df)]
    assert collections.Counter(t for part in parts for t in part) == collections.Counter(texts.values())
    copies = spark.range(1_000).selectExpr("id as doc_id", "'one text' as text")
    assert min(part.count() for part in attention_lm.parts_of(copies)) > 400 * 2 / attention_lm.ROUNDS
    model = attention_lm.new_model(np.ones((2, attention_lm.VOCABULARY)), attention_lm.word_ends(tokenizer_path()))
    for word in ("dog", "cat", "house", "runs"):
        alone = spark.createDataFrame([(f"the {word} sees",)], "text string")
        assert (attention_lm.train(alone, model, tokenizer_path()).vector != model.vector).any(), word


def test_stored_ids_are_what_is_learned_from_and_scored(spoken):
    _, df = spoken
    coded = attention_lm.encoded(df, tokenizer_path())
    fits = [attention_lm.fit(t, tokenizer_path()) for t in (df, coded)]
    assert np.array_equal(fits[0][0].ids, fits[1][0].ids)
    counts, model = fits[1]
    # ids are not made again: with other words beside them the scores stay
    scores = [{r["doc_id"]: r["score"] for r in attention_lm.score(t, counts, model, tokenizer_path()).collect()}
              for t in (df, coded.withColumn("text", F.lit("dog")))]
    assert scores[0] == pytest.approx(scores[1])


def test_model_without_training_and_odd_rows(odd, none):
    counts, model = attention_lm.fit(none.select("text"), tokenizer_path())
    rows = attention_lm.score(odd, counts, model, tokenizer_path()).collect()
    assert len(rows) == odd.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in rows)
    assert attention_lm.score(none, counts, model, tokenizer_path()).count() == 0
