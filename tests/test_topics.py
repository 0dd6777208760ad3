import itertools
import math

import numpy as np
import pytest
from plans import plan_of
from pyspark.sql import functions as F

from logvane.operators import density, embed, graph, keywords
from logvane.plans import topics as T
from logvane.plans.topics import save_topics, topic_overview, topic_stage
from logvane.streaming.events import assign_to_table


def brute_components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in parent}


@pytest.mark.parametrize(
    "pairs",
    [
        [(i, i + 1) for i in range(60)],  # a long path
        [(0, i) for i in range(1, 200)] + [(500, 501)],  # a hub
        [(i, j) for i, j in itertools.combinations(range(12), 2)] + [(20, 21), (22, 21), (11, 30)],
        [(5, 5)],
    ],
)
def test_components(spark, pairs):
    edges = spark.createDataFrame(pairs, "a long, b long")
    found = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert found == brute_components([p for p in pairs if p[0] != p[1]])


def brute_clusters(points, width, min_size):
    """(key, vector, weight) to topic, by the definition in the operator's docstring."""
    cells = {}
    for key, vector, weight in points:
        cell = cells.setdefault(tuple(math.floor(x / width) for x in vector), [0, key])
        cell[0] += weight
        cell[1] = min(cell[1], key)

    def near(cell):
        for axis in range(len(cell)):
            for step in (-1, 1):
                other = cell[:axis] + (cell[axis] + step,) + cell[axis + 1:]
                if other in cells:
                    yield other

    core = {c for c in cells if cells[c][0] + sum(cells[n][0] for n in near(c)) >= min_size}
    label = brute_components([(c, c) for c in core] + [(c, n) for c in core for n in near(c) if n in core])
    for c in set(cells) - core:
        around = [n for n in near(c) if n in core]
        if around:
            label[c] = label[max(around, key=lambda n: (cells[n][0], -cells[n][1]))]
    groups = {}
    for c, root in label.items():
        group = groups.setdefault(root, [0, cells[c][1]])
        group[0] += cells[c][0]
        group[1] = min(group[1], cells[c][1])
    kept = sorted((r for r in groups if groups[r][0] >= min_size), key=lambda r: (-groups[r][0], groups[r][1]))
    number = {r: i for i, r in enumerate(kept)}
    return {
        key: number.get(label.get(tuple(math.floor(x / width) for x in vector)), -1) for key, vector, weight in points
    }


@pytest.mark.parametrize("dimensions", [2, 3])
def test_clusters_equal_the_definition(spark, dimensions):
    rng = np.random.default_rng(dimensions)
    centers = [[0] * dimensions, [6] * dimensions, [0] * (dimensions - 1) + [9]]
    points = []
    for key in range(400):
        middle = centers[key % 3] if key % 4 else rng.uniform(-15, 15, dimensions)
        points.append((key, [float(x) for x in rng.normal(middle, 0.8)], int(rng.integers(1, 4))))
    df = spark.createDataFrame(points, "doc_id long, vector array<double>, weight int")
    found = {r["doc_id"]: r["topic"] for r in density.density_clusters(df, dimensions, 1.0, 10).collect()}
    assert found == brute_clusters(points, 1.0, 10)
    assert -1 in found.values() and len(set(found.values())) >= 3


def test_one_heavy_point_is_a_cluster_of_its_own(spark):
    df = spark.createDataFrame([(1, [0.1, 0.1], 5000), (2, [50.0, 50.0], 3)], "doc_id long, vector array<double>, weight int")
    assert {r["doc_id"]: r["topic"] for r in density.density_clusters(df, 2, 1.0).collect()} == {1: 0, 2: -1}


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta alpha beta"), (3, ""), (4, "gamma")], "id long, t string")
    rows = {r["id"]: np.array(r["embedding"]) for r in embed.embed(df, "t", dimensions=32).collect()}
    assert rows[1] == pytest.approx(rows[2]) and np.linalg.norm(rows[1]) == pytest.approx(1.0)
    assert not rows[3].any() and np.linalg.norm(rows[4]) == pytest.approx(1.0)


def test_own_embedder(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    assert embed.embed(df, "t", embedder=lambda c: F.array(F.length(c).cast("double"))).first()["embedding"] == [3.0]


def test_keyword_weights(spark):
    docs = spark.createDataFrame(
        [(0, ["red", "red", "box"]), (1, ["blue", "box"]), (1, ["red"])], "topic int, tokens array<string>"
    )
    found = {(r["topic"], r["term"]): r["weight"] for r in keywords.term_weights(keywords.term_counts(docs)).collect()}
    # kept: red (3) and box (2), found in both topics; lengths 3 and 2
    assert found == pytest.approx({
        (0, "red"): 2 / 3 * math.log(1 + 2.5 / 3), (0, "box"): 1 / 3 * math.log(1 + 2.5 / 2),
        (1, "red"): 1 / 2 * math.log(1 + 2.5 / 3), (1, "box"): 1 / 2 * math.log(1 + 2.5 / 2),
    })


def test_topic_stage(spark, tmp_path):
    kinds = ["network connection opened port", "registry value changed policy", "remote thread created process"]
    rows = [(i, f"{kinds[i % 3]} {i} 0x{i:x}", "a.exe", None) for i in range(300)]
    rows += [(1000 + i, word, "b.exe", None) for i, word in enumerate(["zebra quokka", "violin concerto"])]
    events = spark.createDataFrame(rows, "event_key long, message string, image_base string, target_object string")
    found, weights, docs = topic_stage(events)
    assert found.count() == len(rows) and docs.count() == 5, "repeats are embedded once"
    topics = {}
    for r in found.collect():
        topics.setdefault(r["event_key"] % 3 if r["event_key"] < 1000 else "rare", set()).add(r["topic"])
    assert all(len(topics[k]) == 1 for k in (0, 1, 2))
    assert len({min(topics[k]) for k in (0, 1, 2)}) == 3 and -1 not in topics[0]
    assert topics["rare"] == {-1}
    assert found.filter("topic = -1 AND topic_keywords <> 'unknown'").count() == 0
    assert topic_overview(found).count() == 3
    save_topics(weights, docs, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "centroids")).count() == 4


EVENT_SCHEMA = "event_key long, message string, image_base string, target_object string"
KINDS = ["network connection opened port", "registry value changed policy", "remote thread created process"]


def _events(spark, keys, tail=""):
    rows = [(i, f"{KINDS[i % 3]} {'alpha beta gamma delta epsilon'.split()[i % 5]}{tail} {i}", "a.exe", None) for i in keys]
    return spark.createDataFrame(rows, EVENT_SCHEMA)


@pytest.mark.parametrize("method", ["grid", "hierarchy"])
def test_a_stored_model_gives_the_topics_of_its_run(spark, tmp_path, method):
    events = _events(spark, range(300))
    run = T.fit_topics(events, method=method, min_size=15)
    path = str(tmp_path / "model")
    assert T.latest_version(spark, path) is None
    with pytest.raises(FileNotFoundError):
        T.load_model(spark, path)
    assert T.save_model(run, path) == 1
    model = T.load_model(spark, path)
    shown = ["event_key", "topic", "topic_prob", "topic_keywords"]
    again = T.assign_topics(run.events, model)
    assert sorted(map(tuple, again.select(*shown).collect())) == sorted(map(tuple, run.events.select(*shown).collect()))
    assert {r["model_version"] for r in again.collect()} == {1}

    # texts that the run has not seen take the topic with the nearest centroid, or none
    new = T.assign_topics(_events(spark, range(30), tail=" omega").unionByName(spark.createDataFrame([(99, "zebra quokka violin", "z.exe", None)], EVENT_SCHEMA)), model)
    got = {r["event_key"]: r for r in new.collect()}
    assert len(got) == 31 and got[99]["topic"] == -1
    assert all(got[k]["topic"] == -1 or 0 < got[k]["topic_prob"] <= 1 for k in got)


def test_streamed_topics_equal_the_batch_and_follow_new_versions(spark, tmp_path):
    path, landing, out = str(tmp_path / "model"), str(tmp_path / "in"), str(tmp_path / "out")
    first = _events(spark, range(150))
    T.save_model(T.fit_topics(first, min_size=10), path)
    stream = lambda: assign_to_table(spark.readStream.schema(EVENT_SCHEMA).parquet(landing), path, out, str(tmp_path / "state")).awaitTermination()
    first.write.parquet(landing)
    stream()
    shown = ["event_key", "topic", "topic_prob", "topic_keywords", "model_version"]
    rows = lambda df: sorted(map(str, df.select(*shown).collect()))
    assert rows(spark.read.parquet(out)) == rows(T.assign_topics(first, T.load_model(spark, path)))
    # a second version is taken up when the stream goes on, and what was written stays
    more = _events(spark, range(200, 320), tail=" sigma")
    assert T.save_model(T.fit_topics(more, min_size=10), path) == 2
    more.write.mode("append").parquet(landing)
    stream()
    assert rows(spark.read.parquet(out).filter("model_version = 2")) == rows(T.assign_topics(more, T.load_model(spark, path)))
    assert rows(spark.read.parquet(out).filter("model_version = 1")) == rows(T.assign_topics(first, T.load_model(spark, path, 1)))


def test_vectors_hash_each_word_of_a_batch_once(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["b", "a", "é", "a"]), (2, []), (3, None), (4, ["a"] * 500)], "id int, tokens array<string>")
    vectors = df.select("id", embed.hashed_vector(F.col("tokens"), 16).alias("v"), embed.hashed_slots(F.col("tokens"), 16).alias("s"))
    # Spark's part of the work is no longer one MD5 per token
    assert "md5" not in plan_of(vectors.select("v"))
    for row in vectors.collect():
        counts = np.zeros(16)
        for slot in row["s"] or []:
            counts[abs(slot) - 1] += np.sign(slot)
        assert np.allclose(row["v"], counts / (np.linalg.norm(counts) or 1.0))


def test_terms_are_counted_by_task_in_bounded_pieces(spark, monkeypatch):
    # F13, F16: a row for every word and pair of every document went through the engine
    rows = [("a", ["x", "y", "x", "y"], 2), ("a", ["x"], 1), (None, ["y", "x"], 3), ("b", [], 1), ("b", None, 1), ("b", ["x", "y", "z"], 4)] * 40
    docs = spark.createDataFrame(rows, "topic string, tokens array<string>, w int").repartition(3)
    plain = {}
    for topic, words, w in rows:
        for term in [*(words or []), *map(" ".join, zip(words or [], (words or [])[1:]))]:
            plain[topic, term] = plain.get((topic, term), 0) + w
    for together, held in ((2_000_000, 1_000_000), (3, 2)):
        monkeypatch.setattr(keywords, "WORDS_TOGETHER", together)
        monkeypatch.setattr(keywords, "TERMS_HELD", held)
        partial = keywords.partial_counts(docs, weight="w")
        assert partial.count() < (40 if held > 2 else 400)
        assert {(r["topic"], r["term"]): r["n"] for r in keywords.term_counts(docs, weight="w").collect()} == plain


@pytest.mark.parametrize("together, held, buckets", [(2_000_000, 1_000_000, 1 << 40), (3, 2, 1), (7, 20, 40)])
def test_terms_of_several_topics_meet_in_buckets(spark, monkeypatch, together, held, buckets):
    # every term of every topic was spelt out, shuffled and stored, most of them to be thrown away
    rows = [("a", ["x", "y", "x", "y", "é"], 2), ("a", ["x"], 1), (None, ["y", "x"], 3), ("b", [], 1), ("b", None, 1), ("b", ["x", "y", "z"], 4)]
    # a word with a blank is the same term as the pair of its parts
    rows = [*rows * 9, ("c", ["x y", "", "z", "q"], 1), ("d", ["", "z q"], 5), ("d", ["only", "here"], None)]
    docs = spark.createDataFrame(rows, "source string, tokens array<string>, w int").repartition(3)
    plain = {}
    for topic, words, w in rows:
        for term in [*(words or []), *map(" ".join, zip(words or [], (words or [])[1:]))] if w else []:
            plain[topic, term] = plain.get((topic, term), 0) + w
    monkeypatch.setattr(keywords, "WORDS_TOGETHER", together)
    monkeypatch.setattr(keywords, "TERMS_HELD", held)
    monkeypatch.setattr(keywords, "BUCKET_BYTES", buckets)
    monkeypatch.setattr(keywords, "MOST_BUCKETS", 5)
    spread = {}
    for (topic, term), n in plain.items():
        spread.setdefault(term, []).append(n)
    expected = {(*key, n, len(spread[key[1]]), sum(spread[key[1]])) for key, n in plain.items() if len(spread[key[1]]) >= 2}
    counts = keywords.term_counts(docs, "source", weight="w", min_topics=2)
    assert counts.columns == ["source", "term", "n", "topics", "total"]
    found = [tuple(r) for r in counts.collect()]
    assert len(found) == len(expected) and set(found) == expected
    weights = lambda c, **how: {(r["source"], r["term"]): r["weight"] for r in keywords.term_weights(c, "source", **how).collect()}
    every = keywords.term_counts(docs, "source", weight="w")
    for how in ({}, {"min_topics": 3}, {"max_terms": 4}):
        assert weights(counts, **how) == pytest.approx(weights(every, **how))
    assert keywords.term_counts(docs.filter("false"), "source", min_topics=2).count() == 0
