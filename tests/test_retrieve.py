import math

import numpy as np
import pytest
from plans import plan_of
from pyspark.sql import functions as F

from logvane.functions.text import clean_tokens
from logvane.operators import answers, enrich, retrieve


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    docs = rng.normal(size=(500, 8))
    docs[100:250] = docs[0]  # many equal vectors: ties resolve by id
    rows = [(f"c{i % 3}", i, [float(x) for x in v]) for i, v in enumerate(docs)]
    queries = [(q, [float(x) for x in v]) for q, v in enumerate(np.vstack([docs[0], rng.normal(size=(6, 8))]))]
    return (
        queries, rows,
        spark.createDataFrame(queries, "query_id long, embedding array<double>"),
        spark.createDataFrame(rows, "collection string, doc_id long, embedding array<double>").repartition(5),
    )


def brute(queries, rows, k, metric):
    found = set()
    for q, v in queries:
        for c in ("c0", "c1", "c2"):
            scored = []
            for name, doc, w in rows:
                if name == c:
                    a, b = np.array(v), np.array(w)
                    d = 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b) if metric == "cosine" else np.linalg.norm(a - b)
                    scored.append((round(float(d), 8), doc))
            found |= {(q, c, doc, rank) for rank, (_, doc) in enumerate(sorted(scored)[:k], start=1)}
    return found


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("max_shared", [10_000, 8])
def test_nearest_equals_brute_force(vectors, metric, max_shared, monkeypatch):
    queries, rows, q, d = vectors
    monkeypatch.setattr(retrieve, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(retrieve, "BLOCK_DOCS", 90)
    found = retrieve.nearest(q, d, 4, metric, max_shared=max_shared)
    assert {(r["query_id"], r["collection"], r["doc_id"], r["rank"]) for r in found.collect()} == brute(queries, rows, 4, metric)


def test_fewer_documents_than_k(vectors):
    _, _, q, d = vectors
    few = d.filter("doc_id < 4")
    counts = retrieve.nearest(q, few, 9).groupBy("query_id").count().collect()
    assert {r["count"] for r in counts} == {4}


def test_search_does_not_shuffle_documents(vectors):
    _, _, q, d = vectors
    plan = plan_of(retrieve.nearest(q, d.sparkSession.createDataFrame(d.collect(), d.schema), 3))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("WindowGroupLimit") >= 1


@pytest.mark.parametrize("k", [11, 3])
def test_most_similar(spark, k):
    points = np.random.default_rng(6).normal(size=(11, 3))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "topic int, centroid array<double>")
    found = retrieve.most_similar(df, k=k).collect()
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    similar = unit @ unit.T
    assert len(found) == 11 * k
    for r in found:
        assert r["similarity"] == pytest.approx(similar[r["topic"], r["other_topic"]], abs=1e-9)
        assert r["other_topic"] == np.argsort(-similar[r["topic"]])[r["rank"] - 1]


def test_bm25_equals_the_formula(spark):
    corpus = {"a": "red fox jumps", "b": "red red apple pie", "c": "green pear"}
    tokens = {k: v.split() for k, v in corpus.items()}
    docs = spark.createDataFrame([("x", k, v) for k, v in tokens.items()], "collection string, doc_id string, tokens array<string>")
    queries = spark.createDataFrame([(1, ["red", "pie", "red"])], "query_id long, tokens array<string>")
    candidates = docs.select(F.lit(1).cast("long").alias("query_id"), "collection", "doc_id")
    found = {r["doc_id"]: r["bm25"] for r in retrieve.bm25(candidates, queries, docs, ["collection", "doc_id"]).collect()}
    mean = 3.0

    def expected(doc):
        total = 0.0
        for term in {"red", "pie"}:
            df = sum(term in t for t in tokens.values())
            tf = tokens[doc].count(term)
            idf = math.log(1 + (3 - df + 0.5) / (df + 0.5))
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens[doc]) / mean))
        return total

    assert found == pytest.approx({d: expected(d) for d in corpus})


def test_rerank_keeps_all_unless_told(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (1, "b", 2.0), (1, "c", 0.0)], "query_id long, doc_id string, s double")
    order = [r["doc_id"] for r in retrieve.rerank(df, "s", ["doc_id"]).orderBy("place").collect()]
    assert order == ["b", "a", "c"]
    assert retrieve.rerank(df, "s", ["doc_id"], 1).count() == 1


@pytest.mark.parametrize(
    "meta, tag",
    [
        ({"source": "mitre_attack", "tech_id": "T1", "title": "x"}, "[MITRE_ATTACK: T1]"),
        ({"source": "sigma", "tech_id": "", "title": "t" * 60}, "[SIGMA: " + "t" * 60 + "]"),
        ({"title": ""}, "[KB]"),
    ],
)
def test_tags(spark, meta, tag):
    df = spark.createDataFrame([(meta, "kb")], "meta map<string,string>, collection string")
    assert df.select(retrieve.citation_tag(F.col("meta"), F.col("collection"))).first()[0] == tag


def knowledge(spark):
    rows = [
        ("mitre_attack", "d1", "Attackers dump lsass credentials from memory. Unrelated closing words here.", {"source": "mitre_attack", "tech_id": "T1003"}),
        ("sigma", "d2", "Detects lsass memory access by unusual tools in the field.", {"source": "sigma", "title": "Lsass"}),
        ("sigma", "d3", "Gardening tips for beginners.", {"source": "sigma", "title": "Garden"}),
    ]
    df = spark.createDataFrame(rows, "collection string, doc_id string, text string, meta map<string,string>")
    from logvane.operators.embed import embed

    return embed(df, "text")


def queries(spark):
    from logvane.operators.embed import embed

    df = spark.createDataFrame(
        [(1, "lsass memory credentials", "lsass, memory", "High")],
        "query_id long, anomaly_context string, topic_keywords string, severity_hint string",
    )
    return embed(df.withColumn("query", F.concat_ws(" ", "anomaly_context", "topic_keywords")), "query")


def test_retrieval_and_extraction(spark):
    asked = queries(spark)
    found = retrieve.with_context(asked, retrieve.retrieve(asked, knowledge(spark)))
    passages = found.first()["retrieved_docs"].split(retrieve.SEPARATOR)
    assert len(passages) == 3 and "Gardening" in passages[-1]
    row = enrich.enrich(found.drop("embedding")).first()
    assert row["mitre_technique"] == "T1003" and row["severity_rating"] == "High" and row["error"] is None
    assert "lsass" in row["evidence_quotes"] and row["threat_analysis"].endswith(".")


def test_own_reranker(spark):
    asked = queries(spark)
    placed = retrieve.retrieve(asked, knowledge(spark), reranker=lambda q, t: F.when(t.contains("Garden"), 1.0).otherwise(0.0))
    assert placed.filter("place = 1").first()["doc_id"] == "d3" and placed.count() == 3


def test_failures_and_retries(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "fail", "k", "memory"), (2, "weak", "k", "memory credentials"), (3, "good", "k", "memory credentials"), (4, "weak", "k", "")],
        "query_id long, anomaly_context string, topic_keywords string, retrieved_docs string",
    )
    calls = tmp_path / "calls"

    def analyzer(row):
        with open(calls, "a") as log:
            log.write(f"{row['query_id']}\n")
        if row["anomaly_context"] == "fail":
            raise ValueError("no")
        grounded = row["anomaly_context"] == "good" or row["anomaly_context"].startswith(enrich.REMINDER)
        return {"threat_analysis": "They read credentials there." if grounded else "Something totally different."}

    rows = {r["query_id"]: r for r in enrich.enrich(df, analyzer).orderBy("query_id").collect()}
    assert rows[1]["error"] == "ValueError: no" and rows[1]["threat_analysis"] is None
    assert (rows[2]["retried"], rows[2]["threat_analysis"]) == (1, "They read credentials there.")
    assert rows[2]["anomaly_context"] == "weak"
    assert rows[3]["retried"] == 0 and rows[4]["retried"] == 0
    assert sorted(calls.read_text().split()) == ["1", "2", "2", "3", "4"]


def record(spark, contexts, ids):
    return spark.createDataFrame([(contexts, ids)], "c array<string>, i array<string>")


def test_context_metrics(spark):
    df = record(spark, ["none", "about T1 here", "x", "T2 and T1"], ["T1", "T3"])
    precision, recall = df.select(
        answers.context_precision(F.col("c"), F.col("i")), answers.context_recall(F.col("c"), F.col("i"))
    ).first()
    assert precision == pytest.approx((1 / 2 + 2 / 4) / 2) and recall == 0.5
    none = record(spark, ["x"], ["T1"]).select(answers.context_precision(F.col("c"), F.col("i"))).first()[0]
    assert none == 0.0
    assert record(spark, ["x"], []).select(answers.context_recall(F.col("c"), F.col("i"))).first()[0] is None


def analyses(spark, rows):
    return spark.createDataFrame(
        rows, "query_id long, event_id long, hostname string, topic_keywords string, threat_analysis string, "
        "retrieved_docs string, techniques array<string>",
    )


def test_evaluation_records_and_empty_input(spark):
    docs = retrieve.SEPARATOR.join(["T1 passage", "other (a|b) [c]"])
    records = answers.evaluation_records(analyses(spark, [(1, 10, "h", "k", "text", docs, ["T1"]), (2, 1, "h", None, None, "", [])]))
    by = {(r["query_id"], r["condition"]): r for r in records.collect()}
    assert by[(1, "with_rag")]["retrieved_contexts"] == ["T1 passage", "other (a|b) [c]"]
    assert by[(1, "without_rag")]["retrieved_contexts"] == [answers.BASELINE_CONTEXT]
    assert by[(2, "with_rag")]["retrieved_contexts"] == [answers.EMPTY_CONTEXT] and by[(2, "with_rag")]["response"] == ""
    assert by[(1, "with_rag")]["user_input"] == "Analyse this security anomaly: EventID 10 on host h. Topic keywords: k."
    assert by[(1, "with_rag")]["response"] == "text", "quotes are not mixed into the answer"

    empty = answers.compare_conditions(answers.lexical_metrics(answers.evaluation_records(analyses(spark, []))))
    assert {tuple(r) for r in empty.select("metric", "with_rag", "without_rag", "delta", "n_samples").collect()} == {
        (m, 0.0, 0.0, 0.0, 0) for m in answers.METRICS
    }


def test_tokens_are_shared_with_the_index(spark):
    kb = knowledge(spark).withColumn("tokens", clean_tokens(F.col("text")))
    asked = queries(spark)
    with_tokens = retrieve.retrieve(asked, kb).select("doc_id", "place").collect()
    assert sorted(with_tokens) == sorted(retrieve.retrieve(asked, kb.drop("tokens")).select("doc_id", "place").collect())
