"""Text cleaning, n-grams, keywords, clustering and topic selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from logvane.functions import text as X
from logvane.operators import density, embed, keywords, retrieve
from logvane.plans import analyse
from logvane.plans.topics import topic_overview, topic_stage, with_corpus
from workload.raw_events import NORM_CTE, labeled, normalized, table
from workload.scoring import SCORED_CTE, simple_scores


def clean_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_text(F.col("text")).alias("clean_text"))


def clean_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.clean_text(F.col("html")).alias("clean_text"))


def clean_events(spark, sf_dir):
    return with_corpus(normalized(spark, sf_dir)).select(
        "event_key", "corpus", X.clean_text(F.col("corpus")).alias("clean_text")
    )


def _doc_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("topic"), X.clean_tokens(F.col("text")).alias("tokens")
    )


def ngram_counts(spark, sf_dir):
    """Corpus frequency and topic spread of the kept vocabulary."""
    counts = keywords.term_counts(_doc_tokens(spark, sf_dir))
    return keywords.vocabulary(counts).select("term", "total")


def term_weights(spark, sf_dir):
    weights = keywords.term_weights(keywords.term_counts(_doc_tokens(spark, sf_dir), min_topics=keywords.MIN_TOPICS))
    return weights.select("topic", "term", "n", F.round("weight", 8).alias("weight"))


def _keywords(spark, sf_dir):
    weights = keywords.term_weights(keywords.term_counts(_doc_tokens(spark, sf_dir), min_topics=keywords.MIN_TOPICS))
    return keywords.keyword_text(keywords.top_terms(weights), noise=None)


def topic_keywords(spark, sf_dir):
    return _keywords(spark, sf_dir)


def keyword_lookup(spark, sf_dir):
    """Documents of four sources take their source's keywords, the rest 'unknown'."""
    known = _keywords(spark, sf_dir).filter(F.col("topic") < "src4")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("topic"))
    return keywords.with_keywords(docs, known)


def topic_sizes(spark, sf_dir):
    """Documents per source with its keywords."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("topic"))
    sizes = docs.groupBy("topic").agg(F.count("*").alias("n_docs"))
    return sizes.join(_keywords(spark, sf_dir), "topic")


def hashed_embeddings(spark, sf_dir):
    vectors = embed.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", dimensions=16)
    return vectors.select("doc_id", *[F.round(F.col("embedding")[i], 6).alias(f"v{i}") for i in range(16)])


def topic_similarity(spark, sf_dir):
    """Cosine of every label's centroid to every label's."""
    middle = density.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return retrieve.similarity_matrix(middle, "label").withColumn("similarity", F.round("similarity", 6))


def centroid_cosine(spark, sf_dir):
    """Each vector's cosine to the centroid of its label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    found = density.centroid_similarity(vectors, "label", "embedding")
    return found.select("vec_id", F.round("topic_prob", 6).alias("topic_prob"))


CELL = 4.0


def _points(spark, sf_dir):
    """Events as points in the plane: value and user."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"),
        F.array(F.col("value"), F.col("user_id").cast("double")).alias("vector"), F.lit(1).alias("weight"),
    )


def density_clusters(spark, sf_dir):
    return density.density_clusters(_points(spark, sf_dir), 2, CELL).select("doc_id", "topic")


def event_topics(spark, sf_dir):
    """The whole topic stage on the flagged events."""
    flagged = simple_scores(spark, sf_dir).filter(F.col("is_anomaly") == 1)
    events, _, _ = topic_stage(flagged)
    return events.select("event_key", "topic", "topic_prob", "topic_keywords")


def event_topic_overview(spark, sf_dir):
    events, _, _ = topic_stage(labeled(spark, sf_dir))
    return topic_overview(events)


def _with_topic(spark, sf_dir):
    """Scored events with the image name's length as a stand-in topic; topic 7 plays noise."""
    scored = simple_scores(spark, sf_dir)
    length = F.length("image_base")
    return scored.withColumn("topic", F.when(length == 7, F.lit(-1)).otherwise(length))


def topic_means(spark, sf_dir):
    means = analyse.topic_means(_with_topic(spark, sf_dir))
    return means.withColumn("mean_score", F.round("mean_score", 6))


def top_topics(spark, sf_dir):
    return analyse.top_topics(_with_topic(spark, sf_dir), 4).select("topic")


def worst_events(spark, sf_dir):
    """The three lowest scores of each topic."""
    return analyse.worst_events(_with_topic(spark, sf_dir), 3).select("topic", "event_key", "place")


def anomaly_contexts(spark, sf_dir):
    return simple_scores(spark, sf_dir).select("event_key", X.anomaly_context().alias("context"))


def analysis_questions(spark, sf_dir):
    return normalized(spark, sf_dir).select(
        "event_key", X.question(F.col("event_id"), F.col("hostname"), F.col("channel_bucket")).alias("question")
    )


QUERIES = {
    f.__name__: f
    for f in [
        clean_documents, clean_pages, clean_events, ngram_counts, term_weights, topic_keywords, keyword_lookup,
        topic_sizes, hashed_embeddings, topic_similarity, centroid_cosine, density_clusters, event_topics,
        event_topic_overview, topic_means, top_topics, worst_events, anomaly_contexts, analysis_questions,
    ]
}

_DROPPED = ", ".join(
    f"'{w}'" for w in dict.fromkeys([*X.STOP_WORDS, *X.DOMAIN_NOISE]) if len(w) >= X.MIN_WORD
)


def tokens_sql(text: str) -> str:
    t = f"regexp_replace({text}, '{X.PATH_PATTERN}', ' \\1 ', 'g')"
    t = f"regexp_replace({t}, '{X.GUID_PATTERN}', ' ', 'g')"
    t = f"regexp_replace({t}, '{X.HEX_PATTERN}', ' hexval ', 'g')"
    t = f"string_split(lower(regexp_replace({t}, '[^a-zA-Z]+', ' ', 'g')), ' ')"
    return f"list_filter({t}, lambda w: length(w) >= 3 AND w NOT IN ({_DROPPED}))"


def clean_sql(text: str) -> str:
    return f"coalesce(nullif(array_to_string({tokens_sql(text)}, ' '), ''), 'unknown_event')"


TERMS_CTE = f"""
toks AS (SELECT source AS topic, {tokens_sql("text")} AS t FROM documents),
grams AS (
  SELECT topic, unnest(t) AS term FROM toks
  UNION ALL SELECT topic, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]))
  FROM toks WHERE len(t) > 1),
counts AS (SELECT topic, term, count(*) AS n FROM grams GROUP BY ALL),
vocab AS (SELECT term, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY term HAVING count(*) >= 2),
kept AS (SELECT c.*, v.total FROM counts c JOIN vocab v USING (term)),
lens AS (SELECT topic, sum(n) AS length FROM kept GROUP BY topic),
weights AS (SELECT topic, term, n, n / CAST(length AS DOUBLE) * ln(1 + (SELECT avg(length) FROM lens) / total) AS weight
            FROM kept JOIN lens USING (topic)),
kws AS (SELECT topic, string_agg(term, ', ' ORDER BY r) AS topic_keywords FROM (
          SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 12) DESC, term) AS r FROM weights)
        WHERE r <= 10 GROUP BY topic)"""


def hashed_cte(source: str, key: str, text: str, dimensions: int, name: str = "vecs") -> str:
    """Hashed unit vectors ``name(key, v)`` of a table."""
    return f"""
{name}_tok AS (SELECT {key}, unnest({tokens_sql(text)}) AS tok FROM {source}),
{name}_num AS (SELECT {key}, CAST('0x' || substr(md5(tok), 1, 9) AS UBIGINT) AS h FROM {name}_tok),
{name}_sum AS (SELECT {key}, CAST((h // 16) % {dimensions} AS INTEGER) AS slot,
    CAST(sum(CASE WHEN h % 16 < 8 THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM {name}_num GROUP BY ALL),
{name}_map AS (SELECT {key}, map(list(slot), list(x)) AS m, sqrt(sum(x * x)) AS norm FROM {name}_sum GROUP BY {key}),
{name} AS (SELECT t.{key}, list_transform(range({dimensions}), lambda i:
    CASE WHEN norm > 0 THEN coalesce(m[CAST(i AS INTEGER)], 0.0) / norm ELSE 0.0 END) AS v
  FROM {source} t LEFT JOIN {name}_map USING ({key}))"""


_CENTER_CTE = """
parts AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL),
centers AS (SELECT label, list(x ORDER BY i) AS c FROM parts GROUP BY label)"""

_TOPIC_CTE = SCORED_CTE + """,
topics AS (SELECT *, CAST(CASE WHEN length(image_base) = 7 THEN -1 ELSE length(image_base) END AS INTEGER) AS topic
           FROM scored)"""

ORACLES = {
    "clean_documents": f"SELECT doc_id, {clean_sql('text')} AS clean_text FROM documents",
    "clean_pages": f"SELECT page_id, {clean_sql('html')} AS clean_text FROM pages",
    "clean_events": f"""WITH {NORM_CTE}, corp AS (SELECT event_key, message || ' ' || image_base || ' ' ||
        target_image_base || ' ' || lower(string_split(target_object, '\\')[-1]) AS corpus FROM norm)
        SELECT event_key, corpus, {clean_sql('corpus')} AS clean_text FROM corp""",
    "ngram_counts": f"WITH {TERMS_CTE} SELECT term, total FROM vocab",
    "term_weights": f"WITH {TERMS_CTE} SELECT topic, term, n, round(weight, 8) AS weight FROM weights",
    "topic_keywords": f"WITH {TERMS_CTE} SELECT topic, topic_keywords FROM kws",
    "keyword_lookup": f"""WITH {TERMS_CTE} SELECT doc_id, source AS topic, coalesce(topic_keywords, 'unknown')
        AS topic_keywords FROM documents LEFT JOIN (SELECT * FROM kws WHERE topic < 'src4') k ON source = k.topic""",
    "topic_sizes": f"""WITH {TERMS_CTE} SELECT topic, n_docs, topic_keywords FROM kws
        JOIN (SELECT source AS topic, count(*) AS n_docs FROM documents GROUP BY 1) USING (topic)""",
    "hashed_embeddings": f"WITH {hashed_cte('documents', 'doc_id', 'text', 16)} SELECT doc_id, "
        + ", ".join(f"round(v[{i + 1}], 6) AS v{i}" for i in range(16)) + " FROM vecs",
    "topic_similarity": f"""WITH {_CENTER_CTE},
        pairs AS (SELECT a.label, b.label AS other_label, round(1 - list_cosine_similarity(a.c, b.c), 10) AS d
                  FROM centers a, centers b),
        placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY d, other_label) AS INTEGER) AS rank FROM pairs)
        SELECT label, other_label, round(1 - d, 6) AS similarity, rank FROM placed""",
    "centroid_cosine": f"""WITH {_CENTER_CTE} SELECT vec_id,
        round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 6) AS topic_prob
        FROM embeddings JOIN centers USING (label)""",
    "density_clusters": f"""WITH RECURSIVE
pts AS (SELECT event_id AS doc_id, CAST(floor(value / {CELL}) AS BIGINT) AS cx, CAST(floor(user_id / {CELL}) AS BIGINT) AS cy
        FROM events),
cells AS (SELECT cx, cy, count(*) AS own, min(doc_id) AS first FROM pts GROUP BY ALL),
steps(dx, dy) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)),
near AS (SELECT a.first AS a, a.own AS own, b.first AS b, b.own AS near_own FROM cells a CROSS JOIN steps
         JOIN cells b ON b.cx = a.cx + dx AND b.cy = a.cy + dy),
core AS (SELECT first, c.own FROM cells c LEFT JOIN (SELECT a, sum(near_own) AS s FROM near GROUP BY a) ON a = first
         WHERE c.own + coalesce(s, 0) >= 15),
links AS (SELECT a, b FROM near WHERE a IN (SELECT first FROM core) AND b IN (SELECT first FROM core)),
reach(node, comp) AS (SELECT first, first FROM core UNION SELECT l.b, r.comp FROM reach r JOIN links l ON l.a = r.node),
comps AS (SELECT node AS first, min(comp) AS comp FROM reach GROUP BY node),
border AS (SELECT n.a AS first, c.comp FROM near n JOIN comps c ON c.first = n.b
           WHERE n.a NOT IN (SELECT first FROM core)
           QUALIFY row_number() OVER (PARTITION BY n.a ORDER BY n.near_own DESC, n.b) = 1),
labels AS (SELECT * FROM comps UNION ALL SELECT * FROM border),
sizes AS (SELECT comp, sum(own) AS size, min(cells.first) AS start FROM labels JOIN cells USING (first) GROUP BY comp
          HAVING sum(own) >= 15),
named AS (SELECT comp, CAST(row_number() OVER (ORDER BY size DESC, start) - 1 AS INTEGER) AS topic FROM sizes)
SELECT doc_id, coalesce(topic, -1) AS topic FROM pts JOIN cells USING (cx, cy)
LEFT JOIN labels USING (first) LEFT JOIN named USING (comp)""",
    "topic_means": f"""WITH {_TOPIC_CTE} SELECT topic, count(*) AS n_events, round(avg(anomaly_score), 6) AS mean_score
        FROM topics GROUP BY topic""",
    "top_topics": f"""WITH {_TOPIC_CTE} SELECT topic FROM topics WHERE topic <> -1 GROUP BY topic
        ORDER BY avg(anomaly_score), topic LIMIT 4""",
    "worst_events": f"""WITH {_TOPIC_CTE} SELECT topic, event_key, CAST(place AS INTEGER) AS place FROM (
        SELECT topic, event_key, row_number() OVER (PARTITION BY topic ORDER BY anomaly_score, event_key) AS place
        FROM topics) WHERE place <= 3""",
    "anomaly_contexts": f"""WITH {SCORED_CTE} SELECT event_key, 'EventID: ' || event_id || ' | Hostname: ' || hostname ||
        ' | Process: ' || image || ' | TargetImage: ' || target_image || ' | TargetObject: ' ||
        target_object || ' | Account: ' || coalesce(account_name, 'None') || ' (' || "domain" || ')' ||
        ' | GrantedAccess: ' || CASE WHEN granted_access = 0 THEN 'N/A' ELSE '0x' || lower(to_hex(granted_access)) END ||
        ' | IsolationForest score: ' || printf('%.4f', anomaly_score) || ' | Message: ' || message AS context
        FROM scored""",
    "analysis_questions": f"""WITH {NORM_CTE} SELECT event_key, 'Analyse this security anomaly: EventID ' || event_id ||
        ' on host ' || hostname || '. Topic keywords: ' || channel_bucket || '.' AS question FROM norm""",
}
