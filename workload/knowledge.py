"""Knowledge feeds derived from the tables, collections, search, re-ranking and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.functions import text as X
from logvane.operators import density, embed, enrich, retrieve
from logvane.plans import analyse
from logvane.session import materialize, work_path
from logvane.sources import collections, knowledge
from workload.raw_events import table
from workload.scoring import simple_scores
from workload.topics import _TOPIC_CTE, _with_topic, hashed_cte, tokens_sql


def _text(column):
    return F.col(column).cast("string")


def _attack_bundles(spark, sf_dir):
    """One bundle per document: a technique (or, every fifth time, a tool) and an unrelated object."""
    ref = lambda source, value: F.struct(F.lit(source).alias("source_name"), value.alias("external_id"))
    tech = F.concat(F.lit("T"), (F.col("doc_id") % 500 + 1000).cast("string"))
    technique = F.struct(
        F.when(F.col("doc_id") % 5 == 0, "tool").otherwise("attack-pattern").alias("type"),
        F.concat(F.lit("attack-pattern--"), F.lpad(_text("doc_id"), 9, "0")).alias("id"),
        F.concat_ws(" ", "source", "lang").alias("name"),
        F.col("text").alias("description"),
        F.when(F.col("doc_id") % 7 == 0, F.array(ref("capec", tech)))
        .otherwise(F.array(ref("mitre-attack", F.lit("T0")), ref("capec", F.lit("C1")), ref("mitre-attack", tech)))
        .alias("external_references"),
        F.when(F.col("doc_id") % 3 > 0, F.array(
            F.struct(F.lit("first").alias("phase_name")), F.struct(F.col("lang").alias("phase_name"))
        )).alias("kill_chain_phases"),
    )
    other = F.struct(
        F.lit("relationship").alias("type"), F.lit("relationship--1").alias("id"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("array<struct<source_name string, external_id string>>").alias("external_references"),
        F.lit(None).cast("array<struct<phase_name string>>").alias("kill_chain_phases"),
    )
    documents = table(spark, sf_dir, "documents")
    return documents.select(F.to_json(F.struct(F.array(technique, other).alias("objects"))).alias("bundle"))


def _shown(docs, *keys):
    """Docs with the wanted metadata as columns."""
    return docs.select("doc_id", "text", F.col("meta")["source"].alias("source"), *[F.col("meta")[k].alias(k) for k in keys])


def _attack(spark, sf_dir):
    return knowledge.attack_docs(knowledge.parse_bundles(_attack_bundles(spark, sf_dir), "bundle", "mitre_attack"))


def attack_docs(spark, sf_dir):
    return _shown(_attack(spark, sf_dir), "tech_id", "tactic", "name")


def _d3fend_bundles(spark, sf_dir):
    key = F.col("p_partkey")
    item = F.struct(
        F.when(key % 3 == 0, F.concat(F.lit("D3-A.B:"), _text("p_partkey"))).alias("id"),
        F.when(key % 3 == 1, F.concat(F.lit("D3/"), _text("p_partkey"))).otherwise(F.lit("")).alias("d3f_id"),
        F.when(key % 2 == 0, F.col("p_name")).alias("label"), F.col("p_brand").alias("name"),
        F.lit("").alias("definition"), F.repeat(F.col("p_type"), 200).alias("description"),
    )
    some = F.to_json(F.struct(F.array(item).alias("techniques")))
    other = F.to_json(F.struct(F.array().cast("array<string>").alias("techniques"), F.array(item).alias("data")))
    return table(spark, sf_dir, "part").select(F.when(key % 4 == 0, other).otherwise(some).alias("bundle"))


def _d3fend(spark, sf_dir):
    return knowledge.d3fend_docs(knowledge.parse_bundles(_d3fend_bundles(spark, sf_dir), "bundle", "mitre_d3fend"))


def d3fend_docs(spark, sf_dir):
    return _shown(_d3fend(spark, sf_dir), "d3fend_id", "name")


def _kev_bundles(spark, sf_dir):
    key = F.col("c_custkey")
    item = F.struct(
        F.concat(F.lit("CVE-2024-"), _text("c_custkey")).alias("cveID"), F.col("c_name").alias("vendorProject"),
        F.when(key % 3 > 0, F.col("c_mktsegment")).alias("product"), F.col("c_mktsegment").alias("vulnerabilityName"),
        F.repeat(F.col("c_name"), 150).alias("requiredAction"), F.lit("2024-01-31").alias("dueDate"),
    )
    return table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.array(item).alias("vulnerabilities"))).alias("bundle"))


def _kev(spark, sf_dir):
    return knowledge.kev_docs(knowledge.parse_bundles(_kev_bundles(spark, sf_dir), "bundle", "cisa_kev"))


def kev_docs(spark, sf_dir):
    return _shown(_kev(spark, sf_dir), "cve_id", "product")


def _msrc_bundles(spark, sf_dir):
    key = F.col("o_orderkey")
    year = F.when(key % 13 == 0, F.lit("Jan ")).otherwise((F.year("o_orderdate") + 27).cast("string"))
    item = F.struct(
        F.concat_ws("-", year, _text("o_orderkey")).alias("ID"), F.col("o_orderpriority").alias("DocumentTitle"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("InitialReleaseDate"),
        F.when(key % 2 == 0, F.col("o_orderstatus")).alias("CvrfUrl"),
    )
    return table(spark, sf_dir, "orders").select(F.to_json(F.struct(F.array(item).alias("value"))).alias("bundle"))


def _msrc(spark, sf_dir):
    return knowledge.msrc_docs(knowledge.parse_bundles(_msrc_bundles(spark, sf_dir), "bundle", "msrc_cvrf"))


def msrc_docs(spark, sf_dir):
    return _shown(_msrc(spark, sf_dir), "update_id", "title")


def _car_files(spark, sf_dir):
    content = F.format_string(
        "title: \"%s\"\ndescription: seen on %s\nimplementations:\n- code: \"search %s\"\n- plain text\n- name: no code\n- code: 42\n",
        "url", "url", "url",
    )
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/car/analytics/CAR-"), _text("page_id"), F.when(F.col("page_id") % 2 == 0, ".yaml").otherwise(".yml"))
        .alias("path"),
        F.when(F.col("page_id") % 10 == 0, F.lit("title: [never closed")).otherwise(content).alias("content"),
    )


def _car(spark, sf_dir):
    return knowledge.car_docs(knowledge.parse_rules(_car_files(spark, sf_dir), may_be_empty=False))


def car_docs(spark, sf_dir):
    return _shown(_car(spark, sf_dir), "title", "file")


def unreadable_rules(spark, sf_dir):
    return knowledge.unreadable(knowledge.parse_rules(_car_files(spark, sf_dir), may_be_empty=False))


def _sigma(spark, sf_dir):
    """File names repeat across folders, so ids must be told apart."""
    body = F.format_string(
        "description: from %s\ntags: [attack.%s, \"%s\"]\ndetection:\n  selection: {EventID: %s, Image: a.exe}\n  condition: selection\n",
        "source", "lang", "source", F.col("doc_id") % 20,
    )
    title = F.when(F.col("doc_id") % 4 > 0, F.format_string("title: Rule %s\n", "doc_id")).otherwise(F.lit(""))
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/sigma/rules/"), _text("doc_id"), F.lit("/"), F.col("source"), F.lit(".yml")).alias("path"),
        F.concat(title, body).alias("content"),
    )
    return knowledge.sigma_docs(knowledge.parse_rules(files, may_be_empty=True))


def sigma_docs(spark, sf_dir):
    return _shown(_sigma(spark, sf_dir), "title", "file", "tags")


ITEMS_PER_BUNDLE = 2_000


def _land(texts, collection, path):
    """A feed as files of one bundle each, with many items to a bundle."""
    parsed = knowledge.parse_bundles(texts, "bundle", collection)
    whole = F.struct(*parsed.columns)
    number = F.pmod(F.xxhash64(F.to_json(whole)), F.lit(1 + texts.count() // ITEMS_PER_BUNDLE))
    bundles = parsed.groupBy(F.size(parsed.columns[0]) > 0, number).agg(
        *[F.flatten(F.collect_list(c)).alias(c) for c in parsed.columns]
    )
    bundles.select(F.to_json(whole)).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def collection_counts(spark, sf_dir):
    """All six feeds into the stored collections, the JSON ones from landed files; one collection replaced again."""
    path, root = work_path(spark, "kb"), work_path(spark, "feeds")
    bundles = {
        "mitre_attack": _attack_bundles, "mitre_d3fend": _d3fend_bundles, "cisa_kev": _kev_bundles, "msrc_cvrf": _msrc_bundles,
    }
    feeds = {c: collections.FEED_PATHS[c] for c in bundles}
    for c, make in bundles.items():
        _land(make(spark, sf_dir), c, f"{root}/{feeds[c]}")
    collections.build_knowledge_base(spark, root, path, feeds)
    named = lambda c, docs: docs.select(F.lit(c).alias("collection"), "doc_id", "text", "meta")
    rules = named("mitre_car", _car(spark, sf_dir)).unionByName(named("sigma_rules", _sigma(spark, sf_dir)))
    collections.replace_collections(rules, path)
    collections.replace_collections(named("cisa_kev", _kev(spark, sf_dir)), path)
    return collections.collection_counts(collections.read_collections(spark, path))


# --- search -----------------------------------------------------------------------------------------------------

_KB: dict[tuple[str, str], DataFrame] = {}


def _kb(spark, sf_dir):
    """Documents as passages, one collection per language, embedded once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KB:
        docs = table(spark, sf_dir, "documents").select(
            F.col("lang").alias("collection"), "doc_id", "text",
            F.create_map(
                F.lit("source"), F.col("source"), F.lit("tech_id"),
                F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("T"), _text("doc_id"))).otherwise(F.lit("")),
                F.lit("title"), F.when(F.col("doc_id") % 3 > 0, F.concat_ws(" in ", "source", "lang")),
            ).alias("meta"),
        )
        indexed = embed.embed(docs.withColumn("tokens", X.clean_tokens(F.col("text"))), "text", tokens="tokens")
        _KB[key] = materialize(indexed, "kb")
    return _KB[key]


def _queries(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return embed.embed(items, "query")


def _nearest_shown(found):
    return found.select("query_id", "collection", "doc_id", F.round("distance", 6).alias("distance"), "rank")


def nearest_passages(spark, sf_dir):
    """The five nearest documents of every language for every benchmark text."""
    return _nearest_shown(retrieve.nearest(_queries(spark, sf_dir), _kb(spark, sf_dir), 5))


def nearest_passages_blocked(spark, sf_dir):
    """The same through the path for query sets too large to share."""
    return _nearest_shown(retrieve.nearest(_queries(spark, sf_dir), _kb(spark, sf_dir), 5, max_shared=1))


def nearest_vectors(spark, sf_dir):
    """Euclidean neighbours of every label's centroid within each label."""
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    middle = density.centroids(vectors, "label", "embedding").select(
        F.col("label").alias("query_id"), F.col("centroid").alias("embedding")
    )
    return _nearest_shown(retrieve.nearest(middle, vectors, 4, "l2", collection="label"))


def bm25_scores(spark, sf_dir):
    queries, kb = _queries(spark, sf_dir), _kb(spark, sf_dir)
    found = retrieve.nearest(queries, kb, 5)
    scored = retrieve.bm25(
        found, queries.select("query_id", X.clean_tokens(F.col("query")).alias("tokens")),
        kb.select("collection", "doc_id", "tokens"), ["collection", "doc_id"],
    )
    return scored.select("query_id", "collection", "doc_id", F.round("bm25", 6).alias("bm25"))


def reranked_passages(spark, sf_dir):
    """All candidates of a query in joint order, with their cited passages."""
    placed = retrieve.retrieve(_queries(spark, sf_dir), _kb(spark, sf_dir))
    return placed.select("query_id", "place", "doc_id", "passage")


def retrieval_contexts(spark, sf_dir):
    queries = _queries(spark, sf_dir)
    found = retrieve.with_context(queries, retrieve.retrieve(queries, _kb(spark, sf_dir)))
    return found.select("query_id", "retrieved_docs")


def analysis_queries(spark, sf_dir):
    """Context and keywords of the three worst events of each of the lowest-scored topics."""
    events = _with_topic(spark, sf_dir).withColumn("topic_keywords", F.concat(F.lit("kw "), _text("topic")))
    return analyse.analysis_queries(events).select("query_id", "topic", "query")


def _attack_kb(spark, sf_dir):
    docs = _attack(spark, sf_dir).select(F.lit("mitre_attack").alias("collection"), "doc_id", "text", "meta")
    return materialize(embed.embed(docs.withColumn("tokens", X.clean_tokens(F.col("text"))), "text", tokens="tokens"), "attack-kb")


def analysed_events(spark, sf_dir):
    """Selection, retrieval and enrichment of the worst events, end to end."""
    return analyse.analyse_events(_topical(spark, sf_dir), _attack_kb(spark, sf_dir))


def _topical(spark, sf_dir):
    return _with_topic(spark, sf_dir).withColumn("topic_keywords", F.concat_ws(", ", "image_base", "hostname"))


def enriched_events(spark, sf_dir):
    found = analysed_events(spark, sf_dir)
    return found.select("query_id", "topic", "event_id", "hostname", "mitre_technique", "severity_rating", "error")


def event_severity_hint(spark, sf_dir):
    """Severity by rule tier for every event."""
    return simple_scores(spark, sf_dir).select("event_key", enrich.severity_hint().alias("severity"))


QUERIES = {
    f.__name__: f
    for f in [
        attack_docs, d3fend_docs, kev_docs, msrc_docs, car_docs, unreadable_rules, sigma_docs, collection_counts,
        nearest_passages, nearest_passages_blocked, nearest_vectors, bm25_scores, reranked_passages,
        retrieval_contexts, analysis_queries, enriched_events, event_severity_hint,
    ]
}

def _passages(sql: str, shown: str, order: str = "text") -> str:
    """Repeated ids numbered, long texts in pieces of 2000 characters."""
    return f"""SELECT CASE WHEN part = 1 THEN uid ELSE uid || '#' || part END AS doc_id,
  text[(part - 1) * 2000 + 1 : part * 2000] AS text, source, {shown}
FROM (SELECT *, CASE WHEN r = 1 THEN doc_id ELSE doc_id || '_' || r END AS uid,
        unnest(range(1, greatest(1, CAST(ceil(length(text) / 2000) AS BIGINT)) + 1)) AS part
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5({order})[1:2], {order}) AS r FROM ({sql})))"""


_ATTACK = _passages("""SELECT 'attack_' || tech_id || '_' || right(lpad(CAST(doc_id AS VARCHAR), 9, '0'), 6) AS doc_id,
  'ATT&CK ' || tech_id || ' — ' || source || ' ' || lang || chr(10) || 'Tactic: ' || tactic || chr(10) || text AS text,
  'mitre_attack' AS source, tech_id, tactic, source || ' ' || lang AS name
FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'T' || (doc_id % 500 + 1000) END AS tech_id,
        CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS tactic FROM documents) WHERE doc_id % 5 <> 0""", "tech_id, tactic, name")
_D3FEND = _passages("""SELECT 'd3fend_' || regexp_replace(d3fend_id, '[^a-zA-Z0-9_]', '_', 'g') AS doc_id,
  'D3FEND ' || d3fend_id || ' — ' || name || chr(10) || repeat(p_type, 200) AS text, 'd3fend' AS source,
  d3fend_id, name
FROM (SELECT p_type, CASE p_partkey % 3 WHEN 0 THEN 'D3-A.B:' || p_partkey WHEN 1 THEN 'D3/' || p_partkey
          ELSE 'unknown' END AS d3fend_id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS name FROM part)""",
    "d3fend_id, name")
_KEV = _passages("""SELECT 'kev_CVE-2024-' || c_custkey AS doc_id,
  'CVE: CVE-2024-' || c_custkey || ' | Vendor: ' || c_name || ' | Product: ' || product || ' | Vulnerability: ' ||
   c_mktsegment || ' | Required Action: ' || repeat(c_name, 150) || ' | Due Date: 2024-01-31 | Notes: ' AS text,
  'cisa_kev' AS source, 'CVE-2024-' || c_custkey AS cve_id, product
FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS product FROM customer)""", "cve_id, product")
_MSRC = _passages("""SELECT 'msrc_' || id AS doc_id, 'MSRC Update: ' || id || ' | Title: ' || o_orderpriority || ' | Release Date: ' ||
   strftime(o_orderdate, '%Y-%m-%d') || ' | CVRF URL: ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS text,
  'msrc_cvrf' AS source, id AS update_id, o_orderpriority AS title
FROM (SELECT *, (year(o_orderdate) + 27) || '-' || o_orderkey AS id FROM orders WHERE o_orderkey % 13 <> 0)
WHERE year(o_orderdate) + 27 >= 2023""", "update_id, title")
_CAR = _passages("""SELECT 'car_CAR-' || page_id AS doc_id,
  'CAR — ' || url || chr(10) || 'seen on ' || url || chr(10) || 'Detection logic: search ' || url || '  42' AS text,
  'mitre_car' AS source, url AS title, 'CAR-' || page_id || CASE WHEN page_id % 2 = 0 THEN '.yaml' ELSE '.yml' END AS file
FROM pages WHERE page_id % 10 <> 0""", "title, file")
_SIGMA = _passages("""SELECT 'sigma_' || source || '.yml' AS doc_id, '/sigma/rules/' || doc_id || '/' || source || '.yml' AS path,
  'Sigma Rule: ' || title || chr(10) || 'Tags: ' || tags || chr(10) || 'Description: from ' || source || chr(10) ||
   'Detection: {''selection'': {''EventID'': ' || (doc_id % 20) || ', ''Image'': ''a.exe''}, ''condition'': ''selection''}'
   AS text, 'sigma' AS source, title, source || '.yml' AS file, tags
FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN source || '.yml' ELSE 'Rule ' || doc_id END AS title,
        'attack.' || lang || ', ' || source AS tags FROM documents)""", "title, file, tags", "path")

SEARCH_CTE = hashed_cte("documents", "doc_id", "text", 64, "dv") + "," + hashed_cte(
    "benchmark", "item_id", "text", 64, "qv"
) + """,
dist AS (SELECT q.item_id AS query_id, d.lang AS collection, d.doc_id, round(1 - list_dot_product(q.v, dv.v), 10) AS distance
         FROM qv q CROSS JOIN dv JOIN documents d USING (doc_id)),
found AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, collection ORDER BY distance, doc_id) AS INTEGER) AS rank
          FROM dist QUALIFY rank <= 5)"""

BM25_CTE = SEARCH_CTE + f""",
dt AS (SELECT lang AS collection, doc_id, {tokens_sql('text')} AS t FROM documents),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark),
dfreq AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM dt)
          WHERE term IN (SELECT term FROM qt) GROUP BY term),
sizes AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM dt),
tfs AS (SELECT f.query_id, f.doc_id, u.len, u.term, count(*) AS tf FROM found f
        JOIN (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM dt) u ON u.doc_id = f.doc_id
        JOIN qt ON qt.query_id = f.query_id AND qt.term = u.term GROUP BY ALL),
sums AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
            / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))) AS bm25 FROM tfs JOIN dfreq USING (term), sizes GROUP BY ALL),
scored AS (SELECT f.*, coalesce(bm25, 0.0) AS bm25 FROM found f LEFT JOIN sums USING (query_id, doc_id)),
placed AS (SELECT s.query_id, s.doc_id, CAST(row_number() OVER (PARTITION BY query_id
             ORDER BY round(bm25, 10) DESC, distance, collection, s.doc_id) AS INTEGER) AS place,
             '[' || upper(d.source) || CASE WHEN d.doc_id % 2 = 0 THEN ': T' || d.doc_id
               WHEN d.doc_id % 3 <> 0 THEN ': ' || d.source || ' in ' || d.lang ELSE '' END || ']' || chr(10) || d.text AS passage
           FROM scored s JOIN documents d USING (doc_id))"""

ORACLES = {
    "attack_docs": _ATTACK,
    "d3fend_docs": _D3FEND,
    "kev_docs": _KEV,
    "msrc_docs": _MSRC,
    "car_docs": _CAR,
    "unreadable_rules": """SELECT '/car/analytics/CAR-' || page_id || CASE WHEN page_id % 2 = 0 THEN '.yaml' ELSE '.yml' END
        AS path FROM pages WHERE page_id % 10 = 0""",
    "sigma_docs": _SIGMA,
    "collection_counts": " UNION ALL ".join(
        f"SELECT '{c}' AS collection, count(*) AS n_docs FROM ({sql})"
        for c, sql in {"mitre_attack": _ATTACK, "mitre_d3fend": _D3FEND, "cisa_kev": _KEV, "msrc_cvrf": _MSRC,
                       "mitre_car": _CAR, "sigma_rules": _SIGMA}.items()
    ),
    "nearest_passages": f"WITH {SEARCH_CTE} SELECT query_id, collection, doc_id, round(distance, 6) AS distance, rank FROM found",
    "nearest_vectors": """WITH parts AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x
          FROM embeddings, range(1, 65) r(i) GROUP BY ALL),
        centers AS (SELECT label, list(x ORDER BY i) AS c FROM parts GROUP BY label),
        d AS (SELECT c.label AS query_id, e.label AS collection, vec_id AS doc_id,
                round(list_distance(c.c, CAST(e.embedding AS DOUBLE[])), 10) AS distance FROM centers c, embeddings e)
        SELECT query_id, collection, doc_id, round(distance, 6) AS distance,
          CAST(row_number() OVER (PARTITION BY query_id, collection ORDER BY distance, doc_id) AS INTEGER) AS rank
        FROM d QUALIFY rank <= 4""",
    "bm25_scores": f"WITH {BM25_CTE} SELECT query_id, collection, doc_id, round(bm25, 6) AS bm25 FROM scored",
    "reranked_passages": f"WITH {BM25_CTE} SELECT query_id, place, doc_id, passage FROM placed",
    "retrieval_contexts": f"""WITH {BM25_CTE} SELECT query_id,
        string_agg(passage, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS retrieved_docs
        FROM placed GROUP BY query_id""",
    "analysis_queries": f"""WITH {_TOPIC_CTE},
        top AS (SELECT topic FROM topics WHERE topic <> -1 GROUP BY topic ORDER BY avg(anomaly_score), topic LIMIT 12)
        SELECT event_key AS query_id, topic, 'EventID: ' || event_id || ' | Hostname: ' || hostname ||
          ' | Process: ' || image || ' | TargetImage: ' || target_image || ' | TargetObject: ' ||
          target_object || ' | Account: ' || coalesce(account_name, 'None') || ' (' || "domain" || ')' ||
          ' | GrantedAccess: ' || CASE WHEN granted_access = 0 THEN 'N/A' ELSE '0x' || lower(to_hex(granted_access)) END ||
          ' | IsolationForest score: ' || printf('%.4f', anomaly_score) || ' | Message: ' || message ||
          ' kw ' || topic AS query
        FROM topics WHERE topic IN (SELECT topic FROM top)
        QUALIFY row_number() OVER (PARTITION BY topic ORDER BY anomaly_score, event_key) <= 3""",
    "event_severity_hint": f"""WITH {_TOPIC_CTE},
        tiers AS (SELECT event_key, bool_or(rule_id > 20) AS t2 FROM hits GROUP BY event_key)
        SELECT event_key, CASE WHEN t2 THEN 'Critical' WHEN t2 IS NOT NULL THEN 'High' WHEN is_anomaly = 1 THEN 'Medium'
          ELSE 'Low' END AS severity FROM topics LEFT JOIN tiers USING (event_key)""",
}
ORACLES["nearest_passages_blocked"] = ORACLES["nearest_passages"]
