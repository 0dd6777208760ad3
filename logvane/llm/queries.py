"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvane.llm import (
    attention_lm,
    bin_completion,
    conversation_trie,
    fim_boundaries,
    license_rules,
    prefix_free,
    quality_fm,
    risk_rules,
    secret_lexer,
    simhash_windows,
    trie_join,
    warc_revisit,
    zstd_language,
)
from logvane.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file is, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _fold(modulus: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels are learned outside fold 2 of 4."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_fold(4) == 2, F.lit(False))
    model = quality_fm.fit(docs.filter(~held_out), _table(spark, sf_dir, "labels").filter(~held_out), meta=("n_chars",))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text", "n_chars")
    return quality_fm.score(rows, model, meta=("n_chars",)).drop("text", "n_chars")


def op2_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and the verdict of cutoffs certified on the labelled ones, by language."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = risk_rules.apply_rules(docs, _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *risk_rules.COUNTS, "base_failed", "kept", "rejected_by")


OP2_SQL = """
WITH w AS (
  SELECT doc_id, lang, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
keyed AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM win),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, range(8) t(o) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, lang, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS n_capitals,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
rules(rule, ord, cut) AS (VALUES {rules}),
measured AS (
  SELECT doc_id, lang, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'capitals']) AS rule,
         unnest([n_symbols / greatest(word_chars, 1), n_dup_lines / greatest(n_lines, 1),
                 n_repeat_words / greatest(n_words, 1), n_capitals / greatest(word_chars, 1)]) AS v
  FROM m),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
placed AS (SELECT doc_id, min(ord) AS place FROM measured JOIN rules r ON r.rule = measured.rule AND v >= cut GROUP BY doc_id),
sure AS (SELECT lang, place FROM m LEFT JOIN placed USING (doc_id) WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
tried AS (
  SELECT lang, ord, count(*) AS n, count(*) FILTER (place <= ord) AS k FROM sure, (SELECT ord FROM rules) GROUP BY ALL),
tests AS (
  SELECT *, k < n * {risk} AND (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))
    FROM range(k + 1) t(i)) <= {error} / (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM tried) AS pass
  FROM tried),
chosen AS (
  SELECT lang, max(ord) AS certified FROM (
    SELECT *, bool_and(pass) OVER (PARTITION BY lang ORDER BY ord) AS holds FROM tests) WHERE holds GROUP BY lang),
hits AS (
  SELECT m.doc_id, r.rule AS hit FROM m JOIN placed USING (doc_id) JOIN chosen c ON c.lang IS NOT DISTINCT FROM m.lang
  JOIN rules r ON r.ord = place WHERE place <= certified)
SELECT m.doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND hit IS NULL AS kept,
       CASE WHEN base_failed THEN 'base' ELSE hit END AS rejected_by
FROM m LEFT JOIN hits ON hits.doc_id = m.doc_id
""".format(
    rules=", ".join(f"('{name}', {i}, {cut})" for i, (name, cut) in enumerate(risk_rules.STEPS)),
    risk=risk_rules.RISK, error=risk_rules.ERROR,
)


def op3_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items it holds a copy or near copy of."""
    return simhash_windows.verdicts(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op4_secret_lexer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secret_lexer.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every document; learned outside fold 1 of 5."""
    held_out = F.coalesce(_fold(5) == 1, F.lit(False)).alias("held_out")
    rows = attention_lm.encoded(_table(spark, sf_dir, "documents").select("doc_id", held_out, "text"), tokenizer_path())
    counts, model = attention_lm.fit(rows.filter("NOT held_out").drop("held_out"), tokenizer_path())
    return attention_lm.score(rows, counts, model, tokenizer_path())


def op6_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bin_completion.pack(bin_completion.cut(docs, tokenizer_path()))


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document, those of the base phrases with their places."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_rules.scan_licenses(docs).drop("text")


def op8_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to an archive, repeated payloads as revisits, and tell what reading it back gives."""
    path = warc_revisit.write_archives(_table(spark, sf_dir, "pages"), "page_id", "url", "html", "2025-01-01T00:00:00Z")
    records = materialize(warc_revisit.read_archives(spark, path, payloads=False).drop("payload"), "warc_read")
    return warc_revisit.with_originals(records).select(
        F.col("record_key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS top FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN top IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM m
"""


def op9_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of at least 0.9."""
    return trie_join.join_components(_table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach AS (
  WITH RECURSIVE r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, links.y FROM r JOIN links ON links.x = r.y)
  SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id,
       (SELECT count(*) FROM links WHERE links.x = w.doc_id) AS n_links
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach ON reach.x = w.doc_id
"""


def op10_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the smallest encoding; learned outside fold 2 of 4."""
    docs = _table(spark, sf_dir, "documents")
    model = zstd_language.fit(docs.filter(F.coalesce(_fold(4) != 2, F.lit(True))))
    held_out = F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out")
    return zstd_language.identify(docs.select("doc_id", held_out, "text"), model).drop("text")


def op11_fim_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for fill-in-middle, and what taking the output apart again gives."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = fim_boundaries.fill_in_middle(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(fim_boundaries.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS s FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
             CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, left(t, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def op12_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 100 bytes that also start earlier."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return prefix_free.remove_repeats(docs).withColumn("kept", F.sha2("kept", 256)).withColumnRenamed("kept", "kept_sha256")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return conversation_trie.trie(conversation_trie.paths(_table(spark, sf_dir, "conversations")))


OP13_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, md5(md5(role) || md5(text)) AS d, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS rn FROM t),
steps AS (
  SELECT conv_id, [4294967295] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
         lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS s FROM (SELECT DISTINCT conv_id FROM t)),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(s, lambda a, v:
         xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1)))) % 4 AS h FROM steps),
lens AS (SELECT conv_id AS base, count(*) AS n FROM o GROUP BY ALL),
rebuilt AS (
  SELECT c.conv_id, rn AS place, d, words FROM c JOIN o ON o.conv_id = c.base AND rn <= h
  UNION ALL
  SELECT c.conv_id, coalesce(least(n, h), 0) + rn - h, d, words
  FROM c JOIN o ON o.conv_id = c.conv_id AND rn > h LEFT JOIN lens USING (base)),
path AS (
  SELECT c.conv_id, coalesce(string_agg(d, '' ORDER BY place), '') AS p, coalesce(list(words ORDER BY place) FILTER (d IS NOT NULL), []) AS w
  FROM c LEFT JOIN rebuilt USING (conv_id) GROUP BY ALL),
along AS (SELECT conv_id, p, w, unnest(range(len(w) + 1)) AS depth FROM path),
node AS (
  SELECT p[1:32 * depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(any_value(CASE WHEN depth > 0 THEN w[depth] END), 0) AS words,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = len(w)) AS ends
  FROM along GROUP BY ALL),
inner_nodes AS (SELECT k[1:32 * (depth - 1)] AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT k[1:32 * e] AS k, count(*) FILTER (k NOT IN (SELECT k FROM inner_nodes)) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS e FROM node) GROUP BY ALL)
SELECT a.conv_id, a.depth, u.conv_id AS parent_conv_id, a.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM node a LEFT JOIN node u ON a.depth > 0 AND u.k = a.k[1:32 * (a.depth - 1)]
LEFT JOIN inner_nodes i ON i.k = a.k JOIN below b ON b.k = a.k
"""

QUERIES = {
    "op1_quality_fm": op1_quality_fm,
    "op2_risk_rules": op2_risk_rules,
    "op3_simhash_windows": op3_simhash_windows,
    "op4_secret_lexer": op4_secret_lexer,
    "op5_attention_lm": op5_attention_lm,
    "op6_bin_completion": op6_bin_completion,
    "op7_license_rules": op7_license_rules,
    "op8_warc_revisit": op8_warc_revisit,
    "op9_trie_join": op9_trie_join,
    "op10_zstd_language": op10_zstd_language,
    "op11_fim_boundaries": op11_fim_boundaries,
    "op12_prefix_free": op12_prefix_free,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLES = {
    "op2_risk_rules": OP2_SQL,
    "op8_warc_revisit": OP8_SQL,
    "op9_trie_join": OP9_SQL,
    "op11_fim_boundaries": OP11_SQL,
    "op13_conversation_trie": OP13_SQL,
}
