"""Parsing, normalizing and rule labelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from logvane.operators import normalize as N
from logvane.operators import rules as R
from logvane.operators import summaries as S
from logvane.sources import archives, ndjson, tables
from logvane.session import work_path
from workload.packing import ARCHIVES, MEMBERS, packed_lines
from workload.raw_events import HITS_CTE, LABELED_CTE, NORM_CTE, labeled, normalized, raw_lines

NORM_LIST = ", ".join(f'"{c}"' for c in ["event_key", "event_ts", *N.NORMALIZED_COLUMNS, "channel_bucket"])


def normalize_events(spark, sf_dir):
    return N.normalize(N.parse_lines(raw_lines(spark, sf_dir)), keep=["event_key"])


def bad_line_counts(spark, sf_dir):
    return N.line_counts(N.parse_lines(raw_lines(spark, sf_dir)))


def quarantined_lines(spark, sf_dir):
    return N.quarantine(N.parse_lines(raw_lines(spark, sf_dir)))


def ndjson_files(spark, sf_dir):
    """Write the lines as nested files, discover them recursively, parse and count."""
    root = work_path(spark, "ndjson")
    lines = raw_lines(spark, sf_dir)
    ndjson.write_lines(lines.withColumn("part", F.col("event_key") % 4), root, partition_by="part")
    parsed = N.parse_lines(ndjson.read_lines(spark, root, "*.txt"))
    return N.normalize(parsed).groupBy("event_id", "hostname").agg(
        F.count("*").alias("n_events"), F.sum("message_len").alias("sum_len")
    )


def archive_members(spark, sf_dir):
    """The lines of all members of the archives in a folder, parsed and counted."""
    lines = archives.read_archives(spark, packed_lines(spark, sf_dir)).filter("error is null")
    return N.normalize(N.parse_lines(lines)).groupBy("event_id").agg(
        F.count("*").alias("n_events"), F.sum("message_len").alias("sum_len")
    )


def archive_directory(spark, sf_dir):
    """Every member of every archive with its size as listed, its lines as read, and the faults met."""
    members = archives.list_members(spark, packed_lines(spark, sf_dir))
    lines = archives.read_members(members).groupBy("path", "member").agg(
        F.count("line").alias("n_lines"), F.sum(F.length("line") + 1).alias("n_chars"), F.count("error").alias("n_faults"))
    return members.join(lines, ["path", "member"], "left").select(
        F.regexp_extract("path", r"[^/]+$", 0).alias("archive"), "member", F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        (F.col("bytes") == F.coalesce("n_chars", "bytes")).alias("whole"), F.coalesce("n_faults", F.lit(0)).alias("n_faults"))


def stage_table(spark, sf_dir):
    """Labelled events written as a stage table, overwritten, read back with pruned columns."""
    path = work_path(spark, "labeled")
    tables.write_stage(labeled(spark, sf_dir), path)
    tables.write_stage(labeled(spark, sf_dir), path)
    return tables.read_stage(spark, path).filter(F.col("ground_truth") == 1).select("event_key", "event_id", "hostname")


def json_records(spark, sf_dir):
    """Result records through JSON files and back."""
    path = work_path(spark, "records")
    records = normalized(spark, sf_dir).select("event_key", "hostname", "message", "granted_access")
    tables.write_records(records, path)
    return tables.read_records(spark, path, records.schema)


def rule_labels(spark, sf_dir):
    return labeled(spark, sf_dir).select("event_key", "ground_truth")


def rule_labels_strict(spark, sf_dir):
    return labeled(spark, sf_dir, strict=True).select("event_key", "ground_truth")


def rule_tiers(spark, sf_dir):
    return normalized(spark, sf_dir).select(
        "event_key",
        R.tier1_match().cast("int").alias("tier1"),
        R.misplaced_svchost().cast("int").alias("misplaced"),
        R.tier2_match().cast("int").alias("tier2"),
    )


def rule_techniques(spark, sf_dir):
    return R.attribute(normalized(spark, sf_dir)).select(
        "event_key", F.array_join("techniques", ",").alias("techniques")
    )


def rule_matches(spark, sf_dir):
    matched = R.match_rules(normalized(spark, sf_dir), R.rules_frame(spark))
    return matched.select(
        "event_key",
        F.array_join(F.transform("rule_ids", lambda i: i.cast("string")), ",").alias("rule_ids"),
    )


def class_balance(spark, sf_dir):
    return S.class_balance(labeled(spark, sf_dir))


def label_breakdown(spark, sf_dir):
    return S.label_breakdown(labeled(spark, sf_dir)).withColumn(
        "image_examples", F.array_join("image_examples", ",")
    )


def onehot_top_events(spark, sf_dir):
    events = normalized(spark, sf_dir)
    ids = N.top_event_ids(events)
    hot = N.one_hot_event_ids(events, ids)
    return hot.select("event_key", *sorted(f"eid_{i}" for i in ids))


QUERIES = {
    f.__name__: f
    for f in [
        normalize_events, bad_line_counts, quarantined_lines, ndjson_files, archive_members, archive_directory,
        stage_table,
        json_records, rule_labels, rule_labels_strict, rule_tiers, rule_techniques, rule_matches, class_balance,
        label_breakdown, onehot_top_events,
    ]
}

ORACLES = {
    "normalize_events": f"WITH {NORM_CTE} SELECT {NORM_LIST} FROM norm",
    "bad_line_counts": """
        SELECT CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS is_bad, count(*) AS n_lines FROM events GROUP BY 1""",
    "quarantined_lines": "SELECT event_id AS event_key, 'broken{' AS line FROM events WHERE event_id % 97 = 0",
    "ndjson_files": f"""WITH {NORM_CTE} SELECT event_id, hostname, count(*) AS n_events,
        CAST(sum(message_len) AS BIGINT) AS sum_len FROM norm GROUP BY ALL""",
    "archive_members": f"""WITH {NORM_CTE} SELECT event_id, count(*) AS n_events,
        CAST(sum(message_len) AS BIGINT) AS sum_len FROM norm GROUP BY ALL""",
    "archive_directory": f"""
        SELECT 'day-' || (event_id % {ARCHIVES}) || '.zip' AS archive, 'logs/' || (event_id // {ARCHIVES} % {MEMBERS}) || '.json' AS member,
          count(*) AS n_lines, true AS whole, CAST(0 AS BIGINT) AS n_faults FROM events GROUP BY ALL
        UNION ALL SELECT DISTINCT 'day-' || (event_id % {ARCHIVES}) || '.zip', 'README.txt', 0, true, 0 FROM events""",
    "stage_table": f"""WITH {LABELED_CTE} SELECT event_key, event_id, hostname FROM labeled WHERE ground_truth = 1""",
    "json_records": f"WITH {NORM_CTE} SELECT event_key, hostname, message, granted_access FROM norm",
    "rule_labels": f"WITH {LABELED_CTE} SELECT event_key, ground_truth FROM labeled",
    "rule_labels_strict": f"""WITH {HITS_CTE},
        kept AS (SELECT DISTINCT h.event_key FROM hits h JOIN norm n USING (event_key)
                 LEFT JOIN rules r ON h.rule_id = r.rule_id
                 WHERE h.rule_id <> 20 AND (r.field IS NULL OR r.field <> 'image_base' OR n.image_base = r.sub))
        SELECT n.event_key, CASE WHEN k.event_key IS NULL THEN 0 ELSE 1 END AS ground_truth
        FROM norm n LEFT JOIN kept k USING (event_key)""",
    "rule_tiers": f"""WITH {HITS_CTE}
        SELECT n.event_key,
          CAST(coalesce(bool_or(h.rule_id <= 20), false) AS INTEGER) AS tier1,
          CAST(coalesce(bool_or(h.rule_id = 0), false) AS INTEGER) AS misplaced,
          CAST(coalesce(bool_or(h.rule_id > 20), false) AS INTEGER) AS tier2
        FROM norm n LEFT JOIN hits h USING (event_key) GROUP BY n.event_key""",
    "rule_techniques": f"""WITH {HITS_CTE}
        SELECT n.event_key, coalesce(string_agg(h.technique, ',' ORDER BY h.technique), '') AS techniques
        FROM norm n LEFT JOIN (SELECT DISTINCT event_key, technique FROM hits WHERE technique IS NOT NULL) h
          USING (event_key) GROUP BY n.event_key""",
    "rule_matches": f"""WITH {HITS_CTE}
        SELECT n.event_key, coalesce(string_agg(CAST(h.rule_id AS VARCHAR), ',' ORDER BY h.rule_id), '') AS rule_ids
        FROM norm n LEFT JOIN (SELECT * FROM hits WHERE rule_id > 0) h USING (event_key) GROUP BY n.event_key""",
    "class_balance": f"""WITH {LABELED_CTE}
        SELECT ground_truth, count(*) AS n_events,
          round(100.0 * count(*) / (SELECT count(*) FROM labeled), 4) AS pct FROM labeled GROUP BY 1""",
    "label_breakdown": f"""WITH {LABELED_CTE}
        SELECT event_id, count(*) AS n_events,
          array_to_string(list_sort(list(DISTINCT image_base))[1:3], ',') AS image_examples
        FROM labeled WHERE ground_truth = 1 GROUP BY 1 ORDER BY n_events DESC, event_id LIMIT 12""",
    "onehot_top_events": f"""WITH {NORM_CTE}
        SELECT event_key, """ + ", ".join(
        f"CAST(event_id = {i} AS TINYINT) AS eid_{i}" for i in (1, 3, 8, 10, 11, 13)
    ) + " FROM norm",
}
