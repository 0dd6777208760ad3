"""A rule table that grows with the events, matched through the rule index."""

from __future__ import annotations

from pyspark.sql import functions as F

from logvane.operators import rule_index
from logvane.operators import rules as R
from workload.labeling import ORACLES as LABELING_SQL
from workload.raw_events import NORM_CTE, normalized

FIELDS = [*R.RULE_FIELDS, "message"]


def derived_rules(events):
    """A rule per event: a piece of its message around the user, or its end, some in upper case."""
    key, message = F.col("event_key"), F.col("message")
    around = F.substring(message, F.instr(message, " user ") + 1, F.lit(16) + (key % 9).cast("int"))
    text = F.when(key % 2 == 0, around).otherwise(F.right(message, F.lit(24) + (key % 8).cast("int")))
    return events.select(
        key.cast("int").alias("rule_id"), F.lit(1).alias("tier"), F.lit(None).cast("string").alias("technique"), "event_id",
        F.lit("message").alias("field"), F.when(key % 3 == 0, F.upper(text)).otherwise(text).alias("substring"),
    )


def indexed_rule_matches(spark, sf_dir):
    """The fixed rules through the index: the rows of ``rule_matches``."""
    events = normalized(spark, sf_dir)
    matched = rule_index.match_indexed(events, rule_index.index_rules(R.rules_frame(spark), events))
    return matched.select("event_key", F.array_join(F.transform("rule_ids", lambda i: i.cast("string")), ",").alias("rule_ids"))


def derived_rule_matches(spark, sf_dir):
    """As many rules as events, each event with the number, sum and smallest of the rules it matches."""
    events = normalized(spark, sf_dir)
    index = rule_index.index_rules(derived_rules(events), events, FIELDS, totals=True)
    return rule_index.match_indexed(events, index, FIELDS).select("event_key", "n_rules", "first_rule", "rule_sum")


def rule_index_candidates(spark, sf_dir):
    """What the index spares: pairs of rules and values that a join would test, that the index gives, and that match."""
    events = normalized(spark, sf_dir)
    index = rule_index.index_rules(derived_rules(events), events, ["message"], (rule_index.PIECE,))
    return rule_index.candidate_counts(events, index, ["message"])


QUERIES = {f.__name__: f for f in [indexed_rule_matches, derived_rule_matches, rule_index_candidates]}

_DERIVED_CTE = NORM_CTE + """,
derived AS (
  SELECT event_key AS rule_id, event_id, lower(CASE WHEN event_key % 2 = 0
    THEN substr(message, instr(message, ' user ') + 1, 16 + event_key % 9)
    ELSE right(message, 24 + event_key % 8) END) AS text FROM norm)"""

ORACLES = {
    "indexed_rule_matches": LABELING_SQL["rule_matches"],
    "derived_rule_matches": f"""WITH {_DERIVED_CTE},
        matched AS (SELECT n.event_key, count(*) AS n_rules, min(d.rule_id) AS first_rule, CAST(sum(d.rule_id) AS BIGINT) AS rule_sum
                    FROM norm n JOIN derived d ON n.event_id = d.event_id AND contains(lower(n.message), d.text) GROUP BY 1)
        SELECT event_key, coalesce(n_rules, 0) AS n_rules, first_rule, coalesce(rule_sum, 0) AS rule_sum
        FROM norm LEFT JOIN matched USING (event_key)""",
    "rule_index_candidates": f"""WITH {_DERIVED_CTE},
        texts AS (SELECT DISTINCT event_id, text FROM derived),
        vals AS (SELECT DISTINCT event_id, lower(message) AS value FROM norm),
        val_pieces AS (SELECT DISTINCT event_id, value, substr(value, i, 4) AS piece
                       FROM (SELECT *, unnest(range(1, length(value) - 2)) AS i FROM vals)),
        text_pieces AS (SELECT DISTINCT event_id, text, substr(text, i, 4) AS piece
                        FROM (SELECT *, unnest(range(1, length(text) - 2)) AS i FROM texts)),
        counts AS (SELECT event_id, piece, count(*) AS n FROM val_pieces GROUP BY ALL),
        filed AS (SELECT event_id, text, piece FROM text_pieces LEFT JOIN counts USING (event_id, piece)
                  QUALIFY row_number() OVER (PARTITION BY event_id, text ORDER BY coalesce(n, 0), piece) = 1),
        met AS (SELECT contains(value, text) AS hit FROM val_pieces JOIN filed USING (event_id, piece))
        SELECT (SELECT count(*) FROM texts) AS n_texts, (SELECT count(*) FROM vals) AS n_values,
          (SELECT CAST(sum(a.n * b.n) AS BIGINT) FROM (SELECT event_id, count(*) AS n FROM texts GROUP BY 1) a
           JOIN (SELECT event_id, count(*) AS n FROM vals GROUP BY 1) b USING (event_id)) AS n_pairs,
          (SELECT count(*) FROM met) AS n_candidates, (SELECT count(*) FROM met WHERE hit) AS n_matches""",
}
