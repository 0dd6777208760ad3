"""Technique-mapped detection rules and the labels they give."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Rule(NamedTuple):
    rule_id: int
    tier: int
    technique: str | None
    event_id: int | None
    field: str
    substring: str


# The labelling rules (event id, field, contained text, technique).
TIER1 = [
    (10, "target_image", "lsass.exe", "T1003.001"),
    (13, "target_object", "\\CurrentVersion\\Run", "T1547.001"),
    (13, "target_object", "\\CurrentVersion\\RunOnce", "T1547.001"),
    (1, "image_base", "powershell.exe", "T1059.001"),
    (1, "image_base", "cmd.exe", "T1059.001"),
    (3, "image_base", "net.exe", "T1021.002"),
    (3, "image_base", "net1.exe", "T1021.002"),
    (8, "target_image", "", "T1055"),
    (13, "target_object", "\\Services\\", "T1543.003"),
    (1, "image_base", "wevtutil.exe", "T1070.001"),
    (1, "image_base", "schtasks.exe", "T1053.005"),
    (11, "target_filename", "\\Tasks\\", "T1053.005"),
    (11, "target_filename", ".ps1", "T1027"),
    (11, "target_filename", ".vbs", "T1027"),
    (11, "target_filename", ".hta", "T1027"),
    (1, "image_base", "rundll32.exe", "T1218.011"),
    (1, "image_base", "regsvr32.exe", "T1218.011"),
    (3, "image_base", "powershell.exe", "T1071.001"),
    (1, "image_base", "certutil.exe", "T1140"),
    (1, "image_base", "svchost.exe", "T1036"),
]
# Base names of known offensive tools.
TIER2 = [
    "mimikatz.exe", "psexec.exe", "psexecsvc.exe", "cobalt strike", "meterpreter", "empire", "covenant",
    "pwdump", "fgdump", "wce.exe", "gsecdump.exe", "lsadump", "procdump.exe", "rubeus.exe", "kerbrute.exe",
    "bloodhound.exe", "sharphound.exe", "invoke-mimikatz", "invoke-bloodhound",
]
MASQUERADE = "T1036"

RULES = [
    Rule(i, 1, technique, event_id, field, text)
    for i, (event_id, field, text, technique) in enumerate(TIER1, start=1)
] + [Rule(i, 2, None, None, "image_base", name) for i, name in enumerate(TIER2, start=len(TIER1) + 1)]

RULE_FIELDS = ["image_base", "target_image", "target_object", "target_filename"]
RULE_SCHEMA = "rule_id int, tier int, technique string, event_id long, field string, substring string"


def rules_frame(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], RULE_SCHEMA)


def _lowered(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def _hit(rule: Rule, strict: bool) -> Column:
    """The text part of a rule; ``strict`` compares base names whole, so ``net.exe`` no longer hits ``dotnet.exe``."""
    value = _lowered(rule.field)
    if rule.tier == 2 or (strict and rule.field == "image_base"):
        return value == rule.substring.lower()
    return value.contains(rule.substring.lower()) if rule.substring else F.lit(True)


def rule_condition(rule: Rule, strict: bool = False) -> Column:
    """Whether one rule matches a row."""
    hit = _hit(rule, strict)
    if rule.event_id is not None:
        hit = (F.coalesce(F.col("event_id"), F.lit(-1)) == rule.event_id) & hit
    return hit


def misplaced_svchost() -> Column:
    """Process creation of svchost outside System32."""
    return (
        (F.coalesce(F.col("event_id"), F.lit(-1)) == 1)
        & (_lowered("image_base") == "svchost.exe")
        & ~_lowered("image").contains("system32")
    )


def _conditions(strict: bool) -> list[tuple[str | None, Column]]:
    rules = RULES
    if strict:
        # the plain svchost row would make the path check pointless
        rules = [r for r in RULES if not (r.tier == 1 and r.substring == "svchost.exe")]
    return [(r.technique, rule_condition(r, strict)) for r in rules] + [(MASQUERADE, misplaced_svchost())]


def tier1_match(strict: bool = False) -> Column:
    """Any tier-1 rule: rules of one event id are tested only on rows of that id."""
    rules = [r for r in RULES if r.tier == 1 and not (strict and r.substring == "svchost.exe")]
    event_id = F.coalesce(F.col("event_id"), F.lit(-1))
    per_event = [
        (event_id == e) & reduce(Column.__or__, [_hit(r, strict) for r in rules if r.event_id == e])
        for e in sorted({r.event_id for r in rules})
    ]
    return reduce(Column.__or__, per_event) | misplaced_svchost()


def tier2_match() -> Column:
    return _lowered("image_base").isin(TIER2)


def label(events: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``ground_truth`` (0/1): one projection, no join, no shuffle."""
    return events.withColumn("ground_truth", (tier1_match(strict) | tier2_match()).cast("int"))


def attribute(events: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``techniques``: sorted distinct technique ids of the rules a row matches."""
    hits = [F.when(cond, F.lit(technique)) for technique, cond in _conditions(strict) if technique]
    return events.withColumn("techniques", F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))))


def match_rules(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule_ids``: the sorted ids of all rows of a rule table an event matches.

    Rules are first folded into one row per event id (or tool name), so each
    event meets at most one row per join and is never multiplied or regrouped.
    No broadcast is forced: the folded table is broadcast when its measured
    size allows, and otherwise joined by key with adaptive skew splitting.
    """
    by_event = (
        rules.filter(F.col("event_id").isNotNull()).groupBy("event_id")
        .agg(F.collect_list(F.struct("rule_id", "field", "substring")).alias("_event_rules"))
    )
    by_name = (
        rules.filter(F.col("event_id").isNull())
        .groupBy(F.col("substring").alias("_name"))
        .agg(F.collect_list("rule_id").alias("_name_ids"))
    )

    def value_of(rule):
        value = F.lit(None).cast("string")
        for name in RULE_FIELDS:
            value = F.when(rule["field"] == name, _lowered(name)).otherwise(value)
        return value

    joined = (
        events.join(by_event, "event_id", "left")
        .join(by_name, _lowered("image_base") == F.col("_name"), "left")
    )
    event_ids = F.transform(
        F.filter("_event_rules", lambda r: F.coalesce(value_of(r).contains(F.lower(r["substring"])), F.lit(False))),
        lambda r: r["rule_id"],
    )
    none = F.array().cast("array<int>")
    ids = F.concat(F.coalesce(event_ids, none), F.coalesce(F.col("_name_ids"), none))
    return joined.withColumn("rule_ids", F.array_sort(ids)).drop("_event_rules", "_name", "_name_ids")
