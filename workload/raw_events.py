"""Sysmon-like JSON lines derived from the ``events`` table, in Spark and in SQL.

The SQL never reads the JSON: it states the normalized columns directly, so a
query and its oracle share only the rule below and the table. With k from
``props`` and u = user_id every raw field is a function of one ``events`` row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvane.operators.normalize import normalize, parse_lines
from logvane.operators.rules import TIER1, TIER2, label
from logvane.session import fence, spread_small, work_path
from logvane.sources.tables import read_stage, write_stage


TEXT_TABLES = {"documents", "events", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # text work is heavy per row, and these tables may be a single file
    return spread_small(df) if name in TEXT_TABLES else df


IMAGES = [
    "C:\\Windows\\System32\\svchost.exe",
    "C:\\Temp\\svchost.exe",
    "C:\\Windows\\System32\\cmd.exe",
    "C:\\Windows\\explorer.exe",
    "C:\\Tools\\dotnet.exe",
    "C:\\Tools\\mimikatz.exe",
    "C:\\Windows\\System32\\WindowsPowerShell\\powershell.exe",
    None,
]


def _pick(index, options):
    result = F.lit(options[-1])
    for i, option in reversed(list(enumerate(options[:-1]))):
        result = F.when(index == i, F.lit(option)).otherwise(result)
    return result


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_key, line``: one JSON line per row of ``events``, some of them broken."""
    return to_lines(table(spark, sf_dir, "events"))


def to_lines(events: DataFrame) -> DataFrame:
    # looked up once a row: most fields ask for it, several times and in branches
    events = events.select("event_id", "user_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    k = F.col("k")
    u = F.col("user_id")
    e = F.col("event_type")
    eid = (
        F.when(e == "error", 10).when(e == "purchase", 13).when(e == "signup", 1).when(e == "click", 3)
        .when(k % 5 == 0, 8).otherwise(11)
    )
    time = F.when(k % 17 == 0, F.lit("n/a")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    image = _pick(u % 8, IMAGES)
    access = (
        F.when(k % 11 == 0, F.lit("0xZZ")).when(k % 7 == 0, F.lit("16"))
        .otherwise(F.concat(F.lit("0x"), F.hex(k)))
    )
    message = F.concat_ws(
        " ", e, F.lit("by user"), u.cast("string"), F.coalesce(image, F.lit("unknown")),
        F.concat(F.lit("{8A5F3B2C-"), F.lpad(k.cast("string"), 4, "0"), F.lit("}")), access, time,
    )
    raw = events.select(
        F.col("event_id").alias("event_key"),
        F.to_json(
            F.struct(
                time.alias("EventTime"),
                eid.alias("EventID"),
                _pick(k % 4, ["Microsoft-Windows-Sysmon/Operational", "Security", "System", "Foo"]).alias("Channel"),
                F.when(k % 6 == 0, F.lit("x")).otherwise((k % 6).cast("string")).alias("SeverityValue"),
                F.concat(F.lit("host"), (u % 10).cast("string")).alias("Hostname"),
                _pick(u % 3, ["system", None, "alice"]).alias("AccountName"),
                F.when(u % 3 == 2, F.lit("CORP")).otherwise(F.lit("NT AUTHORITY")).alias("Domain"),
                image.alias("Image"),
                F.lit("C:\\Src\\agent.exe").alias("SourceImage"),
                F.when((eid == 10) & (k % 2 == 0), F.lit("C:\\Windows\\System32\\lsass.exe")).alias("TargetImage"),
                F.when(eid == 13, _pick(k % 3, [
                    "HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run\\x", "HKLM\\SYSTEM\\Services\\y", "HKLM\\z",
                ])).alias("TargetObject"),
                F.when((eid == 11) & (k % 4 == 0), F.lit("C:\\Users\\a.PS1"))
                .when(eid == 11, F.lit("C:\\Users\\b.txt")).alias("TargetFilename"),
                access.alias("GrantedAccess"),
                (u % 5).alias("ProcessId"),
                (u + 1000).alias("SourceProcessId"),
                message.alias("Message"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("good_line"),
    )
    broken = F.col("event_key") % 97 == 0
    return fence(raw.select("event_key", F.when(broken, F.lit("broken{")).otherwise(F.col("good_line")).alias("line")))


_STAGE_PATHS: dict[tuple[str, str], str] = {}


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalized stage table: written once per session, then read by every later stage."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STAGE_PATHS:
        path = work_path(spark, "normalized")
        write_stage(normalize(parse_lines(raw_lines(spark, sf_dir)), keep=["event_key"]), path)
        _STAGE_PATHS[key] = path
    return read_stage(spark, _STAGE_PATHS[key])


def labeled(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    return label(normalized(spark, sf_dir), strict)


def _sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


_IMAGE_CASE = "CASE u % 8 " + " ".join(f"WHEN {i} THEN {_sql_text(p)}" for i, p in enumerate(IMAGES)) + " END"

# one row per good line, holding the raw field values
RAW_CTE = f"""
raw0 AS (
  SELECT event_id AS event_key, user_id AS u, event_type AS e, ts,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
),
raw1 AS (
  SELECT *,
    CAST(CASE e WHEN 'error' THEN 10 WHEN 'purchase' THEN 13 WHEN 'signup' THEN 1 WHEN 'click' THEN 3
         ELSE CASE WHEN k % 5 = 0 THEN 8 ELSE 11 END END AS BIGINT) AS eid,
    CASE WHEN k % 17 = 0 THEN NULL ELSE date_trunc('second', ts) END AS ets,
    {_IMAGE_CASE} AS raw_image,
    CASE WHEN k % 11 = 0 THEN '0xZZ' WHEN k % 7 = 0 THEN '16' ELSE '0x' || upper(to_hex(k)) END AS access
  FROM raw0 WHERE event_key % 97 <> 0
)"""

NORM_CTE = RAW_CTE + """,
norm0 AS (
  SELECT event_key, ets AS event_ts,
    coalesce(strftime(ets, '%Y-%m-%dT%H:%M:%S'), '') AS "timestamp",
    CAST(coalesce(hour(ets), -1) AS INTEGER) AS hour_of_day,
    CAST(coalesce(isodow(ets) - 1, -1) AS INTEGER) AS day_of_week,
    eid AS event_id,
    CASE k % 4 WHEN 0 THEN 'Microsoft-Windows-Sysmon/Operational' WHEN 1 THEN 'Security'
               WHEN 2 THEN 'System' ELSE 'Foo' END AS channel,
    '' AS source_name, '' AS severity,
    CAST(k % 6 AS BIGINT) AS severity_value,
    'host' || (u % 10) AS hostname,
    CASE u % 3 WHEN 0 THEN 'system' WHEN 2 THEN 'alice' END AS account_name,
    CASE WHEN u % 3 = 2 THEN 'CORP' ELSE 'NT AUTHORITY' END AS "domain",
    CASE WHEN u % 3 = 0 THEN 1 ELSE 0 END AS is_system,
    coalesce(raw_image, 'C:\\Src\\agent.exe') AS image,
    CASE WHEN u % 5 <> 0 THEN u % 5 ELSE u + 1000 END AS process_id,
    CASE WHEN eid = 10 AND k % 2 = 0 THEN 'C:\\Windows\\System32\\lsass.exe' ELSE '' END AS target_image,
    CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN 0 ELSE k END AS granted_access,
    CASE WHEN eid <> 13 THEN ''
         WHEN k % 3 = 0 THEN 'HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run\\x'
         WHEN k % 3 = 1 THEN 'HKLM\\SYSTEM\\Services\\y' ELSE 'HKLM\\z' END AS target_object,
    CASE WHEN eid <> 11 THEN '' WHEN k % 4 = 0 THEN 'C:\\Users\\a.PS1' ELSE 'C:\\Users\\b.txt' END AS target_filename,
    e || ' by user ' || u || ' ' || coalesce(raw_image, 'unknown') || ' {8A5F3B2C-' || lpad(CAST(k AS VARCHAR), 4, '0')
      || '} ' || access || ' ' || coalesce(strftime(ets, '%Y-%m-%d %H:%M:%S'), 'n/a') AS message
  FROM raw1
),
norm AS (
  SELECT *, lower(string_split(image, '\\')[-1]) AS image_base,
    CAST(length(image) - length(replace(image, '\\', '')) AS INTEGER) AS process_depth,
    lower(string_split(target_image, '\\')[-1]) AS target_image_base,
    CAST(length(message) AS INTEGER) AS message_len,
    CASE WHEN contains(channel, 'Sysmon') THEN 'Sysmon' WHEN channel IN ('Security', 'System') THEN channel
         ELSE 'Other' END AS channel_bucket
  FROM norm0
)"""

_RULE_VALUES = ",\n    ".join(
    f"({i}, 1, {_sql_text(t)}, {e}, {_sql_text(f)}, {_sql_text(s)})" for i, (e, f, s, t) in enumerate(TIER1, start=1)
)
_TOOL_VALUES = ", ".join(f"({i}, {_sql_text(n)})" for i, n in enumerate(TIER2, start=len(TIER1) + 1))

# a row per (event, matched rule); rule 0 is the path check on svchost
HITS_CTE = NORM_CTE + f""",
rules(rule_id, tier, technique, event_id, field, sub) AS (VALUES
    {_RULE_VALUES}),
tools(rule_id, name) AS (VALUES {_TOOL_VALUES}),
hits AS (
  SELECT n.event_key, r.rule_id, r.technique FROM norm n JOIN rules r ON n.event_id = r.event_id
   AND contains(lower(CASE r.field WHEN 'image_base' THEN image_base WHEN 'target_image' THEN target_image
                WHEN 'target_object' THEN target_object ELSE target_filename END), lower(r.sub))
  UNION ALL SELECT n.event_key, t.rule_id, NULL FROM norm n JOIN tools t ON n.image_base = t.name
  UNION ALL SELECT event_key, 0, 'T1036' FROM norm
   WHERE event_id = 1 AND image_base = 'svchost.exe' AND NOT contains(lower(image), 'system32')
)"""

LABELED_CTE = HITS_CTE + """,
labeled AS (
  SELECT n.*, CASE WHEN h.event_key IS NULL THEN 0 ELSE 1 END AS ground_truth
  FROM norm n LEFT JOIN (SELECT DISTINCT event_key FROM hits) h USING (event_key)
)"""
