"""JSON lines to a typed event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.functions import coerce as C
from logvane.functions.text import BLANKS
from logvane.session import collect_bounded, fence

# The columns of a normalized event.
NORMALIZED_COLUMNS = [
    "timestamp", "hour_of_day", "day_of_week", "event_id", "channel", "source_name", "severity",
    "severity_value", "hostname", "account_name", "domain", "is_system", "image", "image_base",
    "process_depth", "process_id", "target_image", "target_image_base", "granted_access",
    "target_object", "target_filename", "message", "message_len",
]
# the keys read from a raw event; VARIANT where number, text, null and absence mean different things
EVENT_SCHEMA = (
    "EventTime string, EventID variant, Channel variant, SourceName variant, Severity variant, "
    "SeverityValue variant, Hostname variant, AccountName variant, Domain variant, Image string, "
    "SourceImage string, TargetImage string, TargetObject string, TargetFilename string, Message string, "
    "ProcessId variant, SourceProcessId variant, GrantedAccess string"
)


def parse_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Add ``is_bad`` and the parsed ``event`` per non-blank line.

    A line is good when it holds exactly one JSON object. The array-length
    check sees what the schema-driven parser skips: text after the object, or
    a second object on the same line.
    """
    line = F.col(line_col)
    # most lines need no trimming, and looking at both ends is cheaper than trimming
    clean = F.when(line.startswith("{") & line.endswith("}"), line).otherwise(F.btrim(line, F.lit(BLANKS)))
    one_value = F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))) == 1
    return (
        lines.withColumn(line_col, clean)
        .filter(line != "")
        .withColumn("is_bad", (~(line.startswith("{") & F.coalesce(one_value, F.lit(False)))).cast("int"))
        .withColumn("event", F.from_json(line, EVENT_SCHEMA))
    )


def good_events(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("is_bad") == 0)


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("is_bad") == 1).drop("event", "is_bad")


def line_counts(parsed: DataFrame) -> DataFrame:
    """How many lines parsed and how many did not."""
    return parsed.groupBy("is_bad").agg(F.count("*").alias("n_lines"))


def normalize(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Flatten ``event`` into the fixed 23 columns; ``keep`` names columns passed through.

    Each JSON text is parsed once: the fence stops the optimizer from copying
    the parse into filters that are later put on the typed columns.
    """
    e = F.col("event")
    keep = keep or []
    staged = good_events(parsed).select(
        *keep,
        e,
        C.event_time(e["EventTime"]).alias("ts"),
        C.first_nonblank(e["Image"], e["SourceImage"]).alias("image"),
        C.first_nonblank(e["TargetImage"]).alias("target_image"),
        C.first_nonblank(e["Message"]).alias("message"),
        C.text_or_blank(e["AccountName"]).alias("account_name"),
        C.text_or_blank(e["Channel"]).alias("channel"),
    )
    fields = [
        F.col("ts").cast("timestamp_ntz").alias("event_ts"),
        C.iso_text(F.col("ts")).alias("timestamp"),
        C.hour_or_missing(F.col("ts")).alias("hour_of_day"),
        C.weekday_or_missing(F.col("ts")).alias("day_of_week"),
        C.safe_int(e["EventID"]).alias("event_id"),
        F.col("channel"),
        C.text_or_blank(e["SourceName"]).alias("source_name"),
        C.text_or_blank(e["Severity"]).alias("severity"),
        C.safe_int(e["SeverityValue"]).alias("severity_value"),
        C.text_or_blank(e["Hostname"]).alias("hostname"),
        F.col("account_name"),
        C.text_or_blank(e["Domain"]).alias("domain"),
        C.system_flag(F.col("account_name")).alias("is_system"),
        F.col("image"),
        C.base_name(F.col("image")).alias("image_base"),
        C.path_depth(F.col("image")).alias("process_depth"),
        C.first_given_int(e["ProcessId"], e["SourceProcessId"]).alias("process_id"),
        F.col("target_image"),
        C.base_name(F.col("target_image")).alias("target_image_base"),
        C.hex_to_int(e["GrantedAccess"]).alias("granted_access"),
        C.first_nonblank(e["TargetObject"]).alias("target_object"),
        C.first_nonblank(e["TargetFilename"]).alias("target_filename"),
        F.col("message"),
        F.length("message").alias("message_len"),
        C.channel_bucket(F.col("channel")).alias("channel_bucket"),
    ]
    return fence(staged.select(*keep, *fields))


def top_event_ids(events: DataFrame, n: int = 15) -> list[int]:
    """The ``n`` most frequent event ids, ties by id; n numbers reach the driver."""
    top = (
        events.groupBy("event_id").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "event_id").limit(n)
    )
    return [row["event_id"] for row in collect_bounded(top, n, "event ids")]


def one_hot_event_ids(events: DataFrame, event_ids: list[int]) -> DataFrame:
    """One byte column ``eid_<id>`` per given id."""
    return events.withColumns(
        {f"eid_{i}": F.coalesce((F.col("event_id") == i).cast("byte"), F.lit(0).cast("byte")) for i in event_ids}
    )


def text_column(df: DataFrame, name: str):
    """The column with NULL as '', or '' where the table has no such column."""
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")
