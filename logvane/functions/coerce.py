"""Column functions that turn loosely typed JSON fields into typed values.

``field`` is a VARIANT column holding one JSON scalar: SQL NULL where the key
is missing, a variant null where the JSON says null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_text(field: Column) -> Column:
    return F.try_variant_get(field, "$", "string")


def text_or_blank(field: Column) -> Column:
    """Missing key gives ''; an explicit JSON null stays NULL."""
    return F.when(~F.is_variant_null(field), F.coalesce(_as_text(field), F.lit("")))


def first_nonblank(*columns: Column) -> Column:
    """First value that is neither NULL nor '', else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def parse_int_text(text: Column) -> Column:
    """Whole-number text (sign, blanks around and digit underscores allowed), else NULL."""
    trimmed = F.trim(text)
    plain = trimmed.rlike("^[+-]?[0-9]+(_[0-9]+)*$")
    return F.when(plain, F.replace(trimmed, F.lit("_"), F.lit("")).try_cast("bigint"))


def safe_int(field: Column, default: int = 0) -> Column:
    """Numbers are truncated, whole-number strings parsed, all else is the default."""
    return F.coalesce(
        F.try_variant_get(field, "$", "bigint"),
        parse_int_text(_as_text(field)),
        F.lit(default).cast("bigint"),
    )


def is_falsy(field: Column) -> Column:
    """True for missing, null, blank text, false and numeric zero (the text "0" counts as given)."""
    text = _as_text(field)
    zero = F.coalesce(F.try_variant_get(field, "$", "double") == 0, F.lit(False))
    return text.isNull() | (text == "") | (zero & (F.schema_of_variant(field) != "STRING"))


def first_given_int(*fields: Column) -> Column:
    """Integer of the first field that is not falsy."""
    result = F.lit(0).cast("bigint")
    for field in reversed(fields):
        result = F.when(~is_falsy(field), safe_int(field)).otherwise(result)
    return result


def hex_to_int(text: Column) -> Column:
    """``0x``-prefixed text to a number, everything else to 0."""
    return F.when(
        text.rlike("^0[xX][0-9a-fA-F]+$"),
        F.coalesce(F.conv(F.substring(text, 3, 64), 16, 10).try_cast("bigint"), F.lit(0).cast("bigint")),
    ).otherwise(F.lit(0).cast("bigint"))


def event_time(text: Column) -> Column:
    """``2020-05-01 22:55:25`` (one-digit parts allowed) to a timestamp, else NULL."""
    return F.try_to_timestamp(text, F.lit("yyyy-M-d H:m:s"))


def iso_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def hour_or_missing(ts: Column) -> Column:
    return F.coalesce(F.hour(ts), F.lit(-1))


def weekday_or_missing(ts: Column) -> Column:
    """Monday is 0."""
    return F.coalesce(F.weekday(ts), F.lit(-1))


def path_depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("\\"), F.lit("")))


def base_name(path: Column) -> Column:
    return F.lower(F.substring_index(path, "\\", -1))


def system_flag(account: Column) -> Column:
    return F.coalesce((F.upper(account) == "SYSTEM").cast("int"), F.lit(0))


def channel_bucket(channel: Column) -> Column:
    found = F.regexp_extract(channel, "(Sysmon|Security|System|Application)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("Other"))
