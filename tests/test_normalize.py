import json

import pytest
from plans import plan_of

from logvane.operators import normalize as N


def run(spark, *records):
    lines = [r if isinstance(r, str) else json.dumps(r) for r in records]
    df = spark.createDataFrame(list(enumerate(lines)), "event_key long, line string")
    return N.parse_lines(df)


def normalized(spark, *records):
    rows = N.normalize(run(spark, *records), ["event_key"]).orderBy("event_key").collect()
    return rows


def test_columns(spark):
    df = N.normalize(run(spark, {"EventID": 1}))
    assert df.columns == ["event_ts", *N.NORMALIZED_COLUMNS, "channel_bucket"]


@pytest.mark.parametrize(
    "value, expected",
    [("12", 12), (" 12 ", 12), (12, 12), (1.9, 1), ("1.9", 0), ("abc", 0), (None, 0), (True, 1), ("1_000", 1000),
     ("-7", -7), ([1], 0)],
)
def test_integers(spark, value, expected):
    assert normalized(spark, {"EventID": value})[0]["event_id"] == expected


@pytest.mark.parametrize(
    "value, expected",
    [("0x1FFFFF", 2097151), ("0X1f", 31), ("0x", 0), ("0xZZ", 0), ("0x1G", 0), ("16", 0), (16, 0), (None, 0)],
)
def test_hex_masks(spark, value, expected):
    assert normalized(spark, {"GrantedAccess": value})[0]["granted_access"] == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2020-05-01 22:55:25", ("2020-05-01T22:55:25", 22, 4)), ("2020-5-1 2:5:5", ("2020-05-01T02:05:05", 2, 4)),
        ("2020-05-01T22:55:25", ("", -1, -1)), ("", ("", -1, -1)), (None, ("", -1, -1)),
        ("2020-05-01 22:55:25.1", ("", -1, -1)),
    ],
)
def test_times(spark, value, expected):
    row = normalized(spark, {"EventTime": value})[0]
    assert (row["timestamp"], row["hour_of_day"], row["day_of_week"]) == expected


def test_paths(spark):
    rows = normalized(spark, {"Image": "C:\\Windows\\System32\\LSASS.EXE"}, {}, {"Image": "cmd.exe"})
    assert [(r["process_depth"], r["image_base"]) for r in rows] == [(3, "lsass.exe"), (0, ""), (0, "cmd.exe")]


def test_alternative_fields(spark):
    rows = normalized(
        spark, {"Image": "", "SourceImage": "x"}, {"ProcessId": 0, "SourceProcessId": 7},
        {"ProcessId": "0", "SourceProcessId": 7}, {"ProcessId": "", "SourceProcessId": "8"}, {"ProcessId": False},
    )
    assert rows[0]["image"] == "x"
    assert [r["process_id"] for r in rows[1:]] == [7, 0, 8, 0]


def test_missing_against_null(spark):
    missing, null = normalized(spark, {}, {"Channel": None, "AccountName": None, "Image": None})
    assert (missing["channel"], missing["account_name"]) == ("", "")
    assert (null["channel"], null["account_name"], null["image"]) == (None, None, "")
    assert (null["is_system"], null["channel_bucket"]) == (0, "Other")


def test_buckets_and_system(spark):
    rows = normalized(
        spark, {"Channel": "Microsoft-Windows-Sysmon/Operational", "AccountName": "System"}, {"Channel": "Security"},
        {"Channel": "security"}, {"Channel": ""},
    )
    assert [r["channel_bucket"] for r in rows] == ["Sysmon", "Security", "Other", "Other"]
    assert [r["is_system"] for r in rows] == [1, 0, 0, 0]


def test_bad_lines(spark):
    bad = ["broken{", "[1, 2]", "5", '{"a": 1', '{"a": 1} {"b": 2}', '{"a": 1}, {"b": 2}', '{"a": 1} x']
    parsed = run(spark, *bad, '  {"EventID": 3}\t', "", "   ", {"EventID": 4})
    assert sorted(r["line"] for r in N.quarantine(parsed).collect()) == sorted(bad)
    counts = {r["is_bad"]: r["n_lines"] for r in N.line_counts(parsed).collect()}
    assert counts == {0: 2, 1: len(bad)}
    assert [r["event_id"] for r in N.normalize(parsed).orderBy("event_id").collect()] == [3, 4]


def test_message_length_counts_code_points(spark):
    assert normalized(spark, {"Message": "é😀a"})[0]["message_len"] == 3


def test_one_hot(spark):
    df = spark.createDataFrame([(i,) for i in [1, 1, 2, 2, 3, 9]], "event_id long")
    ids = N.top_event_ids(df, 3)
    assert ids == [1, 2, 3]
    hot = N.one_hot_event_ids(df, ids)
    assert dict(hot.dtypes)["eid_1"] == "tinyint"
    assert [r["eid_2"] for r in hot.orderBy("event_id").collect()] == [0, 0, 1, 1, 0, 0]


def test_parse_stays_in_the_jvm_and_runs_once(spark):
    events = N.normalize(run(spark, {"EventID": 1}), ["event_key"]).filter("event_id = 1 AND image_base = ''")
    plan = plan_of(events)
    assert "Python" not in plan and "Exchange" not in plan
    assert plan.count("from_json") == 1
