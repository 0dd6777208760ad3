import pytest
from plans import plan_of
from pyspark.sql import functions as F

from logvane.functions import text as X


def one(spark, expression, **columns):
    schema = ", ".join(f"{n} string" for n in columns)
    return spark.createDataFrame([tuple(columns.values())], schema).select(expression).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        (
            "Process C:\\Windows\\System32\\svchost.exe {8A5F3B2C-1111} 0x1F 2020-05-01 22:55:25 42 opened",
            "process svchost exe hexval opened",
        ),
        ("42 0 {11111111}", "unknown_event"),
        ("", "unknown_event"),
        ("The UtcTime and Image were null", "unknown_event"),
        ("a1b2c3 don't stop", "stop"),
        ("caf\u00e9\u2003men\u00fc D:\\x\\Y.DLL,ok yes", "caf men dll yes"),
    ],
)
def test_cleaning(spark, text, expected):
    assert one(spark, X.clean_text(F.col("t")), t=text) == expected


def test_lists():
    assert len(X.DOMAIN_NOISE) == len(set(X.DOMAIN_NOISE)) == 26


def test_terms(spark):
    assert one(spark, X.terms(F.split("t", " ")), t="a b c") == ["a", "b", "c", "a b", "b c"]
    assert one(spark, X.terms(F.split("t", " ")), t="a") == ["a"]


def test_grounding(spark):
    analysis = "Adversaries access memory credentials. Totally unrelated wording here."
    assert one(spark, X.grounding(F.col("a"), F.col("d")), a=analysis, d="Credentials") == 0.5
    assert one(spark, X.grounding(F.col("a"), F.col("d")), a="", d="credentials") == 0.0
    assert one(spark, X.grounding(F.col("a"), F.col("d")), a="Short. Too short.", d="short") == 0.0
    assert one(spark, X.grounding(F.col("a"), F.col("d")), a=analysis, d=None) == 0.0


@pytest.mark.parametrize("access, shown", [(2097151, "0x1fffff"), (0, "N/A"), (None, "N/A")])
def test_context(spark, access, shown):
    row = (10, "h", "i.exe", "t.exe", "o" * 100, "alice", "CORP", access, -0.51234, "m" * 500)
    schema = (
        "event_id long, hostname string, image string, target_image string, target_object string, account_name string, "
        "domain string, granted_access long, anomaly_score double, message string"
    )
    assert spark.createDataFrame([row], schema).select(X.anomaly_context()).first()[0] == (
        f"EventID: 10 | Hostname: h | Process: i.exe | TargetImage: t.exe | TargetObject: {'o' * 100} | "
        f"Account: alice (CORP) | GrantedAccess: {shown} | IsolationForest score: -0.5123 | Message: {'m' * 500}"
    )


def test_filled(spark):
    df = spark.createDataFrame([("a", "b"), ("a", ""), ("a", None)], "x string, y string")
    assert [r[0] for r in df.select(X.all_filled(["x", "y"])).collect()] == [1, 0, 0]


def test_text_functions_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    assert "Python" not in plan_of(df.select(X.clean_text(F.col("x")), X.grounding(F.col("x"), F.col("y"))))
