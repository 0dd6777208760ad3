import pytest
from plans import plan_of

from logvane.operators import rules as R

FIELDS = ["event_id", "image", "image_base", "target_image", "target_object", "target_filename"]
SCHEMA = "event_id long, image string, image_base string, target_image string, target_object string, target_filename string"


def event(event_id, image="", target_image="", target_object="", target_filename=""):
    return (event_id, image, image.split("\\")[-1].lower(), target_image, target_object, target_filename)


@pytest.mark.parametrize(
    "row, reference, strict",
    [
        (event(8), 1, 1),
        (event(3, "C:\\Tools\\dotnet.exe"), 1, 0),
        (event(3, "C:\\Tools\\net.exe"), 1, 1),
        (event(1, "C:\\Windows\\System32\\svchost.exe"), 1, 0),
        (event(1, "C:\\Temp\\svchost.exe"), 1, 1),
        (event(11, target_filename="C:\\a\\x.PS1.bak"), 1, 1),
        (event(5, "C:\\MIMIKATZ.EXE"), 1, 1),
        (event(5, "C:\\mimikatz.exe.bak"), 0, 0),
        (event(13, target_object="HKLM\\Software\\CURRENTVERSION\\RUN\\x"), 1, 1),
        (event(13, target_object="HKLM\\z"), 0, 0),
        (event(10, target_image=None), 0, 0),
        ((None, None, None, None, None, None), 0, 0),
    ],
)
def test_labels(spark, row, reference, strict):
    df = spark.createDataFrame([row], SCHEMA)
    assert R.label(df).first()["ground_truth"] == reference
    assert R.label(df, strict=True).first()["ground_truth"] == strict


def test_both_registry_rules_are_reported(spark):
    df = spark.createDataFrame([event(13, target_object="X\\CurrentVersion\\RunOnce\\a")], SCHEMA)
    matched = R.match_rules(df, R.rules_frame(spark)).first()
    assert matched["rule_ids"] == [2, 3]
    assert R.attribute(df).first()["techniques"] == ["T1547.001"]


def test_rule_table_and_expression_agree(spark):
    rows = [
        event(e, image, "C:\\lsass.exe", "A\\Services\\B", "C:\\Tasks\\a.vbs")
        for e in (1, 3, 8, 10, 11, 13) for image in ("C:\\cmd.exe", "C:\\empire", "C:\\net1.exe", "")
    ]
    df = spark.createDataFrame(rows, SCHEMA).distinct()
    joined = R.label(R.match_rules(df, R.rules_frame(spark)))
    assert joined.filter("ground_truth <> cast(size(rule_ids) > 0 as int)").count() == 0
    assert joined.count() == len(set(rows))


def test_labelling_is_one_projection(spark):
    plan = plan_of(R.attribute(R.label(spark.createDataFrame([event(1)], SCHEMA))))
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_rule_join_never_multiplies_rows(spark):
    plan = plan_of(R.match_rules(spark.createDataFrame([event(1)], SCHEMA), R.rules_frame(spark)))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
