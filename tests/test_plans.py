"""What the optimizer makes of the stage queries."""

import re

import pytest
from plans import plan_of
from pyspark.sql import functions as F

from logvane.operators import features, rules, summaries
from logvane.session import materialize
from logvane.sources import tables
from workload.packing import dealt_lines
from workload.raw_events import normalized, to_lines

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return materialize(rules.label(normalized(spark, SF_DIR)), "plan-events")


def read_columns(df) -> set[str]:
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return {c for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan) for c in re.findall(r"(\w+):", schema)}


def test_only_the_needed_columns_are_read(events):
    assert read_columns(summaries.class_balance(events)) == {"ground_truth"}
    assert read_columns(summaries.event_histogram(events, ["event_id", "is_system"])) == {"event_id", "is_system"}
    scaler = features.fit_scaler(events, ["message_len", "granted_access"])
    assert read_columns(features.with_features(events, scaler).select("features")) == {"message_len", "granted_access"}


def test_filters_reach_the_scan(events, spark):
    plan = plan_of(summaries.label_breakdown(events))
    assert "PushedFilters" in plan and "EqualTo(ground_truth,1)" in plan


def test_partitions_are_pruned(spark, events, tmp_path):
    path = str(tmp_path / "by_id")
    tables.write_stage(events.select("event_id", "hostname"), path, ["event_id"])
    plan = plan_of(tables.read_stage(spark, path).filter(F.col("event_id") == 10))
    assert re.search(r"PartitionFilters: \[[^\]]*event_id", plan)


def test_aggregates_combine_before_the_shuffle(events):
    plan = plan_of(summaries.event_histogram(events, ["event_id"]))
    assert "partial_count" in plan


def test_a_line_looks_its_number_up_once(spark):
    # F21 and all queries on lines: the lookup was copied into every field that asks for it
    events = spark.createDataFrame([(1, 5, "click", 1.0, '{"k": 7}')], "event_id long, user_id long, event_type string, value double, props string")
    lines = to_lines(events.withColumn("ts", F.timestamp_seconds(F.lit(0))))
    assert plan_of(lines).count("get_json_object") == 1
    assert '"EventID":"3"' in lines.first()["line"].replace(" ", "") or '"EventID":3' in lines.first()["line"]


def test_packing_sorts_nothing(spark):
    # a task sorted a quarter of all lines
    plan = plan_of(dealt_lines(spark, SF_DIR))
    assert "Sort" not in plan and "Exchange" in plan
