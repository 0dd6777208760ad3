import json

from pyspark.sql import functions as F

from logvane.operators.normalize import normalize, parse_lines
from logvane.operators.rules import label
from logvane.sources.ndjson import read_lines
from logvane.streaming import events as E


def line(i, time, **fields):
    return json.dumps({"EventID": 8 if i % 2 else 5, "EventTime": time, "Hostname": f"h{i % 3}", "Message": f"m{i}", **fields})


def land(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_stream_equals_batch(spark, tmp_path):
    for n in range(3):
        land(tmp_path / "in", f"{n}.json", [line(i, f"2020-05-01 1{n}:00:{i:02d}") for i in range(20)] + ["broken{"])
    root = str(tmp_path / "in")
    streamed = E.run_to_table(E.stream_labeled(E.stream_lines(spark, root, files_per_batch=1)), "s")
    batch = label(normalize(parse_lines(read_lines(spark, root))))
    key = ["timestamp", "hostname", "message", "ground_truth"]
    assert sorted(streamed.select(*key).collect()) == sorted(batch.select(*key).collect())
    assert streamed.count() == 60


def test_windows_drop_late_rows(spark, tmp_path):
    folder = tmp_path / "in"
    land(folder, "0.json", [line(1, "2020-05-01 10:05:00"), line(1, "2020-05-01 10:06:00"), line(1, "2020-05-01 13:00:00")])
    root, state, out = str(folder), str(tmp_path / "state"), str(tmp_path / "out")

    def run():
        windows = E.malicious_windows(E.stream_labeled(E.stream_lines(spark, root)), "1 hour", late="10 minutes")
        query = (
            windows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return {str(r["window_start"])[11:16]: r["n_events"] for r in spark.read.parquet(out).collect()}

    assert run() == {"10:00": 2}, "the open window waits"
    land(folder, "1.json", [line(1, "2020-05-01 10:07:00"), line(1, "2020-05-01 15:00:00")])
    assert run() == {"10:00": 2, "13:00": 1}, "the late row is not counted, the restarted stream goes on"


def test_benign_events_close_windows(spark, tmp_path):
    land(tmp_path / "in", "0.json", [line(1, "2020-05-01 10:05:00"), line(2, "2020-05-01 12:00:00")])
    windows = E.malicious_windows(E.stream_labeled(E.stream_lines(spark, str(tmp_path / "in"))), "1 hour", late="10 minutes")
    assert [r["n_events"] for r in E.run_to_table(windows, "closed").collect()] == [1]


def test_repeats_within_the_watermark(spark, tmp_path):
    land(tmp_path / "in", "0.json", [line(1, "2020-05-01 10:05:00"), line(1, "2020-05-01 10:05:30"), line(2, "2020-05-01 10:06:00")])
    stream = E.stream_labeled(E.stream_lines(spark, str(tmp_path / "in")))
    assert E.run_to_table(E.first_sightings(stream, ["event_id", "hostname"]), "first").count() == 2


def test_stream_scoring_equals_batch(spark, tmp_path):
    from logvane.plans import detect

    lines = [line(i, f"2020-05-01 {i % 24:02d}:00:00", GrantedAccess=hex(i * 7 % 97), SeverityValue=i % 4) for i in range(400)]
    land(tmp_path / "in", "0.json", lines)
    root = str(tmp_path / "in")
    batch = label(normalize(parse_lines(read_lines(spark, root)), ["event_key"]))
    scored, model = detect.fit_and_score(batch)
    streamed = E.run_to_table(E.stream_scored(E.stream_labeled(E.stream_lines(spark, root)), model), "scored")
    shown = ["message", "is_anomaly", F.round("if_anomaly_score", 9).alias("s")]
    assert sorted(streamed.select(*shown).collect()) == sorted(scored.select(*shown).collect())
