import json
import zipfile

import pytest
from pyspark.sql import functions as F

from logvane.operators import normalize as N
from logvane.sources import archives, collections, knowledge, ndjson, tables


def test_files_at_any_depth(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "top.json").write_bytes(b'{"EventID": 1}\n\n{"EventID": 2, "Message": "\xff"}\r\n')
    (deep / "low.json").write_text('{"EventID": 3}\nbroken{\n')
    (deep / "skip.txt").write_text('{"EventID": 4}\n')
    lines = ndjson.read_lines(spark, str(tmp_path))
    events = N.normalize(N.parse_lines(lines), ["event_key", "path"]).orderBy("event_id").collect()
    assert [e["event_id"] for e in events] == [1, 2, 3]
    assert events[1]["message"] == "�", "bytes that are no text are replaced"
    assert len({e["event_key"] for e in events}) == 3


def test_archive_members(spark, tmp_path):
    for name in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("logs/x.json", '{"EventID": 1}\n{"EventID": 2}\n')
            z.writestr("readme.md", "no")
    found = archives.read_archives(spark, str(tmp_path)).collect()
    assert len(found) == 4 and {r["member"] for r in found} == {"logs/x.json"}
    assert sorted((r["number"], r["line"], r["error"]) for r in found)[::2] == [(0, '{"EventID": 1}', None), (1, '{"EventID": 2}', None)]


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    lines = {f"logs/{i}.json": [f"{i}-{j}" for j in range(50)] for i in range(40)}
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, held in lines.items():
            z.writestr(name, "\n".join(held))
    rows = archives.read_archives(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert {(r["member"], r["number"], r["line"]) for r in rows} == {(n, i, x) for n, held in lines.items() for i, x in enumerate(held)}
    assert len(rows) == 2000 and len({r["task"] for r in rows}) > 1


def test_faults_of_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "LINES_PER_BATCH", 3)
    (tmp_path / "a b" / "deep").mkdir(parents=True)
    good = tmp_path / "a b" / "deep" / "good.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("é.json", b"one\r\n\n\xff\nlast")
        z.writestr("empty.json", b"")
        z.mkdir("folder.json")
    whole = good.read_bytes()
    (tmp_path / "cut.zip").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "none.zip").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "void.zip", "w"):
        pass
    # a byte of the content changed: found by the checksum when the member has been read
    (tmp_path / "damaged.zip").write_bytes(whole.replace(b"last", b"lost", 1))
    rows = archives.read_archives(spark, str(tmp_path)).collect()
    shown = {(r["path"].rsplit("/", 1)[-1], r["member"], r["number"], r["line"]) for r in rows if r["error"] is None}
    assert {x[2:] for x in shown if x[0] == "good.zip"} == {(0, "one\r"), (1, ""), (2, "\ufffd"), (3, "last")}
    faults = {r["path"].rsplit("/", 1)[-1]: (r["member"], r["error"]) for r in rows if r["error"] is not None}
    # a file of zero bytes is not listed
    assert set(faults) == {"cut.zip", "damaged.zip"} and faults["cut.zip"][0] is None
    assert faults["damaged.zip"][0] == "é.json" and "CRC" in faults["damaged.zip"][1]
    listed = archives.list_members(spark, str(tmp_path)).filter("path like '%good.zip'").collect()
    assert sorted((r["member"], r["bytes"]) for r in listed) == [("empty.json", 0), ("é.json", 12)]


def test_no_archives(spark, tmp_path):
    (tmp_path / "x.txt").write_text("no archive")
    assert archives.read_archives(spark, str(tmp_path)).count() == 0


def test_records(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=2))
    assert sorted(r["a"] for r in tables.read_record_arrays(spark, str(tmp_path / "r.json")).collect()) == [1, 2]


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_stage(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, ["k"])
    tables.write_stage(spark.createDataFrame([("b", 3)], "k string, v int"), path, ["k"])
    assert sorted((r["k"], r["v"]) for r in tables.read_stage(spark, path).collect()) == [("a", 1), ("b", 3)]


@pytest.fixture
def landed(tmp_path):
    root = tmp_path / "kb"
    (root / "car" / "analytics").mkdir(parents=True)
    (root / "sigma" / "rules" / "w" / "x").mkdir(parents=True)
    reference = lambda s, i: {"source_name": s, "external_id": i}
    (root / "attack.json").write_text(json.dumps({"objects": [
        {"type": "attack-pattern", "id": "attack-pattern--abcdef123456", "name": "Dump", "description": "d" * 3000,
         "external_references": [reference("mitre-attack", "T1"), reference("capec", "C"), reference("mitre-attack", "T1.001")],
         "kill_chain_phases": [{"phase_name": "one"}, {"phase_name": "two"}]},
        {"type": "malware", "id": "x"},
        {"type": "attack-pattern", "id": "attack-pattern--000000000009"},
    ]}, indent=1))
    (root / "d3fend.json").write_text(json.dumps({"data": [
        {"id": "D3-A B", "label": "L", "definition": "def"}, {"d3f_id": "D3/2", "name": "N", "description": "x" * 3000}, {}, {}]}))
    (root / "kev.json").write_text(json.dumps({"vulnerabilities": [{"cveID": "CVE-1", "vendorProject": "v", "notes": "n"}, {}]}))
    (root / "car" / "analytics" / "CAR-1.yaml").write_text(
        "title: One\ndescription: null\nimplementations:\n- code: find me\n- just text\n- code: 5\n")
    (root / "car" / "analytics" / "bad.yml").write_text("title: [unclosed")
    (root / "sigma" / "rules" / "w" / "r.yml").write_text("title: W\ntags: [a.b, c]\ndetection: {sel: {EventID: 4}}\n")
    (root / "sigma" / "rules" / "w" / "x" / "r.yml").write_text("description: second\n")
    (root / "sigma" / "rules" / "w" / "x" / "list.yml").write_text("- a\n- b\n")
    return root


def docs(spark, collection, path):
    return {r["doc_id"]: r for r in knowledge.load_collection(spark, collection, str(path)).collect()}


def test_bundles(spark, landed):
    attack = docs(spark, "mitre_attack", landed / "attack.json")
    row = attack["attack_T1.001_123456"]
    whole = "ATT&CK T1.001 — Dump\nTactic: two\n" + "d" * 3000
    assert row["text"] == whole[:2000] and attack["attack_T1.001_123456#2"]["text"] == whole[2000:]
    assert row["meta"] == {"source": "mitre_attack", "tech_id": "T1.001", "tactic": "two", "name": "Dump"}
    assert attack["attack__000009"]["text"] == "ATT&CK  — \nTactic: \n" and len(attack) == 3

    d3fend = docs(spark, "mitre_d3fend", landed / "d3fend.json")
    assert set(d3fend) == {"d3fend_D3_A_B", "d3fend_D3_2", "d3fend_D3_2#2", "d3fend_unknown", "d3fend_unknown_2"}
    assert len(d3fend["d3fend_D3_2"]["text"]) == 2000 and d3fend["d3fend_D3_2#2"]["meta"] == d3fend["d3fend_D3_2"]["meta"]

    kev = docs(spark, "cisa_kev", landed / "kev.json")
    assert kev["kev_CVE-1"]["text"] == (
        "CVE: CVE-1 | Vendor: v | Product:  | Vulnerability:  | Required Action:  | Due Date:  | Notes: n"
    )
    assert "kev_unknown" in kev


def test_updates_by_year(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"value": [
        {"ID": "2023-Jan", "DocumentTitle": "t"}, {"ID": "2022-Dec"}, {"ID": "abcd"}, {"ID": ""}, {}]}))
    found = docs(spark, "msrc_cvrf", tmp_path / "m.json")
    assert list(found) == ["msrc_2023-Jan"]
    assert found["msrc_2023-Jan"]["text"] == "MSRC Update: 2023-Jan | Title: t | Release Date:  | CVRF URL: "


def test_rule_trees(spark, landed):
    car = docs(spark, "mitre_car", landed / "car" / "analytics")
    assert list(car) == ["car_CAR-1"]
    assert car["car_CAR-1"]["text"] == "CAR — One\nNone\nDetection logic: find me 5"
    sigma = docs(spark, "sigma_rules", landed / "sigma" / "rules")
    assert set(sigma) == {"sigma_r.yml", "sigma_r.yml_2"}
    texts = {r["text"] for r in sigma.values()}
    assert "Sigma Rule: W\nTags: a.b, c\nDescription: \nDetection: {'sel': {'EventID': 4}}" in texts
    assert "Sigma Rule: r.yml\nTags: \nDescription: second\nDetection: " in texts
    rules = knowledge.parse_rules(knowledge.read_rule_files(spark, str(landed / "sigma")), may_be_empty=True)
    assert [r["path"].rsplit("/", 1)[-1] for r in knowledge.unreadable(rules).collect()] == ["list.yml"]


def test_knowledge_base(spark, landed, tmp_path):
    path = str(tmp_path / "store")
    with pytest.warns(UserWarning, match="msrc_cvrf"):
        kb = collections.build_knowledge_base(spark, str(landed), path)
    counts = {r["collection"]: r["n_docs"] for r in collections.collection_counts(kb).collect()}
    assert counts == {"mitre_attack": 3, "mitre_d3fend": 5, "mitre_car": 1, "cisa_kev": 2, "sigma_rules": 2}
    one = kb.filter("collection = 'cisa_kev'").select("collection", "doc_id", "text", "meta").limit(1)
    rows = spark.createDataFrame(one.collect(), one.schema)
    collections.replace_collections(rows, path)
    again = {r["collection"]: r["n_docs"] for r in collections.collection_counts(collections.read_collections(spark, path)).collect()}
    assert again == counts | {"cisa_kev": 1}
    with pytest.raises(ValueError, match="occurs 2 times"):
        collections.replace_collections(rows.union(rows), path)


def test_numbering_of_repeated_ids(spark):
    df = spark.range(500).select(F.lit("same").alias("doc_id"), F.col("id").cast("string").alias("path"))
    ids = {r["doc_id"] for r in knowledge.number_duplicates(df, "doc_id", "path").collect()}
    assert ids == {"same"} | {f"same_{i}" for i in range(2, 501)}


def test_passages_are_made_once_and_stored_small(spark, tmp_path, monkeypatch):
    # ids were checked on one run of the feed's work, and the passages written from another
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        made.add(1)
        return text

    docs = spark.range(50).select(F.lit("c").alias("collection"), F.col("id").cast("string").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = docs.withColumns({"text": seen("text"), "meta": F.create_map(F.lit("a"), F.lit("b"))})
    collections.replace_collections(docs, str(tmp_path / "kb"))
    assert made.value == 50
    assert collections.read_collections(spark, str(tmp_path / "kb")).count() == 50
    assert all("zstd" in f for f in spark.read.parquet(str(tmp_path / "kb")).inputFiles())
    with pytest.raises(ValueError, match="occurs 2 times"):
        collections.replace_collections(docs.unionByName(docs), str(tmp_path / "kb"))
