"""Sources, sinks and streams over small files."""

import hashlib
import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.sources import readers, sinks
from quillon.streaming import runs


def test_csv_and_jsonl(spark, tmp_path):
    (tmp_path / "q.csv").write_text("﻿id,name\nQ1,\"a,b\"\nQ2,\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "q.csv"), ["id", "name"]).collect()] == [("Q1", "a,b"), ("Q2", None)]
    df = spark.createDataFrame([("b", 2), ("a", 1)], "key string, n int")
    sinks.write_jsonl(df, f"{tmp_path}/out", "key")
    assert [tuple(r) for r in readers.read_jsonl(spark, f"{tmp_path}/out", "key string, n int").collect()] == [("a", 1), ("b", 2)]
    sinks.write_csv(df, f"{tmp_path}/csv", ["n", "key"])
    assert {tuple(r) for r in readers.read_csv(spark, f"{tmp_path}/csv", ["n", "key"]).collect()} == {("2", "b"), ("1", "a")}


def test_records(spark, tmp_path):
    (tmp_path / "phase" / "m").mkdir(parents=True)
    (tmp_path / "phase" / "m" / "a.json").write_text('{"key": "k1", "meta": {"content": "x"}}')
    (tmp_path / "phase" / "m" / "b.json").write_text('{"key": ')
    good, bad = readers.read_records(spark, str(tmp_path), "key string, meta struct<content:string>")
    assert [r.key for r in good.collect()] == ["k1"] and bad.count() == 1


def test_export_checks(spark, tmp_path):
    label = {"pid": "p1", "brands": ["A"], "recommended": [], "prices": [], "retailers": [], "refused": "true", "answer_language": "en", "comments": ""}
    for name, body in (("ok", {"labels": [label]}), ("twice", {"labels": [label, label]}), ("part", {"labels": [label], "partial": True})):
        (tmp_path / f"{name}.json").write_text(json.dumps({"task": "t", "rater": "R1", "exported_at": "x"} | body))
    assert readers.read_export(spark, f"{tmp_path}/ok.json", "t", "R1").first().refused is True
    for name, rater in (("ok", "R2"), ("twice", "R1"), ("part", "R1")):
        with pytest.raises(PySparkException):
            readers.read_export(spark, f"{tmp_path}/{name}.json", "t", rater).collect()


def test_rules_keys_gate_fragments(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("# c\n\nsorry\n i cannot \n")
    assert readers.read_rules(spark, f"{tmp_path}/rules.txt") == ["sorry", "i cannot"]
    keys, known = spark.createDataFrame([("a",), ("a",), ("z",)], "key string"), spark.createDataFrame([("a",), ("b",)], "key string")
    assert {tuple(r) for r in readers.check_keys(keys, known).collect()} == {("a", "repeated"), ("z", "unknown")}
    want = hashlib.sha256((tmp_path / "rules.txt").read_bytes()).hexdigest()
    manifest = spark.createDataFrame([("rules.txt", want), ("gone.txt", "x")], "name string, sha256 string")
    assert [r.name for r in readers.gate(spark, f"{tmp_path}/*.txt", manifest).collect()] == ["gone.txt"]
    records = spark.createDataFrame([("abcdef1",), ("abcdef2",), ("xyz0001",)], "key string")
    got = readers.match_fragments(spark.createDataFrame([("abcdef",), ("xyz000",), ("none",)], "fragment string"), records, length=6)
    assert sorted((r.fragment, r.candidates) for r in got.collect()) == [("abcdef", 2), ("abcdef", 2), ("none", None), ("xyz000", 1)]


def test_xlsx(spark, tmp_path):
    ns = readers.NS["m"]
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>id</t></si><si><t>text</t></si><si><t>hello</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7</v></c><c r="B2" t="s"><v>2</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in readers.read_xlsx(spark, f"{tmp_path}/t.xlsx", ["id", "text"]).collect()] == [("7", "hello")]


def test_resume_tree_report_redaction(spark, tmp_path):
    plan = spark.range(5).withColumnRenamed("id", "dataset")
    sinks.append_log(plan.where("dataset < 2"), f"{tmp_path}/log")
    sinks.append_log(plan.where("dataset = 3"), f"{tmp_path}/log")
    assert {r.dataset for r in sinks.open_work(plan, spark.read.parquet(f"{tmp_path}/log"), ["dataset"]).collect()} == {2, 4}
    res = spark.createDataFrame([("p", "m", 0.5), ("p", "n", None)], "block string, name string, value double")
    assert json.loads(sinks.result_tree(res, ("block", "name"), "value")) == {"p": {"m": 0.5, "n": None}}
    assert sinks.markdown(res, ["name", "value"]).splitlines()[2:] == ["| m | 0.500 |", "| n | – |"]
    calls = spark.createDataFrame([(1, "http://x", "b")], "k int, u string, b string").select("k", F.struct(F.col("u").alias("url"), F.col("b").alias("body")).alias("request"))
    assert tuple(sinks.redacted(calls, "request", ("url",)).first().request) == ("REDACTED", "b")
    tries = spark.createDataFrame([("a", i, "v1" if i != 2 else "v0") for i in range(1, 6)], "key string, attempt int, params string")
    live, moved = sinks.split_superseded(tries, F.col("params") == "v1")
    assert {r.attempt for r in live.collect()} == {1, 3} and {r.attempt for r in moved.collect()} == {2, 4, 5}


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:20:00", "a", 2.0), (3, "2024-01-01 05:00:00", "b", 4.0)]
    df = spark.createDataFrame(rows, "id int, t string, g string, value double").select("id", F.to_timestamp("t").alias("ts"), "g", "value")
    df.write.parquet(f"{tmp_path}/in")
    stream = lambda: runs.read_calls(spark, f"{tmp_path}/in", "id int, ts timestamp, g string, value double")
    for _ in range(2):  # a rerun adds nothing
        runs.drain(runs.once(stream(), "id"), f"{tmp_path}/once", f"{tmp_path}/c1")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/once").collect()) == [1, 2, 3]
    runs.drain(runs.windowed(stream(), "g"), f"{tmp_path}/win", f"{tmp_path}/c2")
    got = {(r.g, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/win").collect()}
    assert ("a", 3, 4.0) in got
    q = runs.run_windows(stream(), "g").writeStream.outputMode("complete").format("memory").queryName("runs").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.g, r.calls) for r in spark.table("runs").collect()} == {("a", 3), ("b", 1)}


def test_stream_query_keeps_events_of_unordered_files(spark, tmp_path):
    from quillon.plans import catalogue, models  # noqa: F401

    rows = spark.range(2000).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 7919 % 2000 * 1000).alias("ts"),
                                    F.lit("a").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.repartition(20, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task, and so a file, for each file
    try:
        got = catalogue.QUERIES["x_stream_windows"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(r.n for r in got) == 2000


def test_synthetic_study_is_independent_of_partitions(spark):
    a = sorted(map(str, readers.synthetic_study(spark, queries=6).collect()))
    b = sorted(map(str, readers.synthetic_study(spark.newSession(), queries=6).repartition(3).collect()))
    assert a == b and len(a) == 6 * 3 * 3 * 5
