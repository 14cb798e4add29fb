import json
import time

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trellium.sources import files
from trellium.streaming import episodes, metrics

SCHEMA = StructType().add("a", "integer").add("b", "string")


def test_json_forms(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2}]))
    (tmp_path / "y.jsonl").write_text('{"a": 1}\n\nnot json\n')
    assert files.json_any(spark, str(tmp_path / "x.json"), SCHEMA).count() == 2
    lines = files.json_lines(spark, str(tmp_path / "y.jsonl"), SCHEMA, strict=False).cache()
    assert sorted(r["_corrupt"] or "" for r in lines.collect()) == ["", "not json"]


def test_catalog(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"e1": {"n": 1}, "e2": {"n": 2}}')
    assert sorted(map(tuple, files.catalog(spark, str(tmp_path / "c.json"), "struct<n:int>").collect())) == [("e1", 1), ("e2", 2)]


def test_metric_text(spark):
    lines = ["# HELP x", "", 'x{a="1",b="q"} 2', "x 3.5", "y_bucket{le=\"+Inf\"} 7", "z nope"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert {r["name"]: r["total"] for r in files.metric_sums(files.metric_samples(df)).collect()} == {"x": 5.5, "y_bucket": 7.0}


def test_reports():
    doc = files.summary_document([{"a": 1}], "n")
    assert doc["summary_hash"] == files.canonical_hash({"name": "n", "rows": [{"a": 1}]})
    assert files.markdown_table([{"a": 0.5, "b": None}], ["a", "b"]).splitlines()[-1] == "| 0.5000 | — |"


def test_stream_equals_batch_for_counters(spark, tmp_path):
    rows = [("s", i, float(v)) for i, v in enumerate([1, 4, 2, 2, 9])] + [("t", 0, 5.0), ("t", 3, 6.0)]
    df = spark.createDataFrame(rows, "series string, sec long, value double").withColumn("ts", F.timestamp_seconds("sec"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = metrics.replay(metrics.stream_increases(stream, "series", "ts", "value"), "increases")
    want = metrics.counter_increases(df, ["series"], "ts", "value").select("series", "ts", "increase")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_episode_stream(spark, tmp_path):
    rows = [("a", 0.0, "open"), ("a", 1.0, "step"), ("a", 2.0, "done"), ("b", 0.0, "open"), ("b", 99.0, "step"), ("c", 0.0, "open"), ("c", 1.0, "crash"), ("c", 2.0, "done"), ("d", 0.0, "done")]
    df = spark.createDataFrame(rows, "episode_id string, at double, event string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = metrics.replay(episodes.episodes(stream, 10.0), "episodes").orderBy("episode_id").collect()
    assert [(r["episode_id"], r["steps"], r["attempts"], r["terminal_reason"]) for r in got] == [
        ("a", 1, 1, "final_answer"), ("b", 0, 1, "timeout"), ("c", 0, 2, "final_answer"),
    ]


def test_session_windows_on_a_stream(spark, tmp_path):
    rows = [(1, s) for s in (0, 10, 5000, 5010)]
    df = spark.createDataFrame(rows, "user_id long, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert metrics.replay(metrics.sessions(stream, "user_id", "ts", "1 minute", "10 seconds"), "sess", "complete").count() == 2


def test_a_silent_episode_times_out(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.0, "open"), ("a", 1.0, "step")], "episode_id string, at double, event string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = episodes.episodes(stream, 2.0).writeStream.format("memory").queryName("silent").trigger(processingTime="1 second").start()
    until = time.time() + 40
    while time.time() < until and spark.table("silent").isEmpty():
        time.sleep(1)
    query.stop()
    assert list(map(tuple, spark.table("silent").collect())) == [("a", 0.0, 2.0, 1, 1, "timeout")]


def test_quantiles_on_a_stream(spark, tmp_path):
    rows = [("a", 1.0, 2.0), ("a", 5.0, 8.0), ("a", float("inf"), 10.0), ("b", 1.0, 0.0), ("b", 5.0, 4.0), ("b", float("inf"), 4.0)]
    df = spark.createDataFrame(rows, "m string, le double, n double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = metrics.replay(metrics.histogram_quantile(stream, ["m"], "le", "n", 0.5), "quantiles", "complete")
    assert {r["m"]: r["quantile"] for r in got.collect()} == {"a": 3.0, "b": 3.0}
    assert metrics.histogram_quantile(df, ["m"], "le", "n", 0.95).where("m = 'a'").first()["quantile"] == 5.0
