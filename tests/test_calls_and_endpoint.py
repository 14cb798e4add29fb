"""Outcomes from missing replies, on tables and streams; an endpoint polled across restarts."""

import http.server
import threading
import time

from pyspark.sql import functions as F

from trellium.streaming import calls, endpoint, metrics

CALLS = [("a", 100), ("b", 100), ("c", 101), ("d", 102), ("e", 103), ("z", 600)]
REPLIES = [("a", 104, "fine"), ("b", 190, "too late"), ("c", 105, "Error during execution: no"), ("y", 600, "of no call")]
CRASHES = [(["d", "gone"], 106)]
WANT = {"a": "ok", "b": "timeout", "c": "error", "d": "worker_crash", "e": "timeout"}


def tables(spark):
    made = (
        spark.createDataFrame(CALLS, "call_id string, s long"), spark.createDataFrame(REPLIES, "call_id string, s long, reply string"), spark.createDataFrame(CRASHES, "lost array<string>, s long"),
    )
    return [df.withColumn("at", F.timestamp_seconds("s")).drop("s") for df in made]


def test_outcomes_of_a_table(spark):
    asked, replies, crashes = tables(spark)
    got = calls.outcomes(asked, calls.first_signals(calls.signals(replies, crashes)), "30 seconds")
    assert {r["call_id"]: r["outcome"] for r in got.collect()} == WANT | {"z": "timeout"}
    late = replies.unionByName(spark.createDataFrame([("d", "after its worker was lost")], "call_id string, reply string").withColumn("at", F.timestamp_seconds(F.lit(107))))
    got = calls.outcomes(asked, calls.first_signals(calls.signals(late, crashes)), "30 seconds")
    assert got.where("call_id = 'd'").first()["outcome"] == "worker_crash"


def test_outcomes_of_streams(spark, tmp_path):
    streams = []
    for name, df in zip(("calls", "replies", "crashes"), tables(spark), strict=True):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(df.schema).parquet(str(tmp_path / name)))
    asked, replies, crashes = streams
    got = metrics.replay(calls.outcomes(asked, calls.signals(replies, crashes), "30 seconds", "10 seconds"), "outcomes")
    # the last call's limit is not over when the streams end
    assert {r["call_id"]: r["outcome"] for r in got.collect()} == WANT


class Stub(http.server.BaseHTTPRequestHandler):
    served = 0

    def do_GET(self):
        Stub.served += 1
        self.send_response(200)
        self.end_headers()
        self.wfile.write(f'# HELP m\nm{{a="1"}} {Stub.served}\n'.encode())

    def log_message(self, *_):
        pass


def test_an_endpoint_is_polled_and_restarts_without_loss_or_repeats(spark, tmp_path):
    server = http.server.HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    stream = endpoint.scraped(spark, f"http://127.0.0.1:{server.server_port}/metrics", str(tmp_path / "scrapes"), "p")

    def run_until(rows):
        writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        query = writer.trigger(processingTime="1 second").start()
        until = time.time() + 60
        while time.time() < until and len(list((tmp_path / "out").glob("part-*"))) < rows:
            time.sleep(0.5)
        query.stop()

    run_until(6)
    run_until(6)
    server.shutdown()
    got = sorted((r["run"], r["prefix"], r["name"], r["number"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert len(got) >= 5 and got == [(i, "p", "m", float(i + 1)) for i in range(len(got))]
