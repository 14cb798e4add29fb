"""The episode state machine: as a table, in micro-batches, with timers, and against the join that says the same of crashes."""

import pytest
from pyspark.sql import functions as F

from trellium.operators import turns
from trellium.streaming import metrics, slots

EVENTS = "worker string, at double, seq int, event string, position long, attempt int"
STORY = [
    ("w", 0.0, 0, "open", 1, None), ("w", 0.5, 0, "open", 2, 0), ("w", 1.0, 0, "generate", 1, 0), ("w", 2.0, 0, "call", 1, 0), ("w", 2.5, 0, "generate", 1, 0), ("w", 3.0, 0, "crash", None, None),
    ("w", 3.5, 0, "result", 1, 0), ("w", 3.6, 0, "final_answer", 2, 0), ("w", 4.0, 0, "generate", 1, 1), ("w", 5.0, 0, "invalid", 1, 1), ("w", 6.0, 0, "generate", 1, 1), ("w", 7.0, 0, "call", 1, 1),
    ("w", 7.5, 0, "result", 1, 1), ("w", 8.0, 0, "step_cap", 1, 1), ("w", 9.0, 0, "final_answer", 2, 1), ("w", 9.5, 0, "generate", 2, 1), ("x", 0.0, 0, "open", 3, 0), ("x", 90.0, 0, "generate", 3, 0),
    ("y", 1.0, 0, "generate", 4, 0), ("y", 2.0, 0, "crash", None, None),
]


def ended(df):
    return sorted((r["worker"], r["episode_id"], r["replaced_episode_id"], r["opened"], r["ended"], r["step_count"], r["generation_count"], r["invalid_call_count"], r["terminal_reason"]) for r in df.collect())


WANT = [
    ("w", "1", None, 0.0, 3.0, 1, 1, 0, "worker_crash"), ("w", "1~1", "1", 3.0, 8.0, 1, 2, 1, "step_cap"), ("w", "2", None, 0.5, 3.0, 0, 0, 0, "worker_crash"),
    ("w", "2~1", "2", 3.0, 9.0, 0, 0, 0, "final_answer"), ("x", "3", None, 0.0, 20.0, 0, 0, 0, "timeout"),
]


def test_a_table_of_events(spark):
    got = slots.episode_slots(spark.createDataFrame(STORY, EVENTS), 20.0)
    assert ended(got) == WANT
    timings = {r["episode_id"]: r["stage_timings"] for r in got.collect()}
    assert timings["1"] == {"ready": [1.0], "generating": [1.0]} and timings["1~1"] == {"ready": [1.0, 1.0], "generating": [1.0, 1.0], "tool": [0.5]} and timings["3"] == {}


def in_micro_batches(spark, folder, rows, schema, cuts):
    """A stream of the rows, a file and a micro-batch for each part between the cuts."""
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_micro_batches_give_what_the_table_gives(spark, tmp_path):
    rows = sorted(STORY, key=lambda r: r[1])
    stream = in_micro_batches(spark, str(tmp_path / "in"), rows, EVENTS, (4, 9, 13))
    got = metrics.replay(slots.episode_slots(stream, 20.0, clock="EventTime"), "slots_of_story")
    assert ended(got) == WANT


def test_a_silent_episode_ends_by_its_timer(spark, tmp_path):
    rows = [("w", 0.0, 0, "open", 1, 0), ("w", 2.0, 0, "open", 2, 0), ("v", 60.0, 0, "open", 9, 0), ("v", 61.0, 0, "final_answer", 9, 0), ("v", 99.0, 0, "open", 8, 0)]
    stream = in_micro_batches(spark, str(tmp_path / "in"), rows, EVENTS, (1, 2, 3, 4))
    got = metrics.replay(slots.episode_slots(stream, 20.0, clock="EventTime"), "slots_of_silence")
    assert ended(got) == [("v", "9", None, 60.0, 61.0, 0, 0, 0, "final_answer"), ("w", "1", None, 0.0, 20.0, 0, 0, 0, "timeout"), ("w", "2", None, 2.0, 22.0, 0, 0, 0, "timeout")]


def test_crashes_retire_what_the_join_says(spark, tmp_path):
    """Every attempt and its fate equal ``turns.replaced``, which joins intervals with crashes."""
    attempts, crashes = [], []
    for worker in range(4):
        at = sorted({(worker * 7 + 6 * i) % 50 for i in range(worker)})
        crashes += [(f"w{worker}", float(t)) for t in at]
        for i in range(6):
            opened, n, position = float((worker + 9 * i) % 40), 0, 10 * worker + i
            while True:
                over = opened + 8
                attempts.append((f"w{worker}", position, n, opened, over, "final_answer"))
                hit = [t for t in at if opened <= t < over and (n == 0 or t > opened)]
                if not hit:
                    break
                opened, n = float(hit[0]), n + 1
    a = spark.createDataFrame(attempts, "worker string, position long, attempt int, opened double, ended double, reason string")
    c = spark.createDataFrame(crashes, "worker string, at double")
    # an attempt that a crash opens is not retired by that same crash
    shifted = a.withColumn("opened", F.when(F.col("attempt") > 0, F.col("opened") + 1e-6).otherwise(F.col("opened")))
    want = sorted((r["worker"], r["episode_id"], r["replaced_episode_id"], r["crashed_at"] is not None) for r in turns.replaced(c, shifted).collect())
    events = slots.feed(a, c)
    rows = sorted(map(tuple, events.collect()), key=lambda r: (r[1], r[2]))
    stream = in_micro_batches(spark, str(tmp_path / "in"), rows, EVENTS, (20, 41))
    for got in (slots.episode_slots(events, 1e9), metrics.replay(slots.episode_slots(stream, 1e9, clock="EventTime"), "slots_of_crashes")):
        assert sorted((r["worker"], r["episode_id"], r["replaced_episode_id"], r["terminal_reason"] == "worker_crash") for r in got.collect()) == want
    assert any(w[1].endswith("~2") for w in want)


def test_a_failure_that_repeats_is_an_error(spark):
    rows = [("w", 0.0, 0, "open", 1, 0)] + [("w", float(i), 0, "crash", None, None) for i in (1, 2, 3)]
    events = spark.createDataFrame(rows, EVENTS)
    assert [r["attempt"] for r in slots.episode_slots(events, 99.0, most=3).orderBy("attempt").collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="position 1 has more than 2 replacements"):
        slots.episode_slots(events, 99.0, most=2).collect()


def test_a_table_is_replayed_without_a_state_store(spark):
    """Odd rows too: no worker, no time, and workers whose events lie in several batches."""
    rows = [*STORY, (None, 1.0, 0, "open", 7, 0), (None, 2.0, 0, "final_answer", 7, 0), ("z", 1.0, 0, "open", 8, 0), ("z", None, 0, "final_answer", 8, 0)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = slots.episode_slots(spark.createDataFrame(rows, EVENTS), 20.0)
        assert "TransformWithState" not in out._jdf.queryExecution().toString()
        got = {(r["worker"], r["episode_id"]): r["terminal_reason"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(w[0], w[1]): w[8] for w in WANT} | {(None, "7"): "final_answer", ("z", "8"): "final_answer"}
