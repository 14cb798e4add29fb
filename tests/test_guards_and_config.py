import json

import pytest
from pyspark.sql import functions as F

from trellium.operators import batching, evaluation, guards, ordered, turns
from trellium.sources import config


def fails(df, message):
    with pytest.raises(Exception, match=message):
        (df() if callable(df) else df).collect()


def test_lookup_names_the_missing_key(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    dimension = spark.createDataFrame([(1, "x")], "k int, d string")
    assert [r.k for r in guards.missing_keys(facts, dimension, "k").collect()] == [2]
    assert guards.looked_up(facts.where("k = 1"), dimension, ["k"]).collect()[0].d == "x"
    fails(guards.looked_up(facts.where("k = 2"), dimension, ["k"]), "no entry for 2")
    fails(guards.looked_up(facts.where("k is null"), dimension, ["k"]), "no entry for null")


def test_text_binding_rejects_two_scenarios_of_one_text(spark):
    prompts = spark.createDataFrame([(i, "t") for i in range(5)], "i int, text string")
    one = spark.createDataFrame([("a", "t")], "task_id string, text string")
    bound = guards.bind_by_text(prompts, one, "text", ["i"], 2).collect()
    assert sorted((r.i, r.group_index) for r in bound) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]
    fails(lambda: guards.bind_by_text(prompts, one.unionAll(one), "text", ["i"], 2), "two scenarios")
    fails(lambda: guards.bind_by_text(prompts, one.where("false"), "text", ["i"], 2), "no entry")


def test_verdict_goes_turn_by_turn(spark):
    rows = [("a", 0, True, 2, True, False), ("a", 1, True, 2, False, True), ("b", 0, True, 2, False, False), ("b", 1, True, 2, True, True), ("c", 0, True, 1, True, True)]
    got = evaluation.task_verdict(spark.createDataFrame(rows, "task_id string, turn int, completed boolean, expected_turns int, state_match boolean, result_match boolean"))
    assert {r.task_id: (r.verdict, r.state_match_rate, r.result_match_rate) for r in got.collect()} == {
        "a": ("result_mismatch_at_turn_0", 1.0, 0.0), "b": ("state_mismatch_at_turn_0", 0.0, None), "c": ("pass", 1.0, 1.0)
    }


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_running_totals_equal_a_plain_scan(spark, n):
    rows = spark.range(n).select((F.col("id") * 7919 % 1009).alias("a"), F.col("id").alias("b"), F.when(F.col("id") % 3 != 0, F.col("id") % 11).alias("v"))
    got = [(r.a, r.b, r.t) for r in ordered.running(rows, ["a", "b"], F.col("v"), "t").orderBy("a", "b").collect()]
    want, total = [], 0
    for r in sorted(rows.collect()):
        total += r.v or 0
        want.append((r.a, r.b, total))
    assert got == want


def test_running_totals_with_null_and_nan_keys(spark):
    rows = spark.createDataFrame([(None, 1), (float("nan"), 2), (1.0, 4), (None, 8)], "k double, v int")
    got = ordered.running(rows, ["k", "v"], F.col("v"), "t").collect()
    assert {r.v: r.t for r in got} == {1: 1, 8: 9, 4: 13, 2: 15}
    assert batching.whole_groups(rows, ["k", "v"], 3).count() == 3


def test_valid_rows_scenarios_resume(spark):
    rows = spark.createDataFrame([(1, None), (2, "bad"), (3, None)], "i int, malformed_reason string")
    assert guards.valid_rows(rows).count() == 2 and guards.valid_rows(rows, limit=1).count() == 1
    fails(guards.valid_rows(rows, strict=True), "bad")
    kinds = "task_id string, env_id string, env_class_name string, checklist array<string>"
    fails(guards.scenarios(spark.createDataFrame([("a", "e", "E", [])], kinds)), "a: empty checklist")
    fails(guards.scenarios(spark.createDataFrame([("a", None, "E", ["c"])], kinds)), "missing env_id")
    runs = spark.createDataFrame([("run", "x"), ("p1", "x"), (None, "x")], "name string, gpu string")
    assert guards.resumable(runs, {"gpu": "x"}).count() == 2
    fails(guards.resumable(runs, {"gpu": "y"}), "another identity")


def test_bundle_faults(spark):
    kinds = "folder string, run_number int, config string, point_config string, input_lens array<int>, completed int, failed int"
    rows = [("f", 1, "c", "c", [1], 199, 1), ("f", 2, "c", "c", [2], 200, 0), ("f", 3, "c", "d", [1], 200, 0), ("f", 4, "c", None, [1], 200, 0), ("f", 5, "c", "c", [1], 100, 0)]
    got = {r.run_number: r.fault for r in guards.bundle_faults(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {1: None, 2: "input lengths differ", 3: "config differs from its point", 4: "no point", 5: "request count"}


def test_admission(spark):
    rows = spark.createDataFrame([("e", i, n) for i, n in enumerate([5, 2, 4, 1])], "e string, i int, n int")
    got = {r.i: (r.starts, r.ends) for r in turns.admit(rows, ["e"], ["i"], "n", 2).collect()}
    assert got == {0: (0, 5), 1: (0, 2), 2: (2, 6), 3: (5, 6)}
    assert {r.starts for r in turns.admit(rows, ["e"], ["i"], "n", None).collect()} == {0}


def test_layers_overrides_and_caps(tmp_path):
    types = {"a.x": "int", "a.y": "list", "a.z": "float?", "b": "bool"}
    assert config.layered({"a": {"x": 1, "y": [1, 2]}}, {"a": {"y": [3]}}, {"b": True}) == {"a": {"x": 1, "y": [3]}, "b": True}
    got = config.resolve(types, {"a": {"x": 9}}, {"a": {"x": 2, "y": ["q"]}}, {}, ["a.x=7", "a.y=u, v,", "a.z=null", "b=off"])
    assert got == {"a": {"x": 7, "y": ["u", "v"], "z": None}, "b": False}
    for bad, why in ((["a.x=10"], "exceeds"), (["a=1"], "no such"), (["b=maybe"], "no boolean"), (["a.x"], "no such")):
        with pytest.raises(ValueError, match=why):
            config.resolve(types, {"a": {"x": 9}}, {}, {}, bad)
    with pytest.raises(ValueError, match="unknown settings: q"):
        config.resolve(types, {}, {"q": 1}, {})
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"a": {"x": 3}}))
    assert config.load(str(path)) == {"a": {"x": 3}}
    path.write_text("[1]")
    with pytest.raises(ValueError, match="no mapping"):
        config.load(str(path))
    pytest.importorskip("yaml")
    other = tmp_path / "c.yaml"
    other.write_text(config.profile_yaml({"n": 32, "share": 0.9, "cache": None, "masks": True}, ["measured"]))
    assert other.read_text() == "# measured\nn: 32\nshare: 0.90\ncache: null\nmasks: true\n"
    assert config.load(str(other)) == {"n": 32, "share": 0.9, "cache": None, "masks": True}


def test_manifests():
    made = config.manifest({"steps": 3}, {"backend": "v"})
    assert len(made["recorded_free"]) == 15 and made["recorded_free"]["dtype"] is None and len(made["invariant_hash"]) == 64
    assert config.workload_manifest({"b": "1", "a": "2"}, ["b", "a", "b"], {"n": 200})["categories"] == ["a", "b"]
    with pytest.raises(ValueError, match="hashes of"):
        config.workload_manifest({"a": "2"}, ["a", "b"], {})
    assert "None." in config.sweep_report("Sweep", {"Profiles": [{"p": "x", "t": 1.0}], "Pairs": []})
