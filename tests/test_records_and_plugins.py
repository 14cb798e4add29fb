import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from trellium.functions import arrays, python_calls, text, toolcalls
from trellium.operators import batching, checks, evaluation, ordered, plugins, records, sweep, telemetry, trajectories, turns
from trellium.sources import config, files
from trellium.streaming import metrics, snapshots


def fails(df, words):
    with pytest.raises(Exception, match=words):
        df.collect()


def test_lineage_does_not_depend_on_the_place(spark, tmp_path):
    for top in ("here", "there/deep"):
        for name, body in (("b.json", b"2"), ("a/c.json", b"\x00\xff"), ("a.json", b""), ("x.txt", b"no")):
            f = tmp_path / top / name
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_bytes(body)
    want = hashlib.sha256()
    for name, body in (("a/c.json", b"\x00\xff"), ("a.json", b""), ("b.json", b"2")):
        want.update(name.encode() + b"\0" + hashlib.sha256(body).digest())
    for top in ("here", "there/deep"):
        assert files.lineage_hash(spark, str(tmp_path / top), "*.json").first()[0] == want.hexdigest()


def test_files_are_verified(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    digest = hashlib.sha256(b"abc").hexdigest()
    assert files.pinned(spark, [str(tmp_path / "none"), str(tmp_path / "x")], digest) == str(tmp_path / "x")
    with pytest.raises(ValueError):
        files.verified(spark, str(tmp_path / "x"), "0" * 64)
    with pytest.raises(FileNotFoundError):
        files.pinned(spark, [str(tmp_path / "none")], digest)
    (tmp_path / "y.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n[oops\n')
    assert [(r["line"], r["text"]) for r in files.bad_lines(spark, str(tmp_path / "y.jsonl")).orderBy("line").collect()] == [(3, "not json"), (5, "[oops")]


def test_metric_labels(spark):
    lines = ['m{a="1",a="2",b="x, y=\\"z\\"} q"} +Inf', "m -3e2", "# c", "m{} nan", "lonely", "m 1_0", ".5 .5", "m 5."]
    got = files.metric_samples(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert got[0]["labels"] == {"a": "2", "b": 'x, y="z"} q'} and math.isinf(got[0]["number"])
    assert [r["number"] for r in got if not math.isnan(r["number"])][1:] == [-300.0, 0.5, 5.0] and sum(math.isnan(r["number"]) for r in got) == 1


def test_values_are_read_as_python_does(spark):
    said = ["+5", ".5", "1.", "1_000", "007", "-0", "1e3", "True", "[1, 2", '{"b": 1}', "a b", " 7 ", "1__0", "_1", "12 3", ""]
    got = spark.createDataFrame([(x,) for x in said], "x string").select(F.to_json(toolcalls.coerce(F.col("x"), F.lit("any"))).alias("j")).collect()
    want = [5, 0.5, 1.0, 1000, 7, 0, 1000.0, True, "[1, 2", {"b": 1}, "a b", 7, "1__0", "_1", "12 3", ""]
    assert [json.loads(r["j"]) for r in got] == want
    inf = spark.createDataFrame([("-inf",), ("Infinity",)], "x string").select(F.try_variant_get(toolcalls.coerce(F.col("x"), F.lit("any")), "$", "double").alias("d")).collect()
    assert [r["d"] for r in inf] == [-math.inf, math.inf]


def test_calls_as_python_text(spark):
    rows = [("f", '{"a": "it\'s", "b": [1, {"c": null}], "d": true, "e": 1.5}'), ("g", "{}"), ("h", "oops"), (None, "{}")]
    got = spark.createDataFrame(rows, "n string, a string").select(python_calls.call_text(F.col("n"), F.col("a")).alias("t")).collect()
    assert [r["t"] for r in got] == ["""f(a="it's", b=[1, {'c': None}], d=True, e=1.5)""", "g()", None, None]


def test_containers_by_json(spark):
    rows = [("[1]", "array"), ("{'a'}", "object"), ("[1", "array"), ('{"a": 1}', "object"), ('{"a": 1}', "array")]
    got = spark.createDataFrame(rows, "v string, d string").select(python_calls.coerce_argument(F.col("v"), F.col("d"))["reason"].alias("r")).collect()
    assert [r["r"] for r in got] == [None, "not object", "not array", None, "not array"]


def test_hosts_of_ipv6(spark):
    urls = ["http://[fd00::1]:80/a", "http://u:p@[fe80::1%25eth0]/b?q", "http://[2001:db8::1]/c", "https://[::1]:8443/"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(text.redact_endpoint(F.col("u")).alias("r")).collect()
    assert [r["r"] for r in got] == ["http://[fd00::1]:80/a", "http://[fe80::1%25eth0]/b", "http://redacted/c", "https://[::1]:8443/"]


def test_runs_that_differ(spark):
    a = spark.createDataFrame([(1, 0.5, ["x"]), (2, None, ["x"]), (3, 0.25, ["x"]), (4, 1.0, [])], "k long, r double, o array<string>")
    b = spark.createDataFrame([(1, None, ["x"]), (2, None, ["x"]), (3, 0.25 + 1e-12, ["y"]), (5, 1.0, [])], "k long, r double, o array<string>")
    got = evaluation.equivalence(a, b, "k", "r", lists=["o"]).select("k", "problem").collect()
    assert sorted(map(tuple, got)) == [(1, "reward"), (3, "o"), (4, "only_left"), (5, "only_right")]


def test_comparisons_are_guarded(spark):
    m = spark.createDataFrame([("c", "a", 1.0), ("c", "b", 2.0)], "category string, tag string, score double")
    one, other = (spark.createDataFrame([("seed", v)], "key string, value string") for v in "12")
    assert evaluation.comparison_table(m, ["a", "b"], "score", [one, one]).first()["b"] == 2.0
    for tags, manifests in ((["a"], []), (["a", "a"], []), (["a", "b"], [one, other])):
        with pytest.raises(ValueError):
            evaluation.comparison_table(m, tags, "score", manifests)


def test_guards_fire(spark):
    fails(sweep.assert_single(spark.createDataFrame([("a",), ("b",)], "h string"), "h"), "more than one")
    fails(evaluation.reward_contract(spark.createDataFrame([(1.5,)], "reward double")), "reward")
    long = spark.createDataFrame([([1, 2, 3], [1, 2, 3], 0)], "input_ids array<int>, labels array<int>, b int")
    fails(records.collate(long, ["b"], 0, 2), "beyond")
    fails(records.flatten_batches(long, ["b"], ["b"], 2), "budget")
    fails(records.shard_stats(long, 2), "longest")
    assert tuple(records.shard_stats(long.where("false")).first()) == (0, 0, 0, None)
    row = {"prompt_ids": [0], "completion_ids": [1, 2], "logprobs": [-0.1, math.nan], "env_mask": [1, 0], "reward": 1.0, "scenario_id": "s"}
    kind = "prompt_ids array<int>, completion_ids array<int>, logprobs array<double>, env_mask array<int>, reward double, scenario_id string"
    assert records.assemble(spark.createDataFrame([row], kind)).count() == 1
    for change, words in (({"env_mask": [0, 0]}, "masked"), ({"reward": None}, "reward"), ({"logprobs": [-0.1]}, "diverge")):
        fails(records.assemble(spark.createDataFrame([row | change], kind)), words)
    fails(records.categories(spark.createDataFrame([("multi_turn_x",)], "c string"), "c", ["a"], "multi_turn"), "elsewhere")
    fails(records.categories(spark.createDataFrame([("z",)], "c string"), "c", ["a"], "multi_turn"), "unknown")
    fails(records.zip_positions(spark.range(3), spark.range(2).withColumnRenamed("id", "j"), ["id"], ["j"]), "differ")
    fails(spark.range(1).select(text.checked_sha256(F.lit("x"), F.lit("00"))), "digest")
    fails(trajectories.trim_after_last_assistant(spark.createDataFrame([(1, 0, "assistant", "x")], "conv_id int, turn int, role string, text string"), strict=True), "no turn of the user")
    fails(checks.exact_fractions(spark.createDataFrame([("t", True), ("t", False)], "t string, passed boolean"), ["t"], F.lit(2)), "1 of 2")
    fails(plugins.scripted(spark.range(1), spark.createDataFrame([(5, "x")], "id long, reply string"), ["id"]), "no scripted reply")


def test_points_and_positions(spark):
    found = spark.createDataFrame([(1,), (1,), (3,)], "p int")
    got = files.point_faults(found, spark.createDataFrame([(1,), (2,)], "p int"), ["p"]).collect()
    assert sorted(map(tuple, got)) == [(1, "repeated"), (2, "missing"), (3, "unexpected")]


def test_states_and_checks(spark):
    states = ['{"b": [1, {"z": 1, "a": 2}], "a\\"q": "x", "__d__": 1}', "[1]", None, "oops"]
    got = spark.createDataFrame([(s,) for s in states], "s string").select(checks.snapshot(F.col("s")).alias("j")).collect()
    assert [r["j"] for r in got] == ['{"a\\"q":"x","b":[1,{"a":2,"z":1}]}', None, None, None]
    rows = [("$.n", "ge", "3"), ("$.n", "le", "2"), ("$.s", "contains", '"or"'), ("$.s", "eq", '"word"'), ("$.s", "ge", "1"), ("$.x", "exists", ""), ("$.n", "run", "1")]
    asked = spark.createDataFrame([("t", *r) for r in rows] + [("u", "$.n", "eq", "1")], "t string, path string, op string, value string")
    judged = checks.run_checks(spark.createDataFrame([("t", '{"n": 3, "s": "word"}')], "t string, state string"), asked, ["t"])
    assert {(r["path"], r["op"]): r["passed"] for r in judged.where("t = 't'").collect()} == {(p, o): i in (0, 2, 3) for i, (p, o, _) in enumerate(rows)}
    assert judged.where("t = 'u'").first()["passed"] is False


@pytest.mark.parametrize("small", [1000, 30])
def test_windows_of_values_in_ranges(spark, monkeypatch, small):
    monkeypatch.setattr(ordered, "RANGES", 3)
    monkeypatch.setattr(ordered, "SMALL", small)
    rows = [(k, i, float((i * 7 + (k or 5)) % 11)) for k in (None, 1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    sums = {(r["k"], r["i"]): r["s"] for r in ordered.running(df, ["i"], F.col("v"), "s", ["k"]).collect()}
    last = {(r["k"], r["i"]): r["p"] for r in ordered.previous(df, ["i"], "v", "p", ["k"]).collect()}
    most = {(r["k"], r["i"]): r["m"] for r in ordered.largest_before(df, ["i"], "v", "m", ["k"]).collect()}
    for k in (None, 1, 2):
        v = [x[2] for x in rows if x[0] == k]
        for i in range(40):
            assert sums[k, i] == sum(v[: i + 1]) and last[k, i] == (v[i - 1] if i else None) and most[k, i] == (max(v[:i]) if i else None)


@pytest.mark.parametrize("whole", [10_000, 20])
def test_ranks(spark, monkeypatch, whole):
    monkeypatch.setattr(ordered, "WHOLE", whole)
    monkeypatch.setattr(ordered, "BRACKET", 0.05)
    rows = [(g, float(i * i % 97)) for g, n in (("a", 400), ("b", 3), ("c", 1)) for i in range(n)] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for q in (0.5, 0.95, 0.99):
        got = {r["g"]: r["p"] for r in telemetry.nearest_rank(df, ["g"], "v", q).collect()}
        low = {r["g"]: r["p"] for r in telemetry.rounded_index(df, ["g"], "v", 100 * q).collect()}
        for g in "abc":
            v = sorted(x for k, x in rows if k == g and x is not None)
            assert got[g] == v[max(1, math.ceil(q * len(v))) - 1] and low[g] == v[round(q * (len(v) - 1))]
        assert len(got) == 3


def test_stage_table_prefers_intervals(spark):
    samples = spark.createDataFrame([("generation", 1.0), ("generation", 2.0), ("parse", 0.5), ("odd", 9.0)], "stage string, seconds double")
    spans = spark.createDataFrame([("generation", 0.0, 2.0), ("generation", 1.0, 2.5), ("env.step", 2.0, 4.0)], "stage string, start double, end double")
    got = {r["stage"]: (r["total_s"], r["calls"], r["max_s"]) for r in telemetry.stage_table(samples, spans, 5.0, 3).orderBy("place").collect()}
    assert got == {"generation": (2.5, 2, 2.0), "env.step": (2.0, 1, 2.0), "parse": (0.5, 1, 0.5), "scheduling": (1.0, 3, 0.0)}
    none = telemetry.stage_table(samples, spans.where("false"), 5.0).where("stage = 'scheduling'").first()
    assert none["total_s"] == 1.5


def test_history_and_tools(spark):
    kind = "array<struct<role:string,content:string,reasoning_content:string>>"
    said = [("user", "q", None), ("assistant", "<think>\nold\n</think>\n\nA", None), ("user", "<tool_response>r</tool_response>", None), ("assistant", "B", "new"), ("user", "more", None), ("assistant", "C", None)]
    df = spark.createDataFrame([(said,), (said[:4],)], f"m {kind}")
    last = [[x["content"] for x in r["m"]] for r in df.select(trajectories.with_history(F.col("m")).alias("m")).collect()]
    assert last[0] == ["q", "A", "<tool_response>r</tool_response>", "B", "more", "<think>\n\n</think>\n\nC"]
    assert last[1] == ["q", "<think>\nold\n</think>\n\nA", "<tool_response>r</tool_response>", "<think>\nnew\n</think>\n\nB"]
    every = df.select(trajectories.with_history(F.col("m"), True).alias("m")).first()["m"]
    assert every[1]["content"].startswith("<think>\nold")
    shown = spark.range(1).select(trajectories.tools_prompt(F.array(F.lit('{"n":1}')), F.lit(" Be. ")).alias("t"), trajectories.tools_prompt(F.array().cast("array<string>"), F.lit("Be.")).alias("u")).first()
    assert shown["t"].endswith('<tools>\n{"n":1}\n</tools>\n\nBe.') and shown["u"] == "Be."


def test_release_rows_in_full(spark):
    message = json.dumps([{"role": "assistant", "content": "", "reasoning_content": "", "tool_calls": [{"function": {"name": "f", "arguments": '{"a": 1}'}}, {"name": "g", "arguments": "oops"}, {"name": "h", "arguments": "[1]"}, {"function": {"arguments": "{}"}}]}])
    rows = [({"task_id": "t"}, message, '[{"name": "f"}, 3, "x"]', '["u", {"a": 1}, 5]'), ({"task_id": "t"}, message, '{"a": 1}', None), ({"task_id": "t"}, message, None, "{")]
    df = spark.createDataFrame(rows, "task_info struct<task_id:string>, messages string, tools string, user_messages string").withColumns({"traj_type": F.lit("c"), "steps": F.lit(2)})
    got = trajectories.parse_release(df).collect()
    assert [r["malformed_reason"] for r in got] == [None, "tools: not a list", "user_messages: not JSON"]
    assert got[0]["tool_list"] == ['{"name":"f"}'] and got[0]["said"] == ["u", '{"a": 1}', "5"]
    assert [(c["name"], json.loads(c["arguments"])) for c in got[0]["decoded"][0]["tool_calls"]] == [("f", {"a": 1}), ("g", {"__raw__": "oops"}), ("h", {"__value__": [1]})]
    shown = json.loads(trajectories.parse_release(df).select(trajectories.message_json(F.col("decoded")[0]).alias("j")).first()["j"])
    assert shown == {"role": "assistant", "content": "", "tool_calls": [{"type": "function", "function": {"name": n, "arguments": a}} for n, a in (("f", {"a": 1}), ("g", {"__raw__": "oops"}), ("h", {"__value__": [1]}))]}


def test_messages_are_decoded_by_type(spark):
    said = [{"role": "user", "content": {"a": [1, "x,:y\\\""], "b": None}, "reasoning_content": {"z": 1}}, {"role": "tool", "content": None, "name": "n"}]
    rows = [json.dumps(said), '[{"role": 5, "content": "x"}]', '[3]', '[{"content": "x"}]', "{}"]
    df = spark.createDataFrame([({"task_id": "t"}, m, None, 1) for m in rows], "task_info struct<task_id:string>, messages string, tools string, steps int").withColumn("traj_type", F.lit("c"))
    got = trajectories.parse_release(df).collect()
    assert [r["malformed_reason"] for r in got] == [None, "messages.role: empty", "messages: not an object", "messages.role: empty", "messages: not a list"]
    first, second = got[0]["decoded"]
    assert first["content"] == json.dumps(said[0]["content"], ensure_ascii=False) and second["content"] is None and second["name"] == "n"


def test_records_have_all_their_columns(spark):
    rows = [("a", 0, "user", "one two"), ("a", 1, "assistant", "three"), ("a", 2, "user", "four"), ("b", 0, "user", "x"), ("c", 0, "assistant", "y")]
    about = spark.createDataFrame([(u, u, "e") for u in "abc"], "trajectory_uid string, task_id string, env_id string")
    made = trajectories.sft_records(spark.createDataFrame(rows, "trajectory_uid string, turn int, role string, text string"), about, trajectories.hashed_words(), 2, "full", "m", "f")
    assert tuple(made.columns) == trajectories.RECORD
    (r,) = made.collect()
    assert (r["trajectory_uid"], r["seq_length"], r["supervised_tokens"], r["trailing_messages_removed"]) == ("a", 3, 1, 1) and r["labels"][:2] == [-100, -100] and r["labels"][2] == r["input_ids"][2]


def test_spans_must_mark_what_the_mask_marks(spark):
    row = {"prompt_ids": [0], "completion_ids": [1, 2], "logprobs": [-0.1, math.nan], "env_mask": [1, 0], "reward": 1.0, "scenario_id": "s", "mask_spans": [(0, 1, False), (1, 2, True), (2, 3, False)], "boundary": 1, "trajectory": "t"}
    kind = "prompt_ids array<int>, completion_ids array<int>, logprobs array<double>, env_mask array<int>, reward double, scenario_id string, mask_spans array<struct<start:int,end:int,supervised:boolean>>, boundary int, trajectory string"
    assert records.assemble(spark.createDataFrame([row], kind)).first()["trajectory"] == "t"
    fails(records.assemble(spark.createDataFrame([row | {"mask_spans": [(0, 1, False), (1, 3, True)]}], kind)), "spans and mask disagree")


def test_prefixes_that_drift(spark):
    kind = "array<struct<start:int,end:int,supervised:boolean>>"
    rows = [([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6, 7]), ([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 9]), ([1, 2, 3, 4, 5, 6], [8])]
    df = spark.createDataFrame(rows, "h array<int>, f array<int>").withColumn("s", F.expr(f"cast(array(struct(0, 2, false), struct(2, 6, true)) as {kind})"))
    got = [r["r"] for r in df.select(arrays.reopened(F.col("h"), F.col("s"), F.lit(2), F.col("f"), F.lit(2)).alias("r")).collect()]
    assert [(r["kind"], r["drift"], r["boundary"], r["tokens"]) for r in got] == [("clean", 0, 2, rows[0][1]), ("realign", 2, 2, rows[1][1]), ("fork", 6, 0, [8])]
    assert [[tuple(x) for x in r["spans"]] for r in got] == [[(0, 2, False), (2, 6, True), (6, 7, False)], [(0, 2, False), (2, 4, True), (4, 5, False)], [(0, 1, False)]]
    one = spark.range(1).select(records.span_sum_matches(F.expr(f"cast(array(struct(0, 2, false), struct(2, 6, true)) as {kind})"), F.lit(3), F.array(*map(F.lit, (1, 1, 1)))).alias("x")).first()
    assert one["x"] is True


def test_crashes_retire_what_the_worker_holds(spark):
    episodes = spark.createDataFrame([(0, "w", 0, 0.0, 5.0), (1, "w", 0, 3.0, 9.0), (2, "x", 0, 0.0, 9.0), (0, "w", 1, 5.0, 9.0)], "position int, worker string, attempt int, opened double, ended double")
    got = turns.replaced(spark.createDataFrame([("w", 4.0)], "worker string, at double"), episodes).collect()
    assert {(r["episode_id"], r["outcome"]) for r in got} == {("0", "worker_crash"), ("1", "worker_crash"), ("2", "finished"), ("0~1", "finished")}
    fails(turns.replaced(spark.createDataFrame([], "worker string, at double"), episodes.withColumn("attempt", F.lit(4))), "more than 3")


def test_plugins_and_epochs(spark):
    with pytest.raises(ValueError):
        plugins.register("marks", lambda m: m)
    with pytest.raises(ValueError):
        plugins.rendered(spark.range(1), "none")
    df = spark.createDataFrame([([("user", "a b"), ("tool", "r")],)], "messages array<struct<role:string,content:string>>")
    assert "<tool_response>\nr" in plugins.rendered(df, "marks").first()["rendered"]
    batches = spark.createDataFrame([(0, 5), (1, 0), (1, 4)], "epoch int, batch int")
    assert sorted(map(tuple, batching.resume(batches, 3, epoch=0).collect())) == [(0, 5), (1, 0), (1, 4)]
    assert arrays and spark.range(1).select(arrays.cut(F.array(F.lit(1), F.lit(2)), F.lit(1)).alias("c")).first()["c"] == [1]


def test_findings_and_reports():
    said = config.findings([{"uplift": 10.0}, {"uplift": -2.0}, {"uplift": 20.0}], "bf16", "fp8", "throughput")
    assert "2 of 3" in said[0] and "+10.00%" in said[1] and "+10.00%" in config.sweep_report("t", {"p": []}, said)
    body, table = config.report([{"category": "c", "score": 0.5, "exact_success_rate": None}], exact=False)
    assert json.loads(body) == {"categories": [{"category": "c", "score": 0.5}]} and "0.5000" in table


def test_streams_of_snapshots_and_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p-after-run-1.prom").write_text("# x\nhits 3\nhits{a=\"1\"} 2\n")
    (tmp_path / "in" / "p-after-run-2.prom").write_text("hits 9\n")
    (tmp_path / "in" / "other.txt").write_text("hits 100\n")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    snapshots.start(snapshots.snapshots(spark, str(tmp_path / "in")), out, check, None).awaitTermination()
    (tmp_path / "in" / "p-after-run-3.prom").write_text("hits 10\n")
    snapshots.start(snapshots.snapshots(spark, str(tmp_path / "in")), out, check, None).awaitTermination()
    got = spark.read.parquet(out).groupBy("prefix", "run").agg(F.sum("number").alias("n")).orderBy("run").collect()
    assert list(map(tuple, got)) == [("p", 1, 5.0), ("p", 2, 9.0), ("p", 3, 10.0)]
    tasks = spark.createDataFrame([("c", 1.0, 0, 2, 10, False, True), ("c", 0.0, 1, 2, 30, True, None)], "category string, score double, invalid_calls int, steps int, generated_tokens int, truncated boolean, exact_success boolean")
    tasks.write.parquet(str(tmp_path / "done"))
    stream = spark.readStream.schema(tasks.schema).parquet(str(tmp_path / "done"))
    snapshots.evaluated(stream, str(tmp_path / "records"), str(tmp_path / "c2"), None).awaitTermination()
    row = snapshots.summary(spark, str(tmp_path / "records")).first()
    assert (row["n_tasks"], row["score"], row["invalid_call_rate"]) == (2, 0.5, 0.25)
    schema = tasks.schema
    tasks.write.json(str(tmp_path / "json"))
    assert records.read_back(spark, str(tmp_path / "json"), schema).count() == 2


def test_a_ratio_without_queries(spark):
    rows = spark.createDataFrame([("a", 0.0), ("b", 2.0)], "start string, rate double")
    assert {r["start"]: r["ratio"] for r in metrics.rate_ratio(rows.where("rate > 0"), rows).collect()} == {"a": None, "b": 1.0}
