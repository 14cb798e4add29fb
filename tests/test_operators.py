import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from trellium.functions import arrays, text, toolcalls
from trellium.operators import batching, evaluation, ordered, sweep, telemetry, trajectories


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("small", [1_000_000, 5])
def test_skylines_agree(spark, monkeypatch, small):
    monkeypatch.setattr(ordered, "SMALL", small)
    rows = [(i % 3, float(i * 7 % 11), float(i * 5 % 13)) for i in range(60)] + [(0, 10.0, 0.0), (0, 10.0, 0.0)]
    df = spark.createDataFrame(rows, "g int, gain double, cost double")
    a, b = sweep.pareto(df, "gain", "cost", ["g"]), sweep.pareto_by_antijoin(df, "gain", "cost", ["g"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sweep.pareto(df.where("g < 0"), "gain", "cost", ["g"]).collect() == []
    assert sorted(map(tuple, sweep.pareto(df, "gain", "cost").collect())) == sorted(map(tuple, sweep.pareto_by_antijoin(df, "gain", "cost").collect()))


def test_point_reasons_in_order(spark):
    rows = [("a", 1, 0, 0), ("a", 1, 1, 0), ("b", 1, 1, 1), ("b", 2, 0, 0), ("c", 1, 0, 2), ("c", 2, 0, 0), ("d", 1, 0, 0), ("d", 2, 0, 0)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "k string, repetition int, failed int, preemptions int, x double")
    got = {r["k"]: r["reason"] for r in sweep.points(df, ["k"], ["x"], 2).collect()}
    assert got == {"a": "duplicate_repetition", "b": "failed_requests", "c": "preemptions", "d": None}


@pytest.mark.parametrize("small", [1_000_000, 3])
def test_points_have_exact_medians(spark, monkeypatch, small):
    monkeypatch.setattr(ordered, "SMALL", small)
    monkeypatch.setattr(ordered, "WHOLE", small)
    rows = [(k, i, float((i * 37) % 101), float(i) if i % 5 else None, 0, 0) for k, n in (("a", 40), ("b", 41), (None, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, repetition int, x double, y double, failed int, preemptions int")
    got = {r["k"]: r for r in sweep.points(df, ["k"], ["x", "y"]).collect()}
    for k in ("a", "b", None):
        for m, at in (("x", 2), ("y", 3)):
            values = [r[at] for r in rows if r[0] == k and r[at] is not None]
            assert got[k][f"med_{m}"] == statistics.median(values) and (got[k][f"min_{m}"], got[k][f"max_{m}"]) == (min(values), max(values))
        assert got[k]["n_runs"] == sum(r[0] == k for r in rows) and got[k]["valid"]


def test_group_variance_case(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 0.5), (1, 0.5)], "group_index int, reward double")
    r = evaluation.group_variance(df).first()
    assert (r["mean_variance"], r["zero_fraction"], r["useful_fraction"]) == (0.125, 0.5, 0.5)


def test_overlapping_intervals_count_once(spark):
    df = spark.createDataFrame([("x", 1.0, 1.5), ("x", 1.3, 2.0), ("x", 1.9, 2.0)], "s string, a double, b double")
    assert telemetry.union_duration(df, ["s"], "a", "b").first()["busy"] == pytest.approx(1.0)


def test_packing_cases(spark):
    def packed(lengths, budget, padded):
        df = spark.createDataFrame([(0, i, n) for i, n in enumerate(lengths)], "s int, i int, n int")
        return [r["batch"] for r in batching.pack(df, ["s"], ["i"], "n", budget, padded).orderBy("i").collect()]

    assert packed([6, 4, 4], 10, True) == [0, 1, 1]
    assert packed([7, 3, 5, 2, 9, 4], 12, False) == [0, 0, 1, 1, 2, 3]
    with pytest.raises(Exception, match="cannot be in a batch"):
        packed([11], 10, False)


def packed_in_turn(lengths, budget, padded):
    out, batch, count, total, longest = [], 0, 0, 0, 0
    for n in lengths:
        cost = (count + 1) * max(longest, n) if padded else total + n
        if count and cost > budget:
            batch, count, total, longest = batch + 1, 0, 0, 0
        count, total, longest = count + 1, total + n, max(longest, n)
        out.append(batch)
    return out


@pytest.mark.parametrize("padded", [False, True])
@pytest.mark.parametrize(("block", "low"), [(1, 4), (64, 9), (1 << 18, 1)])
def test_packing_in_blocks_is_packing_in_turn(spark, padded, block, low):
    rng = random.Random(block)
    by_shard = {None: [rng.randint(low, 40) for _ in range(700)], "a": [rng.choice((low, 60, 75)) for _ in range(300)], "b": [70]}
    rows = [(s, i, n, "kept") for s, ns in by_shard.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "s string, i int, n int, batch string").repartition(3)
    got = batching.pack(df, ["s"], ["i"], "n", 70, padded, alone=True, block=block).orderBy("s", "i").collect()
    for s, ns in by_shard.items():
        assert [r["batch"] for r in got if r["s"] == s] == packed_in_turn(ns, 70, padded)
    assert len(got) == len(rows) and batching.pack(df.where("i < 0"), ["s"], ["i"], "n", 70).collect() == []


def test_call_round_trip(spark):
    args = F.create_map(F.lit("a"), F.lit("1\n2"), F.lit("b"), F.lit('{"x": [1]}'))
    r = one(spark, c=toolcalls.parse_calls(toolcalls.serialize_call(F.lit("f"), args)))["c"]
    assert r[0]["name"] == "f" and r[0]["arguments"] == {"a": "1\n2", "b": '{"x": [1]}'}


def test_repeated_parameter_keeps_the_last(spark):
    t = "<tool_call><function=f><parameter=a>1</parameter><parameter=a>2</parameter></function></tool_call>"
    assert one(spark, c=toolcalls.parse_calls(F.lit(t)))["c"][0]["arguments"] == {"a": "2"}


@pytest.mark.parametrize(
    ("turn", "outcome"),
    [
        ("hi", "no_call"), ("<tool_call><function=f>", "malformed_syntax"), ("<tool_call></tool_call>", "malformed_syntax"),
        ("<tool_call><function=></function></tool_call>", "malformed_syntax"), ("<tool_call><function=g></function></tool_call>", "unknown_tool"),
        ("<tool_call><function=f></function></tool_call>", "bad_arguments"),
        ("<tool_call><function=f><parameter=a>1</parameter></function></tool_call>", "ok"),
        ("<tool_call><function=f><parameter=a>1</parameter></function><function= ></function></tool_call>", "malformed_syntax"),
        ("<tool_call><function=f><parameter=a>x</parameter></function></tool_call>", "bad_arguments"),
        ("<tool_call><function=f><parameter=a>1</parameter><parameter=z>1</parameter></function></tool_call>", "bad_arguments"),
        ("<function=f></function><tool_call></tool_call>", "no_call"),
    ],
)
def test_turn_outcomes(spark, turn, outcome):
    needs = F.create_map(F.lit("f"), F.array(F.struct(F.lit("a").alias("name"), F.lit("integer").alias("type"), F.lit(True).alias("required"))))
    assert one(spark, o=toolcalls.classify_turn(F.lit(turn), F.array(F.lit("f")), needs))["o"] == outcome


def test_parsed_turn(spark):
    turn = "<think> why </think> said <tool_call><function=f><parameter=a>\n+1_0\n</parameter></function></tool_call>"
    got = one(spark, p=toolcalls.parse_turn(F.lit(turn)), q=toolcalls.parse_turn(F.lit("  plain \n")), n=toolcalls.parse_turn(F.lit(None).cast("string")))
    assert tuple(got["p"]) == ("ok", "f", {"a": "+1_0"}, "said", "why", None)
    assert tuple(got["q"]) == ("no_call", None, None, "plain", "", None) and got["n"] is None


@pytest.mark.parametrize(
    ("text", "calls"),
    [
        ('{"name": "f"}', [("f", {})]), ('[{"name": "f", "args": {"a": [1, 2]}}]', [("f", {"a": "[1,2]"})]), ('x\n[{"name": "f"}, 3]', []), ('{"name": "f", "arguments": null}', []),
        ('<tool_call>\n{\n "name": "g",\n "arguments": {"x": {"y": 1}}\n}\n</tool_call>', [("g", {"x": '{"y":1}'})]), ('<tool_call>[{"name": "g"}]</tool_call>', []),
        ('<tool_call>{"name": "g", "arguments": 3}</tool_call>\n{"name": "h"}', [("h", {})]), ("plain", []), (None, []),
    ],
)
def test_json_calls(spark, text, calls):
    got = one(spark, c=toolcalls.any_calls(F.lit(text).cast("string")))["c"]
    assert [(c["name"], c["arguments"]) for c in got] == calls


@pytest.mark.parametrize(
    ("annotation", "kind"),
    [
        ("None | int", "integer"), ("Union[int, None]", "integer"), ("typing.Optional[int]", "integer"), ("int | None", "integer"), ("Union[int, str]", "string"), ("typing.Dict[str, int]", "object"),
        ("Union[None, Dict[str, int]]", "object"), ("Union[Dict[str, int], str]", "string"), ("Optional[Optional[bool]]", "boolean"), ("float", "number"), ("Foo", "string"),
    ],
)
def test_types_of_annotations(spark, annotation, kind):
    assert one(spark, k=toolcalls.json_type(F.lit(annotation)))["k"] == kind

def test_reasoning(spark):
    r = one(
        spark, a=toolcalls.split_reasoning(F.lit("<think> r </think> c")), b=toolcalls.split_reasoning(F.lit("<think>open")),
        c=toolcalls.split_continuation(F.lit("r</think>c")), d=toolcalls.split_continuation(F.lit("c"), False), e=toolcalls.is_done(F.lit("x</think> <Task_Finished>.\n")),
        f=toolcalls.any_calls(F.lit('text\n[{"name": "f", "arguments": {"a": "1"}}]')), g=toolcalls.json_type(F.lit("Optional[List[int]]")),
    )
    assert [tuple(r[x]) for x in "abcd"] == [("r", "c"), ("open", ""), ("r", "c"), ("", "c")]
    assert r["e"] and r["f"][0]["name"] == "f" and r["g"] == "array"


def test_arrays(spark):
    nan = float("nan")
    ids, labels = F.array(*map(F.lit, (5, 6, 7))), F.array(*map(F.lit, (-100, 6, 7)))
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(s).alias("supervised")) for a, b, s in ((0, 2, False), (2, 3, True))])
    r = one(
        spark, p=arrays.common_prefix(ids, labels), m=arrays.spans_to_mask(spans), ok=arrays.spans_are_gapless(spans), s=arrays.shifted_positions(labels),
        pad=arrays.pad(ids, F.lit(5), 0), g=arrays.gather(ids, F.array(*map(F.lit, (0.1, 0.2, 0.3))), F.lit(9)),
        mm=arrays.mask_matches(F.array(F.lit(0), F.lit(1)), F.array(F.lit(nan), F.lit(-1.0))),
    )
    assert (r["p"], r["m"], r["ok"], r["s"], r["pad"], r["mm"]) == (0, [0, 0, 1], True, [0, 1], [5, 6, 7, 0, 0], True)
    assert math.isnan(r["g"])


def test_endpoints(spark):
    r = one(
        spark, a=text.redact_endpoint(F.lit("http://u:p@127.0.0.1:80/x?q=1")), b=text.redact_endpoint(F.lit("https://a.b/x")),
        c=text.redact_endpoint(F.lit("https://redacted/x")), d=text.is_commit(F.lit("a" * 40)), e=text.is_commit(F.lit("a" * 40 + "\n")),
    )
    assert tuple(r) == ("http://127.0.0.1:80/x", "https://redacted/x", "https://redacted/x", True, False)


def test_release_rows_are_all_accounted_for(spark):
    rows = [
        (("t1",), "conversation", '[{"role": "user", "content": "a", "reasoning_content": ""}]', "[]", None), (("t2",), "x", '{"role": 1}', "[]", 3),
        (("",), "x", "[]", "[]", 1), (None, "x", "[]", "[]", 1), (("t5",), "x", "nope", "[]", 1), (("t6",), "x", "[]", "[]", 1),
    ]
    df = spark.createDataFrame(rows, "task_info struct<task_id:string>, traj_type string, messages string, tools string, steps int")
    got = trajectories.parse_release(df).select("uid", "malformed_reason", "n_steps").collect()
    assert [r["malformed_reason"] for r in got] == [
        None, "messages: not a list", "task_info.task_id: empty", "task_info: not an object", "messages: not JSON", "messages: empty",
    ]
    assert got[0]["uid"] == "t1:conversation" and got[0]["n_steps"] == 0


def test_single_value_guard(spark):
    df = spark.createDataFrame([("a",), ("b",)], "h string")
    with pytest.raises(Exception, match="more than one h"):
        sweep.assert_single(df, "h").collect()
    assert sweep.assert_single(df.where("h = 'a'"), "h").count() == 1


def test_rotate_sampler_takes_the_whole_table(spark, sf):
    from trellium.plans import queries

    keys = [r["p_partkey"] for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    n = len(keys)
    places = [(k - 1, (k - 1 - 37) % n) for k in keys]
    want = sorted((idx, place // 8, r, c) for idx, place in places if place < n // 8 * 8 for r in range(2) for c in range(3))
    assert n > 100 and sorted(map(tuple, queries.rotate_sampler(spark, sf).collect())) == want


def test_pack_batches_holds_every_document(spark):
    from trellium.plans import queries

    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").agg(F.count("*"), F.sum("n_chars"), F.count(F.when(F.col("n_chars") > 40000, 1))).first()
    got = queries.pack_batches(spark, sf).collect()
    over = [r for r in got if r["tokens"] > 40000]
    assert (sum(r["rows"] for r in got), sum(r["tokens"] for r in got), len(over)) == tuple(docs)
    assert docs[2] > 0 and all(r["rows"] == 1 for r in over)
