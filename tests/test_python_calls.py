from pyspark.sql import functions as F

from trellium.functions import python_calls


def test_calls_are_parsed_and_never_run(spark):
    texts = ["a.b(1, x='y', z=[1, None])", "f()", "f(*a)", "f(**k)", "f(g())", "1 + 1", "not python(", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", python_calls.parse_python_calls(F.col("t")).alias("c"))
    got = {r["i"]: r["c"] for r in df.collect()}
    assert got[0]["name"] == "a.b" and got[0]["args"] == ["1"] and got[0]["kwargs"] == {"x": '"y"', "z": "[1, null]"}
    assert got[1]["name"] == "f" and got[1]["args"] == []
    assert all(got[i] is None or got[i]["name"] is None for i in range(2, 8))


def test_arguments_fit_without_loss(spark):
    rows = [("1.0", "integer"), ("1.5", "integer"), ('"2"', "integer"), ("true", "boolean"), ("1", "boolean"), ("[1]", "array"), ("x", "object"), ("1e3", "number"), ("abc", "string")]
    got = [tuple(r["c"]) for r in spark.createDataFrame(rows, "v string, t string").select(python_calls.coerce_argument(F.col("v"), F.col("t")).alias("c")).collect()]
    assert got == [("1", None), (None, "not integer"), ("2", None), ("true", None), (None, "not boolean"), ("[1]", None), (None, "not object"), ("1e3", None), ("abc", None)]


def test_arguments_are_read_as_python_reads_them(spark):
    rows = [
        ('" 5 "', "integer", "5"), ("True", "boolean", "true"), ("+5", "integer", "5"), ("1_000", "integer", "1000"), ("007", "integer", "7"), ("-0", "integer", "0"), ('"1.0"', "integer", None),
        (".5", "number", ".5"), ("inf", "number", "inf"), ('" 2.5 "', "number", "2.5"), ("true", "string", "True"), ("7", "string", "7"), ("[1]", "string", None), ("null", "integer", None), ("true", "integer", None),
    ]
    got = [r["c"] for r in spark.createDataFrame(rows, "v string, t string, w string").select(python_calls.coerce_argument(F.col("v"), F.col("t")).alias("c")).collect()]
    assert [g["value"] for g in got] == [w for _, _, w in rows]
    assert [g["reason"] for g in got] == [None if w else f"not {t}" for _, t, w in rows]


def test_argument_names(spark):
    m = lambda *names: F.create_map(*[F.lit(x) for n in names for x in (n, "1")])
    r = spark.range(1).select(python_calls.argument_faults(m("a", "z"), m("a", "b"), F.array(F.lit("b"))).alias("f")).first()["f"]
    assert (r["unknown"], r["missing"]) == (["z"], ["b"])
