"""Sources that many tasks read: arrays and lines cut into splits of a few bytes."""

import json
import random

import pytest

from trellium.sources import files

SCHEMA = "i int, s string, v array<int>, o struct<a:string>"


@pytest.fixture
def small_splits(spark):
    """Splits of the given size until the test ends."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def of(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], 1)

    yield of
    for n, v in before.items():
        spark.conf.set(n, v)


def items(n):
    rng = random.Random(n)
    odd = ['"', "\\", "],[", "{", "}", ",", "é", "\n", "plain", '\\"', "[1,", ""]
    return [{"i": i, "s": "".join(rng.choices(odd, k=rng.randint(0, 9))), "v": rng.choices(range(9), k=rng.randint(0, 5)), "o": {"a": rng.choice(odd)}} for i in range(n)]


def rows_of(df):
    return sorted((r["i"], r["s"], list(r["v"]), r["o"]["a"]) for r in df.collect())


@pytest.mark.parametrize("size", [60, 1 << 20])
@pytest.mark.parametrize("layout", [{}, {"indent": 1}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_an_array_in_many_splits(spark, tmp_path, small_splits, size, layout):
    want = []
    for k, n in enumerate((30, 1, 0)):
        (tmp_path / f"{k}.json").write_text(" " + json.dumps(items(n), **layout) + "\n\n", encoding="utf-8")
        want += items(n)
    small_splits(size)
    got = files.json_array(spark, str(tmp_path), SCHEMA)
    assert rows_of(got) == sorted((x["i"], x["s"], x["v"], x["o"]["a"]) for x in want)


@pytest.mark.parametrize("size", [7, 1 << 20])
@pytest.mark.parametrize(
    ("text", "fault"),
    [("", "is empty"), (" \n", "is empty"), ('{"i": 1}', "not a top-level JSON array"), ('[{"i": 1}, {"i": 2}', "truncated"), ('[{"i": 1}, {"s": "x]', "truncated"), ('[{"i": 1}, {"i"}]', "not valid JSON")],
)
def test_what_is_no_whole_array_is_an_error(spark, tmp_path, small_splits, text, fault, size):
    (tmp_path / "x.json").write_text(text)
    small_splits(size)
    with pytest.raises(Exception, match=fault):
        files.json_array(spark, str(tmp_path / "x.json"), SCHEMA).collect()


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_lines_know_their_numbers_in_any_split(spark, tmp_path, small_splits, size):
    lines = {k: [rng.choice(('{"i": 1}', "", "oops", '{"i": 2', "  ", '{"i": 33333333}')) for _ in range(40)] for k, rng in ((k, random.Random(k)) for k in "abc")}
    for k, each in lines.items():
        (tmp_path / f"{k}.jsonl").write_text("\n".join(each))
    small_splits(size)
    bad = {(r["file"][-7], r["line"], r["text"]) for r in files.bad_lines(spark, str(tmp_path)).collect()}
    assert bad == {(k, i + 1, t) for k, each in lines.items() for i, t in enumerate(each) if t in ("oops", '{"i": 2')}
    kept = files.json_lines(spark, str(tmp_path), "i int", strict=False).collect()
    assert {(r["_file"][-7], r["_line"], r["_corrupt"]) for r in kept if r["_corrupt"]} == bad
    assert sum(r["_corrupt"] is None for r in kept) == sum(t.endswith("}") for each in lines.values() for t in each)


def test_a_strict_reader_names_file_and_line(spark, tmp_path, small_splits):
    (tmp_path / "x.jsonl").write_text('{"i": 1}\n\n{"i": 2}\nbad\n')
    small_splits(6)
    with pytest.raises(Exception, match=r"x\.jsonl:4: not valid JSON"):
        files.json_lines(spark, str(tmp_path / "x.jsonl"), "i int").collect()


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_lines_are_written_in_the_order_of_the_input(spark, tmp_path, small_splits, size):
    for k in range(3):
        rows = [(k, i, f"{k}-{i * 7 % 40}") for i in range(40)]
        spark.createDataFrame(rows, "k int, i int, s string").coalesce(1).write.parquet(str(tmp_path / f"in/k={k}"))
    small_splits(size)
    read = files.parquet_in_order(spark, str(tmp_path / "in")).drop("k")
    files.write_json_lines(read.repartition(7 if size == 300 else 1, "s"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [(x["i"], x["s"]) for x in map(json.loads, text.splitlines())] == [(i, f"{k}-{i * 7 % 40}") for k in range(3) for i in range(40)]
