"""Files that hold one JSON array, read by as many tasks as they have splits.

Spark's text reader cuts a file at commas, in splits of bytes. Whether a piece lies inside a
string, and how deep, follows from all that is before it, but what a split does to that is
known from the split alone: whether its quotes are odd, and how much deeper it ends if it
began outside a string, or inside. So a first pass says this for every split, running sums
over the splits of a file give the state in which each starts, and a second pass puts the
elements together as it streams. Only what crosses a split is joined afterwards.

A task holds one element. A file that is empty, no array, or ends within one is an error;
of what follows the closing bracket only blanks are allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A comma never follows a backslash in JSON, so no escape is cut.
ESCAPED = re.compile(r"\\.", re.DOTALL)


def _depth(outside: str) -> int:
    return outside.count("[") + outside.count("{") - outside.count("]") - outside.count("}")


def _deltas(piece: str) -> tuple[int, int, int]:
    """How many quotes a piece has, and how much deeper it ends if it began outside a string, or inside."""
    parts = ESCAPED.sub("", piece).split('"')
    return len(parts) - 1, sum(map(_depth, parts[::2])), sum(map(_depth, parts[1::2]))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where the split starts) and text of every piece, in the order of the file within a task."""
    return spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text")
    )


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: what it does to the state, and its first and last character that are not blank."""

    names = [("file", pa.string()), ("block", pa.int64()), ("odd", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64()), ("head", pa.string()), ("tail", pa.string())]

    def row(split, *values):
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip((*split, *values), names, strict=True)], names=[n for n, _ in names])

    now, odd, out, inside, head, tail = None, 0, 0, 0, None, None
    for batch in batches:
        for split_file, block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (split_file, block) != now:
                if now:
                    yield row(now, odd, out, inside, head, tail)
                now, odd, out, inside, head, tail = (split_file, block), 0, 0, 0, None, None
            quotes, a, b = _deltas(text)
            out, inside = (out + b, inside + a) if odd else (out + a, inside + b)
            odd ^= quotes & 1
            if bare := text.strip():
                head, tail = head or bare[0], bare[-1]
    if now:
        yield row(now, odd, out, inside, head, tail)


def _states(summaries: DataFrame, count: int, path: str) -> DataFrame:
    """file, block, inside, depth: the state in which each split starts; a file that is no whole array is an error."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    opened = summaries.withColumn("in", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    change = F.when(F.col("in"), F.col("inside")).otherwise(F.col("outside"))
    known = opened.select(
        "file", "block", "head", "tail", F.col("in").alias("inside"), F.coalesce(F.sum(change).over(before), F.lit(0)).alias("depth"),
        F.sum(change).over(upto).alias("after"), ((F.sum("odd").over(upto) % 2) == 1).alias("open"),
    )
    last = F.max_by(F.struct("after", "open"), "block")
    files = known.groupBy("file").agg(last.alias("end"), F.min_by("head", F.when(F.col("head").isNotNull(), F.col("block"))).alias("head"), F.max_by("tail", F.when(F.col("tail").isNotNull(), F.col("block"))).alias("tail"))
    fault = (
        F.when(F.col("head").isNull(), " is empty").when(F.col("head") != "[", " is not a top-level JSON array")
        .when((F.col("end.after") != 0) | F.col("end.open") | (F.col("tail") != "]"), " is a truncated JSON array")
    )
    bad = files.withColumn("fault", fault).where("fault is not null").select("file", "fault").first()
    if bad:
        raise ValueError(bad[0] + bad[1])
    if files.count() < count:  # without a byte, without a split
        raise ValueError(f"{path}, or a file in it, is empty")
    return known.select("file", "block", "inside", "depth")


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements that a split holds whole, with their number in it; its first and last ones as parts, with whether they start there."""
    names = ["file", "block", "n", "part", "starts", "text"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    rows: list[tuple] = []
    now, n, held, starts, inside, depth, size = None, 0, [], False, False, 0, 0
    for batch in batches:
        for split_file, block, text, start_inside, start_depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (split_file, block) != now:
                if now:
                    rows.append((*now, n, True, starts, ",".join(held)))
                now, n, held, inside, depth = (split_file, block), 0, [], start_inside, start_depth
                starts = block == 0 or (not inside and depth == 1)
            elif not inside and depth == 1:
                rows.append((*now, n, n == 0, starts, ",".join(held)))
                n, held, starts = n + 1, [], True
            held.append(text)
            size += len(text)
            quotes, a, b = _deltas(text)
            depth += b if inside else a
            inside ^= bool(quotes & 1)
            if size > 1 << 22 and rows:
                yield batch_of(rows)
                rows, size = [], 0
    if now:
        rows.append((*now, n, True, starts, ",".join(held)))
    if rows:
        yield batch_of(rows)


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The elements of the arrays in the files of ``path``, which must be objects, as rows; one that is no JSON is an error."""
    pieces = _pieces(spark, path)
    summaries = pieces.mapInArrow(_summaries, "file string, block long, odd long, outside long, inside long, head string, tail string")
    states = _states(summaries, len(spark.read.text(path).inputFiles()), path)
    # a row a split
    located = pieces.join(F.broadcast(states.withColumnsRenamed({"file": "_file", "block": "_block"})), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    each = located.select("file", "block", "text", "inside", "depth").mapInArrow(_elements, "file string, block long, n long, part boolean, starts boolean, text string")
    order = Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, 0)
    across = each.where("part").withColumn("element", F.sum(F.col("starts").cast("int")).over(order))
    joined = across.groupBy("file", "element").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "text"))), lambda x: x["text"]), ",").alias("text"))
    # the brackets of the file are on its first and last elements, which are parts
    first, last = F.col("element") == 1, F.col("element") == F.max("element").over(Window.partitionBy("file"))
    bare = F.when(first, F.regexp_replace("text", r"^\s*\[", "")).otherwise(F.col("text"))
    joined = joined.select("file", F.when(last, F.regexp_replace(bare, r"\]\s*$", "")).otherwise(bare).alias("text"))
    texts = each.where("not part").select("file", "text").unionByName(joined).where(r"text rlike '\\S'")
    sound = F.when(F.try_parse_json("text").isNotNull(), F.col("text")).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(": an element is not valid JSON"))))
    return texts.select(F.from_json(sound, schema).alias("v")).select("v.*")
