"""File sources and sinks: JSON arrays and lines, catalogs, run bundles, metric text, reports."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trellium.sources import json_arrays


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one top-level array of objects each, by as many tasks as they have splits."""
    return json_arrays.read(spark, path, schema)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and text of every line of text files, which are read in splits.

    The lines of a split come in order in its task, so a line's number is its place there
    and the number of lines in the splits before it in the file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text")
    )
    splits = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(starts, ["file", "_block"]).select("file", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line"), "text")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and text of each line that is no JSON, blank ones left out."""
    return numbered_lines(spark, path).where(r"text rlike '\\S'").where(F.try_parse_json("text").isNull())


def json_lines(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """One object per line, blank lines skipped; a bad line is an error that names file and line, or is kept in ``_corrupt`` with ``_file`` and ``_line``."""
    lines = numbered_lines(spark, path).where(r"text rlike '\\S'")
    bad = F.try_parse_json("text").isNull()
    if strict:
        message = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": not valid JSON"))
        return lines.select(F.from_json(F.when(bad, F.raise_error(message)).otherwise(F.col("text")), schema).alias("v")).select("v.*")
    return lines.select(F.from_json(F.when(~bad, F.col("text")), schema).alias("v"), F.when(bad, F.col("text")).alias("_corrupt"), F.col("file").alias("_file"), F.col("line").alias("_line")).select("v.*", "_corrupt", "_file", "_line")


def json_any(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON array or JSON lines, told by the first character that is not blank."""
    head = spark.read.text(path).where(r"value rlike '\\S'").limit(1).collect()
    array = bool(head) and head[0][0].lstrip().startswith("[")
    return json_array(spark, path, schema) if array else json_lines(spark, path, schema)


def catalog(spark: SparkSession, path: str, value: str, key: str = "id") -> DataFrame:
    """A JSON object of objects as rows, the object's key in ``key``."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias(key, "v")).select(key, "v.*")


def run_files(spark: SparkSession, root: str, schema: StructType | str, glob: str = "*.json") -> DataFrame:
    """All matching files below a directory, objects or lists of objects, with their path."""
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.json(root).withColumn("path", F.col("_metadata.file_path"))


def bundle(runs: DataFrame, points: DataFrame, metrics: DataFrame) -> DataFrame:
    """Runs with the point file and the metric snapshot that lie beside them."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    number = F.regexp_extract("path", r"run=(\d+)\.json$", 1).cast("int")
    keyed = runs.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*/[^/]*$", 1)).withColumn("run_number", number).drop("path")
    sides = points.withColumn("folder", folder).drop("path")
    snaps = metrics.withColumn("run_number", F.regexp_extract("path", r"run-(\d+)\.prom$", 1).cast("int")).withColumn("folder", folder).drop("path")
    return keyed.join(sides, "folder", "left").join(snaps, ["folder", "run_number"], "left")


#: A label of an exposition line; a quote or a backslash in its value is escaped by a backslash.
LABEL = r'([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'


def metric_samples(lines: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """name, labels and number of each exposition line, and columns to keep; comments, blanks and non-numbers are skipped.

    The number follows the last blank. Of a label that is repeated the last value holds.
    """
    line = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    head, number = F.regexp_extract(line, r"^(.*) ([^ ]*)$", 1), F.lower(F.regexp_extract(line, r"^(.*) ([^ ]*)$", 2))
    inside = F.regexp_extract(head, r"^[^{]*\{(.*)\}", 1)
    names, values = F.regexp_extract_all(inside, F.lit(LABEL), F.lit(1)), F.regexp_extract_all(inside, F.lit(LABEL), F.lit(2))
    pairs = F.zip_with(names, values, lambda k, v: F.struct(k.alias("key"), F.regexp_replace(v, r'\\(["\\])', "$1").alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    plain = number.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$")
    special = F.when(number.rlike(r"^[+]?inf(inity)?$"), F.lit(float("inf"))).when(number.rlike(r"^-inf(inity)?$"), F.lit(float("-inf"))).when(number.rlike("^[+-]?nan$"), F.lit(float("nan")))
    parsed = lines.where((line != "") & ~line.startswith("#")).select(
        *keep,
        F.regexp_replace(F.substring_index(head, "{", 1), r"^\s+|\s+$", "").alias("name"), F.map_from_entries(last).alias("labels"),
        F.coalesce(special, F.when(plain, number.try_cast("double"))).alias("number"),
    )
    return parsed.where("name <> '' and number is not null")


def metric_sums(samples: DataFrame) -> DataFrame:
    return samples.groupBy("name").agg(F.round(F.sum("number"), 6).alias("total"))


def snapshot_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """after - before per series name; a name that one side lacks counts as 0 there."""
    b, a = before.withColumnRenamed("total", "b"), after.withColumnRenamed("total", "a")
    return a.join(b, "name", "full_outer").select("name", (F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("delta"))


def write_records(df: DataFrame, path: str, partitions: list[str] | None = None, append: bool = False) -> None:
    """Parquet records; overwriting replaces only the partitions that ``df`` has."""
    writer = df.write.mode("append" if append else "overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def parquet_in_order(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with ``_at``, their place in the input: the file and the row's number in it."""
    read = spark.read.parquet(path)
    return read.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_at"))


def write_json_lines(df: DataFrame, path: str, order: Sequence[str] = ("_at",)) -> None:
    """JSON lines in an order, by default that of the input (``parquet_in_order``): the files one after the other hold the rows in it, however many tasks write."""
    df.orderBy(*order).drop("_at").write.mode("overwrite").json(path)


def canonical_hash(value: object) -> str:
    """SHA-256 of JSON with sorted keys and no spaces; for small documents on the driver."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def summary_document(rows: list[dict], name: str, hash_key: str = "summary_hash") -> dict:
    """A document with the hash of everything in it but the hash."""
    body = {"name": name, "rows": rows}
    return body | {hash_key: canonical_hash(body)}


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A table; floats to four places, missing values as a dash."""

    def cell(x: object) -> str:
        return "—" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)

    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"


def lineage_hash(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """One row: SHA-256 over all matching files in order of their path below the root, folder by folder: the path, a zero byte, the content's digest.

    The folder may be moved without changing it.
    """
    below = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    hashed = files.select("path", F.sha2("content", 256).alias("h"))
    if empty := empty_files(spark, root, glob):  # which the reader leaves out
        nothing = spark.range(1).select(F.explode(F.array(*map(F.lit, empty))).alias("path"), F.sha2(F.lit(b""), 256).alias("h"))
        hashed = hashed.unionByName(nothing)
    path = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*", "/")
    start = F.lit(len(re.sub("^[a-z0-9]+:/*", "/", below)) + 2)
    below_root = path.substr(start, F.length(path))
    each = hashed.select(F.struct(F.split(below_root, "/").alias("parts"), below_root.alias("p"), "h").alias("x"))
    fed = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat(F.hex(x["p"].cast("binary")), F.lit("00"), x["h"])), "")
    return each.agg(F.sha2(F.unhex(fed), 256).alias("lineage"))


def empty_files(spark: SparkSession, root: str, glob: str) -> list[str]:
    """The matching files below a directory that have no bytes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, listed = [], where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    while listed.hasNext():
        status = listed.next()
        if status.getLen() == 0 and fnmatch.fnmatchcase(status.getPath().getName(), glob):
            found.append(status.getPath().toString())
    return sorted(found)


def verified(spark: SparkSession, path: str, digest: str) -> str:
    """``path``, if the file's SHA-256 is ``digest``; an error otherwise."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()
    if found is None or found[0] != digest.lower():
        raise ValueError(f"{path} is not the file of SHA-256 {digest}")
    return path


def pinned(spark: SparkSession, paths: Sequence[str], digest: str) -> str:
    """The first of the paths that exists, verified; nothing is fetched."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return verified(spark, path, digest)
    raise FileNotFoundError(f"none of {list(paths)} is there")


def point_faults(found: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The points that are missing from a study, not expected in it, or there more than once."""
    counted = found.groupBy(*keys).agg(F.count("*").alias("n"))
    met = counted.join(expected.select(*keys).distinct().withColumn("_e", F.lit(1)), list(keys), "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return met.withColumn("problem", problem).where("problem is not null").select(*keys, "problem")
