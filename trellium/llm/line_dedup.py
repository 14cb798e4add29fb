"""Line deduplication by overlapping three-line windows.

Method. Every run of three consecutive lines is hashed. A window that stands at more than
one place of the corpus is repeated; its first place, by doc_id and then line, stays, and
all later places are covered. The covered lines of a document, merged where windows
overlap, are removed.

Scale. What is shuffled is 128 bits of hash and a place per window. First places are
minima, combined before the shuffle, so a passage that a third of the documents share is
one row per task there. They are written before the way back, which so is an equi-join of
two plain exchanges, and these adaptive execution splits where a window is hot. Texts are
shuffled once, to meet the lines to remove.

Defined results. Documents of fewer than three lines, null texts among them, have no
window. Windows of three blank lines are not repeats. Rows of equal doc_id and equal text
are one document: they get the same result and are no repeat of one another. A null
doc_id comes first. Lines end at line feeds. Windows that overlap are places like others:
of a run of four or more equal lines only the first stays. Extra columns are kept, whatever their
names; only those named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellium.llm import rows, scratch
from trellium.llm.scratch import store

WINDOW = 3
ADDED = ("n_lines", "removed", "clean")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, k, i, h, g: the line and hash of every window that is not blank."""

    def at(lines: Column, i: Column) -> Column:
        run = [F.get(lines, i + j) for j in range(WINDOW)]
        return F.struct(
            i.alias("i"), F.xxhash64(*run).alias("h"), F.xxhash64(F.lit(1), *run).alias("g"),
            F.concat(*run).rlike(r"\S").alias("solid"),
        )

    lined = docs.select("doc_id", row_key().alias("k"), _lines(F.col("text")).alias("lines")).where(F.size("lines") >= WINDOW)
    each = F.transform(F.sequence(F.lit(0), F.size("lines") - WINDOW), lambda i: at(F.col("lines"), i))
    return lined.select("doc_id", "k", F.explode(each).alias("w")).where("w.solid").select("doc_id", "k", "w.i", "w.h", "w.g")


def later_places(docs: DataFrame) -> DataFrame:
    """doc_id, k, starts: the lines at which windows start that have an earlier place."""
    found = windows(docs)
    place = F.struct("doc_id", "k", "i")
    first = (
        found.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first <> last").select("h", "g", "first")
    )
    # written: under a join an aggregation of its keys keeps a hot key in one task
    again = found.join(store(first, "first-places").df, ["h", "g"]).where(place != F.col("first"))
    return again.groupBy("doc_id", "k").agg(F.collect_set("i").alias("starts"))


@scratch.tidy
def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines``, ``removed`` (sorted line numbers) and ``clean``, the text that stays."""
    gone = later_places(docs).select(F.col("doc_id").alias("doc"), "k", "starts")
    given = rows.carry(docs, ADDED, doc_id=F.col("doc_id"), key=row_key())
    joined = given.join(gone, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("doc")), "left")
    text = F.col("row.text")
    covered = F.array_sort(
        F.array_distinct(F.flatten(F.transform("starts", lambda s: F.array(*[s + j for j in range(WINDOW)]))))
    )
    none = F.array().cast("array<int>")
    marked = joined.withColumn("removed", F.when(F.col("starts").isNull(), none).otherwise(covered)).withColumn(
        "n_lines", F.when(text.isNull(), 0).otherwise(F.size(_lines(text)))
    )
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("removed"))
    kept = F.array_join(F.transform(stay, lambda j: F.get(F.col("lines"), j)), "\n")
    return (
        marked.withColumn("lines", F.when(F.size("removed") > 0, _lines(text)))
        .withColumn("clean", F.when(F.size("removed") > 0, kept).otherwise(text))
        .select(*rows.restore(rows.kept(docs, ADDED)), *ADDED)
    )
