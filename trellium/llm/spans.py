"""Spans of regular expressions as SQL columns: where each match starts and ends.

SQL has functions for the matches of a pattern and for the pieces between them, but none
for positions. The running sum of the lengths of both gives positions in code points,
in one pass each, for texts of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
CONTEXT = 48


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def running(numbers: Column) -> Column:
    """Running sums of an array of longs, block by block: no growing copy per element."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def blocks(all_: Column) -> Column:
        last = F.greatest(F.floor((F.size(all_) - 1) / BLOCK).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))

    def offsets(parts: Column) -> Column:
        return let(F.transform(parts, total), lambda sums: F.transform(sums, lambda _, i: total(F.slice(sums, F.lit(1), i))))

    def inner(part: Column, before: Column) -> Column:
        return F.transform(part, lambda _, i: before + total(F.slice(part, F.lit(1), i + 1)))

    return let(numbers, lambda d: let(blocks(d), lambda p: F.flatten(F.zip_with(p, offsets(p), inner))))


def find(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, hint: Column | None = None) -> Column:
    """array<struct<start, end, value, left>> of the leftmost non-overlapping matches.

    ``keep`` tests the value of a match; those that fail it are dropped without a retry.
    ``left`` is the end of the text between the previous match and this one. ``hint`` is a
    cheap condition that every text with a match meets; the others are not searched.
    """

    def place(s: Column) -> Column:
        steps = F.transform(s["f"], lambda m, i: (F.length(F.get(s["g"], i)) + F.length(m)).cast("long"))
        return let(
            running(steps),
            lambda ends: F.transform(
                s["f"],
                lambda m, i: F.struct(
                    (F.get(ends, i) - F.length(m)).alias("start"),
                    F.get(ends, i).alias("end"),
                    m.alias("value"),
                    F.right(F.get(s["g"], i), F.lit(CONTEXT)).alias("left"),
                ),
            ),
        )

    pair = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f"))
    found = let(pair, place)
    if keep is not None:
        found = F.filter(found, lambda x: keep(x["value"]))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,value:string,left:string>>")
    search = text.rlike(pattern) if hint is None else hint & text.rlike(pattern)
    return F.when(search, found).otherwise(nothing)


def outside(candidates: Column, base: list[Column]) -> Column:
    """The candidates that overlap no span of the base arrays."""
    taken = F.flatten(F.array(*[F.transform(b, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for b in base]))
    return let(
        taken,
        lambda t: F.filter(
            candidates, lambda c: ~F.exists(t, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        ),
    )


def listing(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined; needs start, ord, end, kind."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["ord"], x["end"], x["kind"])))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of the value pass the Luhn test."""
    figures = F.reverse(F.split(digits(value), ""))

    def term(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, n * 2 - 9).otherwise(n * 2)

    return F.aggregate(F.transform(figures, term), F.lit(0), lambda a, x: a + x) % 10 == 0
