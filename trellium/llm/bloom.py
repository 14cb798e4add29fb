"""Bloom filters as one array of longs, built and probed with SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan(count: int, bits_per_key: float) -> tuple[int, int]:
    """Bits (a multiple of 64) and hash functions for ``count`` keys."""
    bits = max(64, 64 * math.ceil(count * bits_per_key / 64))
    return bits, max(1, round(bits_per_key * math.log(2)))


def build(keys: DataFrame, key: str, bits: int, hashes: int, seed: int) -> DataFrame:
    """One row ``bits: array<bigint>`` of ``bits / 64`` words, also for no keys.

    Words are or-ed together before and after the shuffle, so what is gathered is
    ``bits / 64`` longs whatever the number of keys.
    """
    spots = F.array(*[F.pmod(F.xxhash64(F.col(key), F.lit(seed * 64 + i)), F.lit(bits)) for i in range(hashes)])
    marked = keys.select(F.explode(spots).alias("p")).select(
        F.expr("p div 64").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("x")
    )
    blank = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("x"))
    words = marked.unionByName(blank).groupBy("w").agg(F.bit_or("x").alias("x"))
    return words.agg(F.array_sort(F.collect_list(F.struct("w", "x"))).alias("a")).select(F.col("a.x").alias("bits"))


def probe(key: Column, words: Column, bits: int, hashes: int, seed: int) -> Column:
    """True where all spots of the key are set; a null key is hashed like any value."""
    test = F.lit(True)
    for i in range(hashes):
        p = F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(bits))
        word = F.get(words, F.floor(p / 64).cast("int"))
        test = test & (F.getbit(word, (p % 64).cast("int")) == 1)
    return test


def within(rows: DataFrame, key: str, words: DataFrame, bits: int, hashes: int, seed: int, held: bool = True) -> DataFrame:
    """The rows whose key passes the filter of the one row of ``build``; with ``held`` false the others.

    The words are broadcast. In the plan they would be part of its text, once a probe, and
    the driver keeps the text of every plan.
    """
    return rows.join(F.broadcast(words), probe(F.col(key), F.col("bits"), bits, hashes, seed), "left_semi" if held else "left_anti")


def literal(row: DataFrame) -> Column:
    """The words of ``build`` as a literal of the plan, for filters whose size the tables do not set; the caller has bounded their number."""
    words = row.first()["bits"]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
