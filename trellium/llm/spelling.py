"""Grouping of spelling variants: words one edit apart, and the form that each stands for.

Method. The letters of a word set bits by the parity of their counts; one inserted or
deleted letter flips one bit, a replaced one two. The mask is split into three bands, so
two words that are one edit apart agree in a band. Words are joined on equal bands where
their lengths differ by one at most and their masks by two bits at most, and verified
with an edit distance. An edit also leaves the first or the second half of the shorter
word's length as it is, so the half is part of the join key beside the band: without it
a band's groups grow to thousands of words. A word's form is its most frequent near word
if that is much more frequent; forms are followed to the last by pointer doubling.

Scale. Texts are read once; counts are combined before the shuffle, so a word that a
third of all texts hold is a row per task there. The vocabulary is written once. Its join
is an equi-join of two plain exchanges, whose hot keys adaptive execution splits, and
gives verified pairs only, each once: a pair that agrees in several bands or both halves
counts in the first. Joins of the vocabulary are merges by hint: Spark's estimate of a side does not count
the rows that ``explode`` makes of a word, and would broadcast millions of them through the driver. Each form is at least ``RATIO`` times as frequent as its word, so
the number of doublings is bounded by the logarithm of the largest count's logarithm.

Defined results. A null text has no words; a null doc_id is an empty one. Repeated rows
count as rows of their own. Words compare by code points. Without words, no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellium.llm import scratch
from trellium.llm.scratch import store

#: The code points of words, as two ranges after A-Z were lower-cased.
FIRST, ACCENTED, LETTERS = 0x61, 0xC0, 26
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
BANDS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, run: the lower-cased maximal runs of letters of every text, of ``least`` letters and more."""
    # a run that is long enough cannot match at a later start, so the length is in the pattern
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(rf"[A-Za-z\u00C0-\u00FF]{{{least},}}"), 0)
    return docs.select("doc_id", F.explode(found).alias("run"))


def vocabulary(words: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of column ``word`` that are long and frequent enough."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _letter(c: Column) -> Column:
    code = F.ascii(c)
    return F.when(code < ACCENTED, code - FIRST).otherwise(code - ACCENTED + LETTERS)


def masks(word: Column) -> list[Column]:
    """The parity bits of letters, dealt to bands by turns."""
    letters = F.transform(F.split(word, ""), _letter)

    def band(b: int) -> Column:
        flip = lambda m, i: F.when(i % BANDS == b, m.bitwiseXOR(F.call_function("shiftleft", F.lit(1), (i / BANDS).cast("int")))).otherwise(m)
        return F.aggregate(letters, F.lit(0), flip)

    return [band(b) for b in range(BANDS)]


def _keyed(vocab: DataFrame, longer: bool) -> DataFrame:
    """A row per word, half and band, keyed for partners of length ``base`` as the shorter, or equal, word; with ``longer`` as the other."""
    size = F.col("size")
    bases = [size, size - 1] if longer else [size]
    keys = []
    for base in bases:
        front = F.floor(base / 2).cast("int")
        for half in (0, 1):
            piece = F.substring("word", F.lit(1), front) if half == 0 else F.substring("word", size - (base - front) + 1, size)
            for b in range(BANDS):
                key = F.xxhash64(base, F.lit(half), piece, F.lit(b), F.col(f"m{b}"))
                keys.append(F.struct(base.alias("base"), F.lit(half).alias("half"), F.lit(b).alias("band"), key.alias("key")))
    return vocab.select("word", "n", "size", *[f"m{b}" for b in range(BANDS)], F.explode(F.array(*keys)).alias("k")).select("*", "k.*").drop("k")


def near_pairs(vocab: DataFrame) -> DataFrame:
    """word, other, m: every two words (columns word, n) one edit apart, both ways round, with the count of the other."""
    masked = vocab.withColumn("size", F.length("word")).withColumns({f"m{b}": m for b, m in enumerate(masks(F.col("word")))})
    a, b = _keyed(masked, False).alias("a"), _keyed(masked, True).alias("b")
    differ = sum((F.bit_count(F.col(f"a.m{i}").bitwiseXOR(F.col(f"b.m{i}"))) for i in range(1, BANDS)), F.bit_count(F.col("a.m0").bitwiseXOR(F.col("b.m0"))))
    front = F.floor(F.col("a.base") / 2).cast("int")
    new_half = (F.col("a.half") == 0) | (F.substring("a.word", F.lit(1), front) != F.substring("b.word", F.lit(1), front))
    new_band = F.lit(True)
    for band in range(1, BANDS):
        for earlier in range(band):
            new_band = new_band & ((F.col("a.band") != band) | (F.col(f"a.m{earlier}") != F.col(f"b.m{earlier}")))
    pairs = a.hint("merge").join(
        b.hint("merge"),
        (F.col("a.key") == F.col("b.key")) & (F.col("a.base") == F.col("b.base")) & (F.col("a.half") == F.col("b.half")) & (F.col("a.band") == F.col("b.band"))
        & ((F.col("b.size") > F.col("a.size")) | (F.col("a.word") < F.col("b.word")))
        & (differ <= 2) & new_band & new_half & (F.levenshtein("a.word", "b.word", 1) == 1),
    )
    ways = F.array(*[F.struct(F.col(f"{x}.word").alias("word"), F.col(f"{y}.word").alias("other"), F.col(f"{y}.n").alias("m")) for x, y in ("ab", "ba")])
    return pairs.select(F.inline(ways))


def _roots(links: DataFrame, largest: int, ratio: int, least: int) -> DataFrame:
    """word, root of words with a form (columns word, root): the last form of each."""
    steps = max(1, int(math.log(max(largest, least) / least, ratio)) + 1)
    held = store(links, "forms")
    for _ in range((steps - 1).bit_length()):
        further = held.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        later = store(held.df.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")
        held.drop()
        held = later
    return held.df


@scratch.tidy
def group(vocab: DataFrame, ratio: int = RATIO, least: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``vocab`` (word, n >= least)."""
    words = store(vocab, "words")
    best = F.min(F.struct((-F.col("m")).alias("m"), "other"))
    near = near_pairs(words.df).groupBy(F.col("word").alias("to")).agg(F.count("*").alias("near"), best.alias("best"))
    with_form = -F.col("best.m") >= ratio * F.col("n")
    formed = store(
        words.df.join(near.hint("merge"), F.col("word") == F.col("to"), "left").select(
            "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
            F.when(with_form, F.col("best.other")).alias("form"), F.when(with_form, -F.col("best.m")).alias("form_n"),
        ),
        "spellings",
    )
    words.drop()
    largest = formed.df.agg(F.max("n")).first()[0] or least
    last = _roots(formed.df.where("form is not null").select("word", F.col("form").alias("root")), largest, ratio, least)
    known = formed.df.join(last.withColumnRenamed("word", "of").hint("merge"), F.col("word") == F.col("of"), "left")
    return known.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
