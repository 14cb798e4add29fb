"""URL filters: path rules, then exact block-list membership from a Bloom filter cascade.

Method. The keys of a url are its host and the host's parent domains. The corpus's
complete key universe is known, so membership in the list can be made exact without a
join per url: level 1 is a Bloom filter of the listed keys; level 2 encodes the keys of
the universe that level 1 lets through wrongly; level 3 the listed keys that level 2
lets through; and so on until a level lets no key through wrongly. A key's membership is
the parity of the first level that refuses it.

Scale. The universe is a distinct over keys, combined before the shuffle (a hot host is
one row per task). Each level is one pass over the undecided side of the key table, not
over urls. The first level's bits a key grow with the logarithm of the universe's share,
so that the levels together stay near their least size. They reach the tasks as array
literals of the plan, ``MAX_BITS`` (4 MB) at most at a time: for a longer list the keys
are dealt by hash into segments, each with a cascade of its own, and the urls are passed
over once a segment, each pass writing its verdicts in the shared folder. There is no
join at any size.

Defined results. A null url, or one without ``://``, has empty host and path, no rule and
no listed key, and is allowed. Empty tables give empty results. Repeated rows are rows of
their own. Extra columns are kept, whatever their names; only those named like the added
ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellium.llm import bloom, rows, scratch
from trellium.llm.scratch import Stored, store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 8.0
#: Bits a key of the first level at most, and bits of all levels that a plan holds.
MOST_PER_KEY = 16.0
MAX_BITS = 1 << 25
MAX_LEVELS = 40
ADDED = ("host", "path", "rule", "verdict", "listed")

#: Verdict, host, path of the rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Block-listed domains; a listed domain stands for its subdomains too.
LISTED = (
    "cheap-pills.example.com",
    "free-casino.example.net",
    "spam-farm.example.org",
    "spam-farm.example.net",
    "tiontion.example.com",
    "ththnd.example.net",
    "blog.ththst.example.net",
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_keys(host: Column) -> Column:
    """The host and its parent domains; none for an empty host."""
    parts = F.split(host, r"\.")
    count = F.size(parts)
    keys = F.transform(
        F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(parts, i, count - i + F.lit(1)), ".")
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


def apply_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """A struct (verdict, rule) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(found)
    return found


@dataclass
class Cascade:
    """The levels as (bits, hashes, seed, words), with no level for an empty list."""

    levels: list[tuple[int, int, int, Column]]

    def contains(self, key: Column) -> Column:
        inside = F.lit(len(self.levels) % 2 == 1)
        for at in range(len(self.levels) - 1, -1, -1):
            bits, hashes, seed, words = self.levels[at]
            passed = bloom.probe(key, words, bits, hashes, seed)
            inside = F.when(~passed, F.lit(at % 2 == 1)).otherwise(inside)
        return inside


def key_table(universe: DataFrame, listed: DataFrame) -> Stored:
    """key, listed: every key of the universe once, and whether it is listed.

    Null keys count not at all. Listed keys outside the universe are left out: no url of
    the corpus can have them.
    """
    sides = universe.select("key", F.lit(0).alias("l"), F.lit(1).alias("u")).unionByName(
        listed.select("key", F.lit(1).alias("l"), F.lit(0).alias("u"))
    )
    merged = sides.where("key is not null").groupBy("key").agg(F.max("l").alias("l"), F.max("u").alias("u"))
    return store(merged.where("u = 1").select("key", (F.col("l") == 1).alias("listed")), "url-keys")


def _counts(keys: DataFrame) -> dict[bool, int]:
    return {bool(r["listed"]): r["n"] for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}


def first_bits(listed: int, others: int) -> float:
    """Bits a key of the first level for which it and the level of its false positives are smallest together."""
    rate = math.log(2) ** 2
    best = math.log(max(1.0, BITS_PER_KEY * rate * others / max(1, listed))) / rate
    return min(MOST_PER_KEY, max(BITS_PER_KEY / 2, best))


def build_cascade(keys: DataFrame, most: int | None = None) -> Cascade | None:
    """The cascade over ``key_table`` rows; None if its levels need more than ``most`` bits."""
    count = _counts(keys)
    made, total, side = Cascade([]), 0, True
    encode = {True: keys.where("listed"), False: keys.where("not listed")}
    while count.get(side, 0):
        at = len(made.levels)
        if at == MAX_LEVELS:
            raise RuntimeError("the cascade did not close; keys collide in 64 bits")
        bits, hashes = bloom.plan(count[side], first_bits(count[side], count.get(not side, 0)) if at == 0 else BITS_PER_KEY)
        total += bits
        if most is not None and total > most:
            return None
        words = bloom.literal(bloom.build(encode[side], "key", bits, hashes, at))
        made.levels.append((bits, hashes, at, words))
        other = encode[not side].where(bloom.probe(F.col("key"), words, bits, hashes, at))
        encode[not side] = other
        count[not side] = other.count()
        side = not side
    return made


def _segment(key: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(segments))


def cascades(keys: DataFrame, most: int) -> list[Cascade]:
    """One cascade for each segment of the keys, none beyond ``most`` bits unless it has one listed key."""
    count = _counts(keys)
    listed, others = count.get(True, 0), count.get(False, 0)
    per = first_bits(listed, others)
    guess = listed * per + BITS_PER_KEY * others * 0.5 ** (per * math.log(2))
    segments = max(1, math.ceil(1.2 * guess / most))
    while True:
        made = []
        for s in range(segments):
            mine = keys if segments == 1 else keys.where(_segment(F.col("key"), segments) == s)
            cascade = build_cascade(mine, None if segments > max(1, listed) else most)
            if cascade is None:
                break
            made.append(cascade)
        if len(made) == segments:
            return made
        segments *= 2


@scratch.tidy
def _flagged(parsed: DataFrame, listed: DataFrame, most: int) -> DataFrame:
    """``parsed`` (row, host, path) with a boolean ``listed``: whether a key of the host is listed."""
    universe = parsed.groupBy("host").agg(F.count("*").alias("n")).select(F.explode(host_keys(F.col("host"))).alias("key")).distinct()
    keys = key_table(universe, listed)
    parts = cascades(keys.df, most)
    keys.drop()
    flagged, before = parsed.withColumn("listed", F.lit(False)), None
    for s, cascade in enumerate(parts):
        inside = lambda k: cascade.contains(k) if len(parts) == 1 else (_segment(k, len(parts)) == s) & cascade.contains(k)  # noqa: B023, E731
        flagged = flagged.withColumn("listed", F.col("listed") | F.exists(host_keys(F.col("host")), inside))
        if s + 1 < len(parts):
            now = store(flagged, "urls")
            if before is not None:
                before.drop()
            flagged, before = now.df, now
    return flagged


def judge(
    pages: DataFrame,
    listed: DataFrame | None = None,
    rules: Sequence[tuple[str, str, str]] = RULES,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``pages`` (with ``url``) with host, path, rule, verdict and listed.

    The verdict is that of the longest rule that fits, else ``block`` for a listed host
    and ``allow`` for any other.
    """
    spark = pages.sparkSession
    if listed is None:
        listed = spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED))).alias("key"))
    parsed = rows.carry(pages, ADDED, host=host_of(F.col("url")), path=path_of(F.col("url")))
    judged = _flagged(parsed, listed, max_bits).withColumn("best", apply_rules(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("best.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select(*rows.restore(rows.kept(pages, ADDED)), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "listed")
