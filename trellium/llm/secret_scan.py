"""Secret scans with corpus-wide ownership frequency.

Method. Detectors find candidates in every text: assignments, access keys, long hex runs,
and long mixed-case tokens. The hash of each candidate's value is aggregated over the
corpus by distinct repository and distinct owner. A value that many owners carry is a
copied example; one that looks random and belongs to a single owner is a credential that
may be live. Detections of the three base kinds always stay and get a label; a long token
is added as a span of kind ``owned`` only where ownership says that it may be live.

Scale. Texts are scanned once, without a shuffle; what is shuffled are candidate hashes.
The distinct counts are three nested aggregations that combine before each shuffle, so a
value copied into a third of the rows is a row per task. Candidates, without texts, and
their ownership are written in the shared folder, so labels go back by an equi-join of two
plain exchanges, which adaptive execution splits where a value is hot. Spans are regrouped
by row.

Defined results. A null text is empty; an empty or clean text has no span. A null
repository or owner counts as one of its own. Repeated rows are separate rows. Extra
columns are kept, whatever their names; only ``text`` and one named ``spans`` are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellium.llm import rows, scratch, spans
from trellium.llm.scratch import store

KINDS = ("assign", "access", "hex", "owned")
BASE = KINDS[:3]
#: The detectors. A hex run shorter than 24 or an access key shorter than 20
#: cannot match at a later start of the same run, so their lengths are in the patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}"
#: A run that holds any hex run or token.
RUN = r"[A-Za-z0-9+/_=-]{24}"
PLACEHOLDER = r"(?i)example|sample|dummy|change.?me|your|placeholder|xxxx|0000000|1234567|abcdefg"
LEAST_VALUE = 6
LEAST_DISTINCT = 10
EXAMPLE_OWNERS = 3


def assigned(value: Column) -> Column:
    return F.regexp_extract(value, ASSIGN, 2)


def random_looking(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DISTINCT) & ~value.rlike(PLACEHOLDER)


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]") & random_looking(value)


def _as(kind: str, found: Column, secret) -> Column:
    """Spans with kind and the hash of the secret, and whether it looks random; no text."""
    return F.transform(
        found,
        lambda x: F.struct(
            F.lit(kind).alias("kind"),
            F.lit(KINDS.index(kind)).alias("ord"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.xxhash64(secret(x["value"])).alias("hash"),
            random_looking(secret(x["value"])).alias("random"),
        ),
    )


def candidates(docs: DataFrame, **own: Column) -> DataFrame:
    """``row``, the columns of ``docs`` but text, with ``found``, its candidate spans, and the columns given."""
    given = rows.carry(docs, ("text", "spans"), text=F.coalesce(F.col("text"), F.lit("")), **own)
    text = F.col("text")
    # what every match has, tested before its pattern is; most texts lack most of it
    hinted = given.withColumn("run", text.rlike(RUN))
    each = hinted.withColumns(
        {
            "_assign": spans.find(text, ASSIGN, lambda v: F.length(assigned(v)) >= LEAST_VALUE, text.contains(":") | text.contains("=")),
            "_access": spans.find(text, ACCESS, hint=text.contains("AKIA")),
            "_hex": spans.find(text, HEX, hint=F.col("run")),
            "_token": spans.find(text, TOKEN, _mixed, F.col("run")),
        }
    )
    base = [F.col("_assign"), F.col("_access"), F.col("_hex")]
    extra = F.when(F.size("_token") > 0, spans.outside(F.col("_token"), base)).otherwise(F.col("_token"))
    same = lambda v: v
    every = F.concat(
        _as("assign", base[0], assigned), _as("access", base[1], same), _as("hex", base[2], same), _as("owned", extra, same)
    )
    return each.select("row", every.alias("found"), *own)


def ownership(found: DataFrame) -> DataFrame:
    """hash, repositories, owners: in how many distinct ones (columns ``r`` and ``o``) each candidate value occurs."""
    each = found.select(F.explode("found.hash").alias("hash"), "r", "o")
    return (
        each.groupBy("hash", "o", "r").agg(F.count("*").alias("n"))
        .groupBy("hash", "o").agg(F.count("*").alias("rs"))
        .groupBy("hash").agg(F.sum("rs").alias("repositories"), F.count("*").alias("owners"))
    )


def label(random: Column, owners: Column) -> Column:
    """``example`` (widely copied or not random), ``live`` (random, one owner), else ``shared``."""
    return (
        F.when((owners >= EXAMPLE_OWNERS) | ~random, "example").when(owners == 1, "live").otherwise("shared")
    )


@scratch.tidy
def scan(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """``docs`` without text, with ``spans``: array<struct<kind, ord, start, end, owners, repositories, label>>."""
    each_row = candidates(docs, r=F.xxhash64(repository), o=F.xxhash64(owner))
    held = store(each_row.withColumn("id", F.monotonically_increasing_id()), "secrets")
    each = held.df.where(F.size("found") > 0).select("id", F.explode("found").alias("x")).select("id", "x.*")
    # written: under a join an aggregation of its key keeps a hot key in one task
    owned = store(ownership(held.df), "ownership")
    known = each.join(owned.df, "hash").withColumn("label", label(F.col("random"), F.col("owners")))
    kept = known.where((F.col("kind") != "owned") | (F.col("label") == "live"))
    span = F.struct("kind", "ord", "start", "end", "owners", "repositories", "label")
    per_row = kept.groupBy("id").agg(F.collect_list(span).alias("spans"))
    nothing = F.expr("filter(array(named_struct('kind','','ord',0,'start',0L,'end',0L,'owners',0L,'repositories',0L,'label','')), x -> false)")
    filled = held.df.join(per_row, "id", "left").withColumn("spans", F.coalesce("spans", nothing))
    return filled.select(*rows.restore(rows.kept(docs, ("text", "spans"))), "spans")
