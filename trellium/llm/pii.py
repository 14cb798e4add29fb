"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Method. Patterns propose candidate spans. Five labelers vote for, against or not at all on
each: format, gazetteer, words before the span, words that speak against it, and monotony
of the digits. Expectation-maximisation over the counts of vote patterns estimates each
labeler's reliability and each kind's prior, and a posterior for each pattern. A logistic
classifier of the span's kind, votes and shape is trained on these posteriors, and scores
every span. The four base kinds always stay; candidates of the other kinds are added as
spans where the score reaches ``ADD``.

Scale. One pass over the texts, no shuffle of texts and no join. What EM and the training
see is a histogram of kind x votes x shape, whose number of cells is fixed by the
code (at most 7 kinds x 3^5 votes x 18 shapes) and does not grow with the corpus; every
candidate is counted in it. The scores are column expressions.

Defined results. A null text is empty. Texts without candidates have no spans; a corpus
without any gives an untrained classifier that nothing is scored with. Repeated rows are
separate rows. Extra columns are kept, whatever their names; only ``text`` and one named
``spans`` are not.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellium.llm import rows, scratch, spans
from trellium.llm.scratch import store

KINDS = ("email", "ip", "card", "phone", "local_phone", "national_id", "iban")
BASE = KINDS[:4]
VOTES = ("format", "gazetteer", "context", "counter", "monotony")
ADD = 0.8

#: The patterns. Possessive repeats and starts at the beginning of a run (or
#: the end of the last match) find the same matches as the plain forms, in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9A-Za-z+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4} ?[A-Z0-9]{4} ?[A-Z0-9]{4}[A-Z0-9 ]{0,18}(?![0-9A-Za-z])",
}
OCTET = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Gazetteers and cue words.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6(011|5|4[4-9]))"
COUNTRIES = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
LOCAL_IP = r"^(10|127|0|192\.168|172\.(1[6-9]|2[0-9]|3[01])|169\.254)\."
FOR = r"(?i)(mail|contact|phone|tel|call|fax|mobile|card|visa|address|host|\bip\b|ssn|social|iban|account|konto|compte|cuenta)[^\n]{0,24}$"
AGAINST = r"(?i)(version|release|build|isbn|invoice|order|serial|sku|commit|checksum|section|chapter)[^\n]{0,12}$"


def _digit_count(value: Column) -> Column:
    return F.length(spans.digits(value))


def _vote(for_: Column, against: Column) -> Column:
    return F.when(for_, 1).when(against, 0).otherwise(-1)


def _labels(kind: str, value: Column, left: Column) -> dict[str, Column]:
    """The five votes on a span: 1 for, 0 against, -1 none."""
    yes, no, figures = F.lit(True), F.lit(False), spans.digits(value)
    first = figures.substr(1, 1)
    monotone = F.length(F.replace(figures, first, F.lit(""))) == 0
    gazetteer = {
        "email": _vote(F.regexp_extract(value, r"\.([A-Za-z]+)$", 1).isin(*DOMAINS), value.rlike(r"\.[0-9-]+$")),
        "ip": _vote(~value.rlike(LOCAL_IP), value.rlike(LOCAL_IP)),
        "card": _vote(figures.rlike(ISSUERS), figures.rlike("^0")),
        "phone": _vote(figures.rlike("^(" + "|".join(CODES) + ")"), first == "0"),
        "local_phone": _vote(no, first.isin("0", "1")),
        "national_id": _vote(no, figures.rlike("^(000|666|9)")),
        "iban": _vote(value.substr(1, 2).isin(*COUNTRIES), ~value.substr(1, 2).isin(*COUNTRIES)),
    }[kind]
    shaped = {
        "email": _vote(value.rlike(r"^[A-Za-z0-9][^@]*@[^@]+\.[A-Za-z]{2,24}$") & ~value.contains(".."), value.contains("..")),
        "ip": _vote(~value.rlike(r"(^|\.)0[0-9]"), value.rlike(r"(^|\.)0[0-9]")),
        "card": _vote(F.length(figures).isin(13, 14, 15, 16, 19), ~F.length(figures).isin(13, 14, 15, 16, 19)),
        "phone": _vote(F.length(figures) >= 10, no),
    }.get(kind, _vote(yes, no) if kind == "iban" else _vote(no, no))
    return {
        "format": shaped,
        "gazetteer": gazetteer,
        "context": _vote(left.rlike(FOR), no),
        "counter": _vote(no, left.rlike(AGAINST)),
        "monotony": _vote(no, monotone & (F.length(figures) > 3)) if kind != "email" else _vote(no, no),
    }


def _shape(value: Column, left: Column) -> Column:
    """0 to 17: what stands before, how long the span is, and whether it has separators."""
    before = F.when(left.rlike(r"[\s]$") | (left == ""), 0).when(left.rlike(r"[\"'(<\[:=]$"), 1).otherwise(2)
    length = F.when(F.length(value) < 13, 0).when(F.length(value) < 20, 1).otherwise(2)
    return before * 6 + length * 2 + F.when(value.rlike(r"[ ().-]"), 1).otherwise(0)


def _as(kind: str, found: Column) -> Column:
    def row(x: Column) -> Column:
        votes = _labels(kind, x["value"], x["left"])
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("ord"), x["start"].alias("start"), x["end"].alias("end"),
            *[votes[v].alias(v) for v in VOTES], _shape(x["value"], x["left"]).alias("shape"),
        )

    return F.transform(found, row)


def candidates(docs: DataFrame) -> DataFrame:
    """``row``, the columns of ``docs`` but text, with ``found``: candidate spans with votes and shape."""
    given = rows.carry(docs, ("text", "spans"), text=F.coalesce(F.col("text"), F.lit("")))
    text = F.col("text")
    keep = {
        "email": None,
        "ip": lambda v: v.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"),
        "card": lambda v: _digit_count(v).between(12, 19) & spans.luhn(v),
        "phone": lambda v: _digit_count(v).between(9, 15),
    }
    # what every match has, tested before its pattern is; most texts lack most of it
    figure = F.col("figure")
    hints = {
        "email": text.contains("@"), "ip": figure & text.rlike(r"[0-9]\.[0-9]"), "card": figure & text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+"),
        "local_phone": figure & text.rlike("[0-9]{3}"), "national_id": figure & text.rlike("[0-9]{3}-[0-9]"), "iban": figure & text.rlike("[A-Z]{2}[0-9]{2}"),
    }
    hinted = given.withColumn("figure", text.rlike("[0-9]"))
    each = hinted.withColumns({f"_{k}": spans.find(text, PATTERNS[k], keep.get(k), hints[k]) for k in KINDS})
    base = [F.col(f"_{k}") for k in BASE]
    parts = [_as(k, F.col(f"_{k}")) for k in BASE]
    for k in KINDS[len(BASE) :]:
        raw = F.col(f"_{k}")
        parts.append(_as(k, F.when(F.size(raw) > 0, spans.outside(raw, base)).otherwise(raw)))
    return each.select("row", F.concat(*parts).alias("found"))


def histogram(found: DataFrame) -> list[tuple]:
    """(kind, votes, shape, count) of all candidates; its size is bounded by the code."""
    each = found.select(F.explode("found").alias("x")).select("x.kind", *[f"x.{v}" for v in VOTES], "x.shape")
    rows = each.groupBy(*each.columns).agg(F.count("*").alias("n")).collect()
    return sorted((r["kind"], tuple(r[v] for v in VOTES), r["shape"], r["n"]) for r in rows)


def estimate(cells: Sequence[tuple], rounds: int = 60) -> tuple[dict, dict, dict]:
    """Reliabilities (P(vote 1 | true), P(vote 0 | false)), priors by kind, posteriors by (kind, votes)."""
    counts: dict[tuple, int] = {}
    for kind, votes, _, n in cells:
        counts[kind, votes] = counts.get((kind, votes), 0) + n
    kinds = sorted({k for k, _ in counts})
    trust = {v: (0.8, 0.8) for v in VOTES}
    prior = dict.fromkeys(kinds, 0.5)
    post: dict[tuple, float] = {}
    for _ in range(rounds):
        for (kind, votes), _n in counts.items():
            yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
            for v, vote in zip(VOTES, votes, strict=True):
                a, b = trust[v]
                if vote >= 0:
                    yes += math.log(a if vote else 1 - a)
                    no += math.log(1 - b if vote else b)
            post[kind, votes] = 1 / (1 + math.exp(min(60.0, max(-60.0, no - yes))))
        for kind in kinds:
            total = sum(n for (k, _), n in counts.items() if k == kind)
            prior[kind] = (1 + sum(n * post[k, s] for (k, s), n in counts.items() if k == kind)) / (total + 2)
        for j, v in enumerate(VOTES):
            hit = all_true = right = all_false = 0.0
            for (kind, votes), n in counts.items():
                if votes[j] >= 0:
                    p = post[kind, votes]
                    all_true += n * p
                    all_false += n * (1 - p)
                    hit += n * p * votes[j]
                    right += n * (1 - p) * (1 - votes[j])
            # four votes of prior belief that a labeler is right four times in five
            trust[v] = ((hit + 3.2) / (all_true + 4), (right + 3.2) / (all_false + 4))
    return trust, prior, post


def _features(kind: str, votes: Sequence[int], shape: int) -> list[str]:
    return ["bias", f"kind:{kind}", f"before:{shape // 6}", f"length:{shape % 6 // 2}", f"separated:{shape % 2}"] + [
        f"{v}:{x}" for v, x in zip(VOTES, votes, strict=True) if x >= 0
    ]


def train(cells: Sequence[tuple], rounds: int = 150, ridge: float = 0.01) -> dict[str, float]:
    """Weights by feature of a logistic regression on the posteriors of EM."""
    if not cells:
        return {}
    _, _, post = estimate(cells)
    total = sum(c[3] for c in cells)
    rows = [(_features(k, s, z), post[k, s], n / total) for k, s, z, n in cells]
    weights: dict[str, float] = dict.fromkeys({f for r in rows for f in r[0]}, 0.0)
    square = dict.fromkeys(weights, 1e-8)
    for _ in range(rounds):
        slope = {f: ridge * w / total for f, w in weights.items()}
        for names, want, share in rows:
            z = sum(weights[f] for f in names)
            gap = (1 / (1 + math.exp(-min(60.0, max(-60.0, z)))) - want) * share
            for f in names:
                slope[f] += gap
        for f, g in slope.items():
            square[f] += g * g
            weights[f] -= 0.5 * g / math.sqrt(square[f])
    return weights


def score(x: Column, weights: dict[str, float]) -> Column:
    """The classifier's probability for a span struct of ``candidates``."""
    z = F.lit(weights.get("bias", 0.0))
    value = {"kind": x["kind"], "before": F.floor(x["shape"] / 6), "length": F.floor(x["shape"] % 6 / 2), "separated": x["shape"] % 2}
    for name, w in sorted(weights.items()):
        part, _, at = name.partition(":")
        if at:
            column = value[part] if part in value else x[part]
            z = z + F.when(column == (at if part == "kind" else int(at)), w).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


@scratch.tidy
def scan(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with ``spans``: array<struct<kind, ord, start, end, score>>."""
    held = store(candidates(docs), "pii")
    weights = train(histogram(held.df))
    scored = F.transform(
        "found",
        lambda x: F.struct(x["kind"], x["ord"], x["start"], x["end"], F.round(score(x, weights), 6).alias("score")),
    )
    kept = F.filter(F.col("scored"), lambda x: x["kind"].isin(*BASE) | (x["score"] >= ADD))
    done = held.df.withColumn("scored", scored).withColumn("spans", kept)
    return done.select(*rows.restore(rows.kept(docs, ("text", "spans"))), "spans")
