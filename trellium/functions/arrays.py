"""Masks, labels and token sequences as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def bound(value: Column, body) -> Column:
    """``body`` of the value, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def common_prefix(a: Column, b: Column) -> Column:
    """How many elements from the first on are equal."""
    pairs = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(pairs, False)
    shorter = F.least(F.size(a), F.size(b))
    return F.least(F.when(at == 0, shorter).otherwise(at - 1), shorter).cast("int")


def spans_to_mask(spans: Column) -> Column:
    """The 0/1 array of gapless spans (start, end, supervised)."""
    return F.flatten(F.transform(spans, lambda s: F.array_repeat(F.when(s["supervised"], 1).otherwise(0), (s["end"] - s["start"]).cast("int"))))


def spans_are_gapless(spans: Column) -> Column:
    follows = F.forall(F.sequence(F.lit(1), F.size(spans)), lambda i: F.get(spans, i - 1)["start"] == F.coalesce(F.get(spans, i - 2)["end"], F.lit(0)))
    return (F.size(spans) == 0) | follows


def labels_of(ids: Column, mask: Column) -> Column:
    return F.zip_with(ids, mask, lambda t, m: F.when(m == 1, t).otherwise(IGNORED))


def supervised(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORED))


def shifted_positions(labels: Column) -> Column:
    """The indexes i whose next label is supervised."""
    places = F.sequence(F.lit(0), F.greatest(F.size(labels) - 2, F.lit(0)))
    return F.filter(places, lambda i: F.coalesce(F.get(labels, i + 1) != IGNORED, F.lit(False)))


def pad(values: Column, width: Column, filler: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(filler), F.greatest(width - F.size(values), F.lit(0)).cast("int")))


def gather(candidates: Column, logprobs: Column, sampled: Column) -> Column:
    """The log probability of the sampled id, NaN where it is no candidate."""
    at = F.array_position(candidates, sampled).cast("int")
    return F.coalesce(F.when(at > 0, F.get(logprobs, at - 1)), F.lit(float("nan")))


def mask_matches(mask: Column, logprobs: Column) -> Column:
    """Whether masked tokens have NaN and lengths agree."""
    return (F.size(mask) == F.size(logprobs)) & F.forall(F.arrays_zip(mask.alias("m"), logprobs.alias("p")), lambda x: (x["m"] != 0) | F.isnan(x["p"]))


def completions_differ(a: Column, b: Column, pa: Column, pb: Column) -> Column:
    """Whether ids differ, or finite log probabilities by more than 1e-5 relative and 1e-6."""
    inf = float("inf")

    def apart(x: Column, y: Column) -> Column:
        usable = ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < inf) & (F.abs(y) < inf)
        return usable & (F.abs(x - y) > F.greatest(F.lit(1e-5) * F.greatest(F.abs(x), F.abs(y)), F.lit(1e-6)))

    return (a != b) | F.exists(F.zip_with(pa, pb, apart), lambda d: F.coalesce(d, F.lit(False)))


def classify_drift(held: Column, matched: Column, response_start: Column, most: int = 1024) -> Column:
    """clean, realign or fork, by how far a re-rendered prefix departs from the held tokens."""
    drift = held - matched
    return F.when(drift == 0, "clean").when((matched >= response_start) & (drift < most), "realign").otherwise("fork")


def cut(ids: Column, budget: Column) -> Column:
    """The first ``budget`` ids of a row that was generated at a larger budget."""
    return F.slice(ids, F.lit(1), F.greatest(budget, F.lit(0)).cast("int"))


def truncated_spans(spans: Column, matched: Column) -> Column:
    """The spans (start, end, supervised) of what a drift leaves: those up to ``matched``, the last cut there."""
    kept = F.filter(spans, lambda s: s["start"] < matched)
    return F.transform(
        kept, lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], matched.cast("int")).alias("end"), s["supervised"].alias("supervised"))
    )


def reopened(held: Column, spans: Column, boundary: Column, fresh: Column, response_start: Column, most: int = 1024) -> Column:
    """struct<kind, drift, tokens, spans, boundary> after a turn's prefix was rendered anew.

    The held tokens beyond the common prefix go, with their spans; the rest of the fresh
    render follows as context. A fork into the prompt moves the boundary to where it began.
    """
    n = common_prefix(held, fresh)
    drift = F.size(held) - n
    kind = classify_drift(F.size(held), n, response_start, most)
    kept = F.when(drift > 0, truncated_spans(spans, n)).otherwise(spans)
    context = F.struct(n.cast("int").alias("start"), F.size(fresh).cast("int").alias("end"), F.lit(False).alias("supervised"))
    after = F.when(F.size(fresh) > n, F.concat(kept, F.array(context))).otherwise(kept)
    return F.struct(
        kind.alias("kind"), drift.alias("drift"), F.concat(F.slice(held, F.lit(1), n), F.slice(fresh, n + 1, F.size(fresh))).alias("tokens"),
        after.alias("spans"), F.when((drift > 0) & (n < boundary), n).otherwise(boundary).alias("boundary"),
    )


def record_fault(r: dict[str, Column], version: int, semantics: str) -> Column:
    """The first fault of a training record (ids, labels, seq_length, supervised), null if none."""
    ids, labels = r["input_ids"], r["labels"]
    fits = F.forall(F.zip_with(ids, labels, lambda t, x: (x == IGNORED) | (x == t)), lambda ok: ok)
    return (
        F.when(~r["schema_version"].eqNullSafe(F.lit(version)), "schema_version")
        .when(~r["semantics"].eqNullSafe(F.lit(semantics)), "semantics")
        .when(F.size(ids) != F.size(labels), "length")
        .when(~fits, "labels")
        .when(r["seq_length"] != F.size(ids), "seq_length")
        .when(r["supervised_tokens"] != supervised(labels), "supervised_tokens")
        .when(r["supervised_tokens"] < 1, "unsupervised")
    )
