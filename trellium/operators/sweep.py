"""Serving sweeps: points from runs, eligibility, skylines, profiles, limits and matched pairs."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellium.operators import ordered

KEYS = ("precision", "tokens", "seqs", "concurrency")


def points(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str], expected: int | None = None) -> DataFrame:
    """Per point: median, min and max of each metric, run counts, and the first reason that makes it invalid.

    Needs repetition, failed and preemptions. Exact medians average the middle two.
    """
    ends = [f(m).alias(f"{name}_{m}") for m in metrics for name, f in (("min", F.min), ("max", F.max))]
    counts = [
        F.count("*").alias("n_runs"), F.count_distinct("repetition").alias("n_repetitions"), F.max("failed").alias("max_failed"), F.max("preemptions").alias("max_preemptions"),
    ]
    largest = runs.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) <= ordered.SMALL:
        counted = runs.groupBy(*keys).agg(*counts, *[F.median(m).alias(f"med_{m}") for m in metrics], *ends)
    else:
        # a median keeps the distinct values of its group; of a large group only the two in the middle are looked for
        parts = [runs.groupBy(*keys).agg(*counts, *ends)]
        for m in metrics:
            both = [ordered.ranked_value(runs, keys, m, 0.5, F.floor((F.col("n") + k) / 2)) for k in (1, 2)]
            parts.append(both[0].unionByName(both[1]).groupBy(*keys).agg(F.avg("p").alias(f"med_{m}")))
        whole = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
        counted = whole.groupBy(*keys).agg(*[F.max(c).alias(c) for c in whole.columns if c not in keys])
    reason = (
        F.when((F.col("n_runs") != expected) if expected else F.lit(False), "run_count")
        .when(F.col("n_repetitions") != F.col("n_runs"), "duplicate_repetition")
        .when(F.col("max_failed") > 0, "failed_requests")
        .when(F.col("max_preemptions") > 0, "preemptions")
    )
    return counted.withColumn("reason", reason).withColumn("valid", reason.isNull())


def assert_single(df: DataFrame, column: str) -> DataFrame:
    """``df``, which fails when read if the column has more than one value."""
    one = df.agg(F.count_distinct(column).alias("_n"))
    checked = one.select(F.assert_true(F.col("_n") <= 1, F.lit(f"more than one {column}")).alias("_ok"))
    return df.join(F.broadcast(checked), F.col("_ok").isNull()).drop("_ok")


def eligible(points_: DataFrame, ttft: float | None = None, tpot: float | None = None) -> DataFrame:
    """Valid points within the objective; equality passes."""
    out = points_.where("valid")
    return out if ttft is None else out.where((F.col("ttft") <= ttft) & (F.col("tpot") <= tpot))


def pareto(df: DataFrame, gain: str, cost: str, group: Sequence[str] = ()) -> DataFrame:
    """The rows that no other row of the group dominates; equal rows all stay, rows without gain or cost do not.

    A row stays if no row with more gain has as little cost, and no row of its gain has
    less cost. Groups of up to ``ordered.SMALL`` rows, which one count tells, are sorted by
    windows. Else the least cost of each gain is combined before the shuffle, those that are
    below a running minimum along the gains, in ranges, are the frontier, and the rows on it
    are those that meet it.
    """
    sound = df.where(F.col(gain).isNotNull() & F.col(cost).isNotNull())
    largest = sound.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) <= ordered.SMALL:
        ahead = Window.partitionBy(*group).orderBy(F.desc(gain)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        marked = sound.withColumns({"_least": F.min(cost).over(ahead), "_most": F.max(gain).over(Window.partitionBy(*group, cost))})
        return marked.where((F.col(cost) == F.col("_least")) & (F.col(gain) == F.col("_most"))).drop("_least", "_most")
    least = sound.groupBy(*group, gain).agg(F.min(cost).alias("_least"))
    turned = least.withColumns({"_down": -F.col(gain), "_cheap": -F.col("_least")})
    front = ordered.largest_before(turned, ["_down"], "_cheap", "_ahead", group).where("_ahead is null or _cheap > _ahead")
    keys = [*group, gain]
    met = front.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(keys)], "_least")
    same = F.col(cost) == F.col("_least")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_on{i}"))
    return df.join(met, same, "left_semi")


def pareto_by_antijoin(df: DataFrame, gain: str, cost: str, group: Sequence[str] = ()) -> DataFrame:
    """The same skyline by its definition, for small inputs and tests."""
    a, b = df.alias("a"), df.alias("b")
    same = F.lit(True)
    for g in group:
        same = same & (F.col(f"a.{g}") == F.col(f"b.{g}"))
    dominated = (
        same & (F.col(f"b.{gain}") >= F.col(f"a.{gain}")) & (F.col(f"b.{cost}") <= F.col(f"a.{cost}"))
        & ((F.col(f"b.{gain}") > F.col(f"a.{gain}")) | (F.col(f"b.{cost}") < F.col(f"a.{cost}")))
    )
    return a.join(b, dominated, "left_anti")


def top(df: DataFrame, order: Sequence[Column], profile: str) -> DataFrame:
    return df.orderBy(*order).limit(1).withColumn("profile", F.lit(profile))


def profiles(df: DataFrame, throughput: str = "throughput", requests: str = "requests", ttft: str = "ttft", tpot: str = "tpot", ties: Sequence[str] = ()) -> DataFrame:
    """The latency, balanced and throughput points; ``ties`` makes the order total."""
    last = [F.col(t) for t in ties]
    t, lo, hi = F.col(throughput), F.col(ttft), F.col(tpot)

    # three pairs of numbers, looked up once
    ends = df.agg(*[f(c).alias(f"{name}_{c}") for c in {throughput, ttft, tpot} for name, f in (("low", F.min), ("high", F.max))])

    def scaled(c: str) -> Column:
        low, high = ends.select(f"low_{c}").scalar(), ends.select(f"high_{c}").scalar()
        return F.when(high == low, F.lit(0.0)).otherwise((F.col(c) - low) / (high - low))

    far = df.withColumn("_d", F.sqrt((1 - scaled(throughput)) * (1 - scaled(throughput)) + scaled(ttft) * scaled(ttft) + scaled(tpot) * scaled(tpot)))
    return (
        top(df, [lo, hi, t.desc(), *last], "latency")
        .unionByName(top(far, [F.col("_d"), lo, t.desc(), *last], "balanced").drop("_d"))
        .unionByName(top(df, [t.desc(), F.col(requests).desc(), lo, *last], "throughput"))
    )


def admission_limits(seqs: Column, fraction: float, p95_tokens: Column, prefill: Column | None = None, ttft_ms: Column | None = None) -> Column:
    """struct<requests, queued_tokens>: what to admit beyond the running sequences (half-even rounding)."""
    slots = F.greatest(F.lit(1), F.bround(seqs * F.lit(fraction)).cast("long"))
    tokens = p95_tokens * slots
    if prefill is not None and ttft_ms is not None:
        tokens = F.greatest((prefill * ttft_ms / 1000).cast("long"), p95_tokens)
    return F.struct((seqs + slots).cast("long").alias("requests"), tokens.cast("long").alias("queued_tokens"))


def matched_uplift(df: DataFrame, keys: Sequence[str], side: str, base: str, new: str, metric: str) -> DataFrame:
    """Per key with both sides: 100 * (new / base - 1), by one conditional aggregation."""
    both = df.where(F.col(side).isin(base, new)).groupBy(*keys).agg(
        F.max(F.when(F.col(side) == base, F.col(metric))).alias("base"), F.max(F.when(F.col(side) == new, F.col(metric))).alias("new")
    )
    return both.where("base is not null and new is not null").withColumn("uplift", F.round(100 * (F.col("new") / F.col("base") - 1), 2))


def uplift_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count("*").alias("n"), F.round(F.min("uplift"), 2).alias("low"), F.round(F.median("uplift"), 2).alias("mid"), F.round(F.max("uplift"), 2).alias("high")
    )
