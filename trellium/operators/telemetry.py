"""Rollout telemetry: wall times, interval unions, queue depth, percentiles, summaries, meters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellium.operators import ordered


def episode_walls(events: DataFrame, key: str, at: str, event: str, opened: str = "open", done: str = "done", ties: Sequence[str] = ()) -> DataFrame:
    """Each done with the latest open since the done before; a later open overwrites."""
    kept = events.where(F.col(event).isin(opened, done))
    order = Window.partitionBy(key).orderBy(at, *ties)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = kept.withColumn("_n", F.row_number().over(order))
    seen = numbered.withColumn("_o", F.last(F.when(F.col(event) == opened, F.struct(F.col(at).alias("t"), F.col("_n").alias("n"))), ignorenulls=True).over(before)).withColumn(
        "_d", F.last(F.when(F.col(event) == done, F.col("_n")), ignorenulls=True).over(before)
    )
    ended = seen.where((F.col(event) == done) & F.col("_o").isNotNull() & (F.col("_d").isNull() | (F.col("_o.n") > F.col("_d"))))
    return ended.withColumn("wall_s", F.greatest(F.col(at).cast("double") - F.col("_o.t").cast("double"), F.lit(0.0))).drop("_n", "_o", "_d")


def union_duration(intervals: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Per group the time that any interval covers, their sum, number, mean and longest."""
    fixed = intervals.withColumn("_e", F.greatest(start, end))
    covered = ordered.largest_before(fixed, [start, "_e"], "_e", "_c", by).withColumn(
        "_new", F.greatest(F.col("_e") - F.greatest(F.col(start), F.coalesce("_c", F.col(start))), F.lit(0.0))
    )
    length = F.col("_e") - F.col(start)
    return covered.groupBy(*by).agg(
        F.sum("_new").alias("busy"), F.sum(length).alias("total"), F.count("*").alias("calls"), F.avg(length).alias("mean"), F.max(length).alias("longest")
    )


#: The stages of a rollout in the order of its table.
STAGES = ("generation", "tokenization", "env.create", "env.step", "env.destroy", "parse", "verifier", "scheduling")


def stage_table(samples: DataFrame, intervals: DataFrame, wall_s: float, cycles: int = 0) -> DataFrame:
    """Per stage: time (the union of its intervals, else the sum of its samples), calls, mean and longest, in fixed order.

    ``samples``: stage, seconds; ``intervals``: stage, start, end. Calls and means are of the
    samples where a stage has any. The last row is the time that no stage was busy.
    """
    spans = union_duration(intervals, ["stage"], "start", "end").select("stage", "busy", F.col("calls").alias("i_calls"), F.col("mean").alias("i_mean"), F.col("longest").alias("i_max"))
    sums = samples.groupBy("stage").agg(F.sum("seconds").alias("total"), F.count("*").alias("calls"), F.avg("seconds").alias("mean"), F.max("seconds").alias("longest"))
    rows = sums.join(spans, "stage", "full_outer").where(F.col("stage").isin(*STAGES[:-1])).select(
        "stage", F.coalesce("busy", "total").alias("total_s"), F.coalesce("calls", "i_calls").alias("calls"),
        F.coalesce("mean", "i_mean").alias("mean_s"), F.coalesce("longest", "i_max").alias("max_s"),
    )
    whole = union_duration(intervals.select(F.lit(1).alias("one"), "start", "end"), ["one"], "start", "end").agg(F.max("busy").alias("busy"))
    idle = whole.join(F.broadcast(rows.agg(F.sum("total_s").alias("sum"))), F.lit(True)).select(
        F.lit("scheduling").alias("stage"), scheduling(F.lit(float(wall_s)), F.coalesce("busy", F.least("sum", F.lit(float(wall_s))), F.lit(0.0))).alias("total_s"),
        F.lit(cycles).cast("long").alias("calls"), F.lit(0.0).alias("mean_s"), F.lit(0.0).alias("max_s"),
    )
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    return rows.unionByName(idle).select(
        place.cast("int").alias("place"), "stage", F.round("total_s", 4).alias("total_s"), "calls", F.round("mean_s", 6).alias("mean_s"), F.round("max_s", 4).alias("max_s")
    )


def scheduling(wall: Column, busy: Column) -> Column:
    return F.greatest(wall - busy, F.lit(0.0))


def queue_depth(intervals: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """How many intervals are open after each change, ends before starts at equal times."""
    ups = intervals.select(*by, F.col(start).alias("at"), F.lit(1).alias("delta"))
    sweep = ups.unionByName(intervals.select(*by, F.col(end).alias("at"), F.lit(-1).alias("delta")))
    steps = sweep.groupBy(*by, "at", "delta").agg(F.sum("delta").alias("change"))
    return ordered.running(steps, ["at", "delta"], F.col("change"), "depth", by)


def depth_summary(depth: DataFrame, by: Sequence[str], last: int = 16) -> DataFrame:
    """Mean, peak and the last depths, oldest first, of each group's series (at, delta, depth)."""
    newest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("at"), F.desc("delta")))
    tail = depth.withColumn("_n", newest).where(F.col("_n") <= last).groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "delta", "depth"))), lambda x: x["depth"]).alias("last")
    )
    return depth.groupBy(*by).agg(F.round(F.avg("depth"), 6).alias("mean"), F.max("depth").alias("peak")).join(tail, list(by))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, q: float = 0.95) -> DataFrame:
    """The ceil(q * n)-th smallest value, exact."""
    return ordered.ranked_value(df, by, value, q, F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1)))


def rounded_index(df: DataFrame, by: Sequence[str], value: str, p: float) -> DataFrame:
    """The value at index round(p / 100 * (n - 1)), rounded half to even, exact."""
    return ordered.ranked_value(df, by, value, p / 100, F.bround(F.lit(p / 100) * (F.col("n") - 1)) + 1)


def episode_summary(episodes: DataFrame, wall_s: float) -> DataFrame:
    """One row: rates per time (0 for no time), mean reward over non-null, sums, terminal histogram."""
    ends = episodes.groupBy(F.coalesce("terminal_reason", F.lit("none")).alias("k")).agg(F.count("*").alias("n"))
    histogram = ends.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("terminals"))
    rate = lambda x, s: F.round(x * s / wall_s, 4) if wall_s > 0 else F.lit(0.0)
    row = episodes.agg(
        F.count("*").alias("episodes"), rate(F.count("*"), 3600).alias("episodes_per_hour"), rate(F.sum("tokens"), 1).alias("tokens_per_s"),
        F.round(F.avg("reward"), 6).alias("mean_reward"), F.round(F.avg("steps"), 6).alias("mean_steps"), F.sum("invalid_calls").alias("invalid_calls"),
    )
    return row.join(F.broadcast(histogram))


def drift_tally(df: DataFrame, counters: Sequence[str], peak: str) -> DataFrame:
    return df.agg(*[F.sum(c).alias(c) for c in counters], F.max(peak).alias(peak))


def utilization(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.coalesce(F.round(F.avg(value), 6), F.lit(0.0)).alias("mean"), F.coalesce(F.max(value), F.lit(0.0)).alias("peak"))


def throughput_meter(steps: DataFrame, order: str, tokens: str, seconds: str) -> DataFrame:
    """Tokens per second, seconds per million tokens, and running tokens."""
    return ordered.running(steps, [order], F.col(tokens), "running_tokens").withColumns({
        "tokens_per_s": F.round(F.try_divide(tokens, seconds), 4), "s_per_mtok": F.round(F.try_divide(F.col(seconds) * 1e6, F.col(tokens)), 4),
    })


def eta_slope(samples: DataFrame, by: Sequence[str], step: str, at: str) -> DataFrame:
    """Seconds per step over the last five samples."""
    w = Window.partitionBy(*by).orderBy(step).rowsBetween(-4, 0)
    return samples.withColumn("s_per_step", F.round(F.try_divide(F.col(at) - F.first(at).over(w), F.col(step) - F.first(step).over(w)), 6))


def sampled_table(rows: DataFrame, order: Sequence[str], heavy: Sequence[str], limit: int, by: Sequence[str] = ()) -> DataFrame:
    """All rows; beyond the first ``limit`` the heavy columns are blank."""
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) <= limit
    marked = rows.withColumn("sampled", inside)
    return marked.withColumns({c: F.when(F.col("sampled"), F.col(c)).otherwise("") for c in heavy})


def long_metrics(df: DataFrame, ids: Sequence[str], prefix: str) -> DataFrame:
    """A wide row of numbers as (name, value)."""
    numbers = [c for c in df.columns if c not in ids]
    doubles = df.select(*ids, *[F.col(c).cast("double").alias(f"{prefix}/{c}") for c in numbers])
    return doubles.unpivot(list(ids), [f"`{prefix}/{c}`" for c in numbers], "name", "value")


def last_by(df: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))
