"""Evaluation: category metrics with honest denominators, rates, rewards, grading, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellium.operators import ordered


def category_metrics(tasks: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """Means, and the invalid-call rate as a ratio of sums; exact success over what reports it."""
    return tasks.groupBy(*by).agg(
        F.count("*").alias("n_tasks"), F.round(F.avg("score"), 6).alias("score"),
        F.round(F.sum("invalid_calls") / F.greatest(F.sum("steps"), F.lit(1)), 6).alias("invalid_call_rate"),
        F.round(F.avg("steps"), 6).alias("avg_steps"), F.round(F.avg("generated_tokens"), 6).alias("avg_tokens"),
        F.round(F.avg(F.col("truncated").cast("int")), 6).alias("truncation_rate"),
        F.round(F.avg(F.col("exact_success").cast("int")), 6).alias("exact_success_rate"),
    )


def overall(tasks: DataFrame, name: str = "overall") -> DataFrame:
    """Category metrics with a row over all tasks, in one pass over the tasks."""
    each = F.array(F.struct(F.col("category").alias("c")), F.struct(F.lit(name).alias("c")))
    return category_metrics(tasks.withColumn("_c", F.explode(each)).drop("category").withColumn("category", F.col("_c.c")))


def terminal_rates(tasks: DataFrame) -> DataFrame:
    """Share of each terminal reason among the tasks of a category that report one, with that denominator."""
    counted = tasks.where("terminal_reason is not null").groupBy("category", "terminal_reason").agg(F.count("*").alias("n"))
    of = F.sum("n").over(Window.partitionBy("category"))
    return counted.withColumn("denominator", of).withColumn("rate", F.round(F.col("n") / of, 6))


def sparse_means(tasks: DataFrame, column: str = "diagnostics") -> DataFrame:
    """Mean of each map key over the rows that carry it, with their number."""
    each = tasks.select("category", F.explode(column).alias("key", "value"))
    return each.groupBy("category", "key").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("denominator"))


def group_variance(rewards: DataFrame, group: str = "group_index", value: str = "reward") -> DataFrame:
    """Mean population variance per group, the share of groups without any, and the useful rest."""
    per = rewards.groupBy(group).agg(F.var_pop(value).alias("v"))
    zero = F.avg((F.abs("v") <= 1e-12).cast("int"))
    return per.agg(
        F.count("*").alias("groups"), F.coalesce(F.round(F.avg("v"), 4), F.lit(0.0)).alias("mean_variance"),
        F.coalesce(F.round(zero, 6), F.lit(0.0)).alias("zero_fraction"), F.coalesce(F.round(1 - zero, 6), F.lit(0.0)).alias("useful_fraction"),
    )


def checklist_reward(checks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Passed checks over all, broken ones included, to four places; name errors counted."""
    return checks.groupBy(*by).agg(
        F.count("*").alias("checks"), F.round(F.count_if(F.col("passed")) / F.count("*"), 4).alias("reward"),
        F.count_if(F.col("error_type") == "NameError").alias("name_errors"),
    )


def reward_contract(rewards: DataFrame, value: str = "reward") -> DataFrame:
    """The rows, failing on a reward that is null, not finite or outside 0 to 1."""
    x = F.col(value)
    return rewards.withColumn(value, F.when(x.isNotNull() & ~F.isnan(x) & x.between(0, 1), x).otherwise(F.raise_error(F.lit("reward outside 0 to 1"))))


def bag_contained(expected: DataFrame, actual: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Per key: whether every expected value occurs among the actual ones as often."""
    e = expected.groupBy(*key, value).agg(F.count("*").alias("want"))
    a = actual.groupBy(*key, value).agg(F.count("*").alias("have"))
    return e.join(a, [*key, value], "left").groupBy(*key).agg(F.bool_and(F.coalesce("have", F.lit(0)) >= F.col("want")).alias("contained"))


def running_mean(df: DataFrame, order: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the mean of the values up to each row, by key."""
    summed = ordered.running(df, order, F.col(value), "_sum", by)
    counted = ordered.running(summed, order, F.when(F.col(value).isNotNull(), 1).otherwise(0).cast("long"), "_count", by)
    return counted.withColumn("running_mean", F.round(F.try_divide("_sum", "_count"), 9)).drop("_sum", "_count")


def comparable(a: DataFrame, b: DataFrame) -> DataFrame:
    """The keys (key, value) on which two manifests differ, a missing key counting as null."""
    return (
        a.withColumnRenamed("value", "left").join(b.withColumnRenamed("value", "right"), "key", "full_outer")
        .where(~F.col("left").eqNullSafe(F.col("right")))
    )


def expect_set(found: DataFrame, expected: DataFrame, key: Sequence[str]) -> DataFrame:
    """What is missing from, or unexpected in, ``found``."""
    missing = expected.select(*key).exceptAll(found.select(*key)).withColumn("problem", F.lit("missing"))
    return missing.unionByName(found.select(*key).exceptAll(expected.select(*key)).withColumn("problem", F.lit("unexpected")))


def equivalence(a: DataFrame, b: DataFrame, key: str, reward: str, tolerance: float = 1e-9, lists: Sequence[str] = ()) -> DataFrame:
    """Rows of two runs that do not agree: absent on a side, with another reward (null on one side only among them), or another list.

    A row that differs in several ways is there several times.
    """
    x = a.select(key, F.col(reward).alias("left"), F.struct(F.lit(1).alias("one"), *lists).alias("_l"))
    y = b.select(key, F.col(reward).alias("right"), F.struct(F.lit(1).alias("one"), *lists).alias("_r"))
    joined = x.join(y, key, "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    far = (F.col("left").isNull() != F.col("right").isNull()) | (F.abs(F.col("left") - F.col("right")) > tolerance)
    problems = [
        F.when(F.col("_l").isNull(), "only_right").when(F.col("_r").isNull(), "only_left"),
        F.when(both & far, "reward"),
        *[F.when(both & ~F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")), F.lit(c)) for c in lists],
    ]
    return joined.withColumn("problem", F.explode(F.array_compact(F.array(*problems)))).drop("_l", "_r")


def comparison_table(metrics: DataFrame, tags: Sequence[str], metric: str, manifests: Sequence[DataFrame] = ()) -> DataFrame:
    """category x tag, for two or more different tags; manifests (key, value) that differ from the first are an error first."""
    if len(set(tags)) < 2 or len(set(tags)) != len(tags):
        raise ValueError(f"a comparison takes two or more different tags, not {list(tags)}")
    for other in manifests[1:]:
        bad = comparable(manifests[0], other).select("key").orderBy("key").limit(20).collect()
        if bad:
            raise ValueError(f"runs differ in {', '.join(r[0] for r in bad)}")
    return metrics.groupBy("category").pivot("tag", list(tags)).agg(F.first(metric))


def budget_share(steps: DataFrame, caps: Sequence[int], value: str = "steps") -> DataFrame:
    """The share of rows within each cap."""
    row = steps.agg(*[F.round(F.avg((F.col(value) <= c).cast("int")), 4).alias(f"c{c}") for c in caps])
    pairs = ", ".join(f"{c}, c{c}" for c in caps)
    return row.selectExpr(f"stack({len(caps)}, {pairs}) as (cap, share)")


def task_verdict(turns: DataFrame) -> DataFrame:
    """Per task the first failed condition and its sparse diagnostics.

    In order: never completed, snapshot count, then turn by turn the state and, where that
    holds, the result; else pass. What a failure leaves undefined is null, not 0.
    """
    bad = ~F.col("state_match") | ~F.col("result_match")
    per = turns.groupBy("task_id").agg(
        F.bool_and("completed").alias("done"), F.max("expected_turns").alias("want"), F.count("*").alias("have"),
        F.min(F.when(bad, F.struct("turn", (~F.col("state_match")).alias("state")))).alias("first"),
    )
    kind = F.when(F.col("first.state"), "state").otherwise("result")
    reached = F.col("done") & (F.col("want") == F.col("have"))
    verdict = (
        F.when(~F.col("done"), "never_completed").when(F.col("want") != F.col("have"), "snapshot_count_mismatch")
        .when(F.col("first").isNotNull(), F.concat(kind, F.lit("_mismatch_at_turn_"), F.col("first.turn"))).otherwise("pass")
    )
    stateful = reached & ~F.coalesce(F.col("first.state"), F.lit(False))
    return per.select(
        "task_id", verdict.alias("verdict"), F.col("done").cast("double").alias("completion_rate"),
        F.round(F.coalesce(F.try_divide("have", "want"), F.lit(0.0)), 6).alias("snapshot_count_ratio"),
        F.when(reached, stateful.cast("double")).alias("state_match_rate"),
        F.when(stateful, F.col("first").isNull().cast("double")).alias("result_match_rate"),
    )
