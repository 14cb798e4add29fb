"""Predicates and checked joins that reject instead of dropping silently."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellium.operators import ordered


def missing_keys(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """The keys of ``facts`` that the dimension lacks."""
    return facts.select(key).where(F.col(key).isNotNull()).distinct().join(dimension, key, "left_anti")


def looked_up(facts: DataFrame, dimension: DataFrame, key: Sequence[str]) -> DataFrame:
    """``facts`` with the dimension's columns; a row without a partner is an error that names its key."""
    names = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key])
    joined = facts.join(dimension.withColumn("_found", F.lit(True)), list(key), "left")
    return joined.where(F.when(F.col("_found"), True).otherwise(F.raise_error(F.concat(F.lit("no entry for "), names)).cast("boolean"))).drop("_found")


def bind_by_text(prompts: DataFrame, scenarios: DataFrame, text: str, order: Sequence[str], per_group: int) -> DataFrame:
    """``prompts`` with the scenario of equal text and their group in prompt order.

    Two scenarios of one text, or a prompt without a scenario, are errors. Texts are
    compared by SHA-256, so the exchange holds digests.
    """
    digest = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    keyed = scenarios.withColumn("_h", digest).drop(text)
    once = F.count("*").over(Window.partitionBy("_h")) == 1
    unique = keyed.withColumn("_once", once).where(F.when(F.col("_once"), True).otherwise(F.raise_error(F.lit("two scenarios have one text")).cast("boolean"))).drop("_once")
    bound = looked_up(prompts.withColumn("_h", digest).drop(text), unique, ["_h"]).drop("_h")
    return ordered.numbered(bound, order).withColumn("group_index", F.expr(f"position div {per_group}"))


def visible_tools(turns: DataFrame, tools: DataFrame, held: DataFrame, key: str, name: str = "name", turn: str = "turn") -> DataFrame:
    """The tools of each turn, without those held out until a later one (``hold_turn``)."""
    offered = turns.join(tools, key)
    later = held.select(F.col(key).alias("_k"), F.col(name).alias("_n"), "hold_turn")
    hidden = (F.col(key) == F.col("_k")) & (F.col(name) == F.col("_n")) & (F.col("hold_turn") > F.col(turn))
    return offered.join(later, hidden, "left_anti")


def select_ready(slots: DataFrame, by: Sequence[str], order: Sequence[str], width: int, max_turns: int, max_steps: int, max_len: int, margin: int) -> DataFrame:
    """Ready slots with a decision: generate, a cap that ends them, or wait.

    Slots are taken in order until ``width`` of them generate; a capped one takes no place,
    and after the last place nothing is looked at.
    """
    ready = slots.where("admitted and state = 'ready' and terminal_reason is null")
    cap = F.when(F.col("generation_count") >= max_turns, "turn_cap").when(F.col("step_count") >= max_steps, "step_cap").when(F.col("prefix") >= max_len - margin, "step_cap")
    ahead = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(F.when(cap.isNull(), 1).otherwise(0)).over(ahead), F.lit(0))
    return ready.withColumn("decision", F.when(taken >= width, "wait").otherwise(F.coalesce(cap, F.lit("generate"))))


def token_budget(prefix: Column, per_step: int, max_len: int, margin: int) -> Column:
    """How many tokens may follow a prefix; one at least."""
    return F.greatest(F.lit(1), F.least(F.lit(per_step), F.lit(max_len) - prefix - F.lit(margin)))


def exceeds(value: Column, threshold: float) -> Column:
    """Whether a logged number is there, is a number and is above the threshold."""
    return F.coalesce(~F.isnan(value) & (value > threshold), F.lit(False))


def is_boundary(step: Column, every: int, at_save: Column, enabled: bool = True) -> Column:
    """Whether to evaluate: at a save, or at each ``every``-th step after the start."""
    if not enabled:
        return F.lit(False)
    regular = (step > 0) & (F.pmod(step, F.lit(every)) == 0) if every else F.lit(False)
    return at_save | regular


def cap_violations(actual: DataFrame, caps: DataFrame) -> DataFrame:
    """Messages for the fields (field, value) above their cap (field, cap)."""
    over = actual.join(caps, "field").where(F.col("value") > F.col("cap"))
    return over.select("field", F.format_string("%s=%d exceeds cap %d", "field", "value", "cap").alias("message"))


def resumable(rows: DataFrame, identity: Mapping[str, object], summary: str = "run") -> DataFrame:
    """Earlier rows without the summary; one of another identity is an error, nulls being equal."""
    same = F.lit(True)
    for column, value in identity.items():
        same = same & F.col(column).eqNullSafe(F.lit(value))
    kept = rows.where(~F.col("name").eqNullSafe(F.lit(summary)))
    return kept.where(F.when(same, True).otherwise(F.raise_error(F.lit("rows of another identity")).cast("boolean")))


def nothing_generated(episodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The groups in which no episode generated a turn, with their sorted terminal reasons."""
    reasons = F.array_sort(F.collect_set(F.coalesce("terminal_reason", F.lit("unknown"))))
    per = episodes.groupBy(*by).agg(F.max("generation_count").alias("most"), F.count("*").alias("episodes"), reasons.alias("reasons"))
    return per.where("most = 0 and episodes > 0").drop("most")


def valid_rows(parsed: DataFrame, strict: bool = False, limit: int | None = None) -> DataFrame:
    """Rows without a malformed_reason; strict fails on one. The limit counts rows that parsed."""
    bad = F.col("malformed_reason")
    good = parsed.where(F.when(bad.isNull(), True).otherwise(F.raise_error(bad).cast("boolean"))) if strict else parsed.where(bad.isNull())
    return good if limit is None else good.limit(limit)


def scenarios(rows: DataFrame) -> DataFrame:
    """Scenarios with the keys they need and a checklist that is not empty; anything else is an error."""
    fault = F.coalesce(
        *[F.when(F.col(c).isNull(), F.lit(f"scenario is missing {c}")) for c in ("task_id", "env_id", "env_class_name", "checklist")],
        F.when(F.size("checklist") == 0, F.concat(F.col("task_id"), F.lit(": empty checklist"))),
    )
    return rows.where(F.when(fault.isNull(), True).otherwise(F.raise_error(fault).cast("boolean")))


def bundle_faults(runs: DataFrame, total: int = 200) -> DataFrame:
    """The first fault of each run of a bundle (folder, config, point_config, input_lens, completed, failed)."""
    lens = F.first("input_lens").over(Window.partitionBy("folder").orderBy("run_number"))
    fault = (
        F.when(F.col("point_config").isNull(), "no point").when(~F.col("config").eqNullSafe(F.col("point_config")), "config differs from its point")
        .when(~F.col("input_lens").eqNullSafe(lens), "input lengths differ").when(F.col("completed") + F.col("failed") != total, "request count")
    )
    return runs.withColumn("fault", fault)
