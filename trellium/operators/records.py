"""Training and rollout records: shard scans and statistics, batches, episode rows, alignment by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trellium.functions.arrays import IGNORED, pad, supervised
from trellium.operators import ordered

#: The columns of a shard that a training step reads.
FEATURE_COLUMNS = ("schema_version", "semantics", "trajectory_uid", "input_ids", "labels", "seq_length", "supervised_tokens")


def features(shard: DataFrame) -> DataFrame:
    """The feature columns of a shard with ``length``; nothing else is read from columnar files."""
    have = [c for c in FEATURE_COLUMNS if c in shard.columns]
    length = F.col("length") if "length" in shard.columns else F.size("input_ids")
    return shard.select(*have, length.cast("int").alias("length"))


def shard_stats(shard: DataFrame, longest: int | None = None, budget: int | None = None) -> DataFrame:
    """One row: samples, tokens, supervised tokens and their share, null for an empty shard.

    A row longer than the longest sequence or than a whole batch may be is an error.
    """
    n = F.size("input_ids")
    fault = F.lit(None).cast("string")
    for limit, name in ((longest, "the longest sequence"), (budget, "the token budget")):
        if limit is not None:
            fault = F.coalesce(fault, F.when(n > limit, F.format_string(f"length %d is beyond {name} of {limit}", n)))
    checked = shard.where(F.when(fault.isNull(), True).otherwise(F.raise_error(fault).cast("boolean")))
    row = checked.agg(
        F.count("*").alias("samples"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_tokens"),
        F.coalesce(F.sum(supervised(F.col("labels"))), F.lit(0)).cast("long").alias("supervised_tokens"),
    )
    return row.withColumn("supervised_fraction", F.round(F.try_divide("supervised_tokens", "total_tokens"), 6))


def read_back(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Appended records as they were written, one JSON object a line; a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def collate(rows: DataFrame, batch: Sequence[str], filler: int, longest: int | None = None) -> DataFrame:
    """``rows`` with ids, labels and an attention mask padded on the right to the widest of their batch.

    A row beyond ``longest`` is an error: nothing is cut.
    """
    n = F.size("input_ids")
    if longest is not None:
        message = F.format_string(f"length %d is beyond the configured {longest}", n)
        rows = rows.where(F.when(n <= longest, True).otherwise(F.raise_error(message).cast("boolean")))
    wide = rows.withColumn("_wide", F.max(n).over(Window.partitionBy(*batch)))
    return wide.withColumns({
        "attention_mask": pad(F.transform("input_ids", lambda _: F.lit(1)), F.col("_wide"), 0),
        "input_ids": pad(F.col("input_ids"), F.col("_wide"), filler),
        "labels": pad(F.col("labels"), F.col("_wide"), IGNORED),
    }).drop("_wide")


def flatten_batches(rows: DataFrame, batch: Sequence[str], order: Sequence[str], budget: int) -> DataFrame:
    """One row a batch: its rows laid end to end, with where each starts and ends.

    The first label of every row is ignored, as its predecessor belongs to another row. A
    batch beyond the budget is an error, so what is gathered for one is bounded.
    """
    part = F.struct(*order, "input_ids", "labels")
    total = F.sum(F.size("input_ids"))
    sized = rows.groupBy(*batch).agg(total.alias("_tokens"))
    message = F.format_string(f"a batch of %d tokens is beyond the budget of {budget}", F.col("_tokens"))
    fits = sized.where(F.when(F.col("_tokens") <= budget, True).otherwise(F.raise_error(message).cast("boolean"))).drop("_tokens")
    gathered = rows.join(fits, list(batch), "left_semi").groupBy(*batch).agg(F.array_sort(F.collect_list(part)).alias("m"))
    lengths = F.transform("m", lambda x: F.size(x["input_ids"]))
    ends = F.transform(F.sequence(F.lit(0), F.size("n")), lambda k: F.aggregate(F.slice("n", F.lit(1), k), F.lit(0), lambda a, x: a + x))
    ignored = F.array(F.lit(IGNORED))
    return gathered.withColumn("n", lengths).select(
        *batch,
        F.flatten(F.transform("m", lambda x: x["input_ids"])).alias("input_ids"),
        F.flatten(F.transform("m", lambda x: F.concat(ignored, F.slice(x["labels"], 2, F.size(x["labels"]))))).alias("labels"),
        F.flatten(F.transform("n", lambda k: F.sequence(F.lit(0), k - 1))).alias("position_ids"),
        F.flatten(F.transform("n", lambda k, i: F.array_repeat(i, k))).alias("seq_idx"),
        ends.alias("cu_seqlens"),
        F.array_max("n").alias("max_length"),
    )


def episode_rows(turns: DataFrame, key: str = "episode_id") -> DataFrame:
    """The nested record of each episode from its turns (turn, role, content), with what they add up to.

    A result of a tool is an observation; an assistant turn is a generation.
    """
    message = F.struct("turn", "role", "content")
    each = turns.groupBy(key).agg(
        F.array_sort(F.collect_list(message)).alias("m"),
        F.count_if(F.col("role") == "assistant").alias("generation_count"),
        F.count_if(F.col("role") == "tool").alias("step_count"),
    )
    observed = F.filter("m", lambda x: x["role"] == "tool")
    return each.select(
        key,
        F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"),
        F.transform(observed, lambda x: x["content"]).alias("observations"),
        "step_count", "generation_count",
        F.when(F.element_at("m", -1)["role"] == "assistant", "final_answer").alias("terminal_reason"),
    )


#: The fields of an episode's row, in its order.
EPISODE = (
    "episode_id", "scenario_id", "group_index", "messages", "observations", "step_count", "generation_count", "invalid_call_count", "terminal_reason", "replaced_episode_id", "reward",
    "per_check_bools", "drift", "stage_timings",
)


def trajectory_rows(turns: DataFrame, episodes: DataFrame) -> DataFrame:
    """EPISODE, a row an episode: its messages with reasoning and calls, and what ``episodes`` knows of it.

    ``turns``: episode_id, turn, role, content, reasoning_content, tool_calls (JSON of the
    calls, or null) and invalid (whether its call was). ``episodes`` has the other fields by
    episode_id; checks that were not made are an empty list.
    """
    said = F.struct("turn", "role", "content", "reasoning_content", "tool_calls")
    each = turns.groupBy("episode_id").agg(
        F.array_sort(F.collect_list(said)).alias("m"), F.count_if(F.col("role") == "assistant").alias("generation_count"), F.count_if(F.col("role") == "tool").alias("step_count"),
        F.count_if(F.coalesce("invalid", F.lit(False))).alias("invalid_call_count"),
    )
    shown = F.transform("m", lambda x: F.struct(*[x[c].alias(c) for c in ("role", "content", "reasoning_content", "tool_calls")]))
    observed = F.transform(F.filter("m", lambda x: x["role"] == "tool"), lambda x: x["content"])
    made = each.withColumns({"messages": shown, "observations": observed}).drop("m")
    return episodes.join(made, "episode_id").withColumn("per_check_bools", F.coalesce("per_check_bools", F.array().cast("array<boolean>"))).select(*EPISODE)


def assemble(episodes: DataFrame) -> DataFrame:
    """The columns of a rollout batch, after its contracts hold: equal lengths, no log probability where the mask is 0, a reward.

    ``episodes`` has prompt_ids, completion_ids, logprobs, env_mask, reward and what is
    passed through: per_check_bools, terminal_reason, scenario_id, group_index, trajectory.
    With mask_spans and boundary, the spans must mark as many tokens as the mask.
    """
    n = F.size("completion_ids")
    masked = F.exists(F.arrays_zip(F.col("env_mask").alias("m"), F.col("logprobs").alias("p")), lambda x: (x["m"] == 0) & ~F.isnan(x["p"]))
    fault = (
        F.when((F.size("logprobs") != n) | (F.size("env_mask") != n), "lengths diverge")
        .when(masked, "a masked position has a log probability")
        .when(F.col("reward").isNull(), "no reward")
    )
    if "mask_spans" in episodes.columns:
        fault = F.coalesce(fault, F.when(~span_sum_matches(F.col("mask_spans"), F.col("boundary"), F.col("env_mask")), "spans and mask disagree"))
    good = episodes.where(F.when(fault.isNull(), True).otherwise(F.raise_error(F.concat_ws(": ", F.col("scenario_id").cast("string"), fault)).cast("boolean")))
    through = [c for c in ("per_check_bools", "terminal_reason", "scenario_id", "group_index", "trajectory") if c in episodes.columns]
    return good.select("prompt_ids", "completion_ids", "logprobs", "env_mask", F.col("reward").cast("double").alias("rollout_reward"), *through)


def span_sum_matches(spans: Column, boundary: Column, mask: Column) -> Column:
    """Whether the supervised spans (start, end, supervised) beyond the boundary mark as many tokens as the mask."""
    of = F.aggregate(
        spans, F.lit(0).cast("long"),
        lambda a, s: a + F.when(s["supervised"], F.greatest(s["end"] - F.greatest(s["start"], boundary), F.lit(0))).otherwise(0).cast("long"),
    )
    return of == F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x)


def zip_positions(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """The columns of both, row by row in their orders; different numbers of rows are an error."""
    left, right = ordered.numbered(a, order_a), ordered.numbered(b, order_b)
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), "position", "full_outer")
    whole = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.where(F.when(whole, True).otherwise(F.raise_error(F.lit("the sides differ in length")).cast("boolean"))).drop("_l", "_r")


def prefix(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of a fixed order, the same on every run."""
    return rows.orderBy(*order).limit(n)


def first_user(messages: Column) -> Column:
    """The content of the first message of the user; null if there is none."""
    return F.get(F.filter(messages, lambda m: m["role"] == "user"), 0)["content"]


def last_user(messages: Column) -> Column:
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))["content"]


def is_multi_turn(category: Column, names: Sequence[str]) -> Column:
    """Whether a category is one of the multi-turn ones; a null category is not."""
    return F.coalesce(category.isin(*names), F.lit(False))


def categories(df: DataFrame, column: str, known: Sequence[str], marker: str) -> DataFrame:
    """One row with the sorted different categories; none, one with the marker and an unknown one are errors."""
    found = df.agg(F.array_sort(F.collect_set(column)).alias("categories"))
    bad = F.array_except("categories", F.array(*map(F.lit, known)))
    fault = (
        F.when(F.size("categories") == 0, F.lit("no category"))
        .when(F.exists("categories", lambda c: c.contains(marker)), F.lit(f"categories with {marker} belong elsewhere"))
        .when(F.size(bad) > 0, F.concat(F.lit("unknown categories: "), F.array_join(bad, ", ")))
    )
    return found.where(F.when(fault.isNull(), True).otherwise(F.raise_error(fault).cast("boolean")))
