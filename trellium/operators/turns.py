"""Replays of recorded turns: task loops, admission under a limit, outcomes, prompts and records."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The headings of the environment part of a system prompt.
BRIEF = "# Environment Information\n\n## Brief Introduction:  \n"
RULES = "\n\n## Environment Rules / Constraints:  \n"


def replay(responses: DataFrame, key: str, order: Sequence[str], has_call: str, step_cap: int) -> DataFrame:
    """Responses with the task turn and the step in it, up to the first beyond the cap.

    A response without a call ends its turn. The task ends as ``step_cap`` with the first
    response that would be a step too many; that one stays, marked, and the rest goes.
    """
    ahead = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    turned = responses.withColumn("task_turn", F.coalesce(F.sum(F.when(F.col(has_call), 0).otherwise(1)).over(ahead), F.lit(0)))
    stepped = turned.withColumn("step", F.row_number().over(Window.partitionBy(key, "task_turn").orderBy(*order)))
    over = (F.col("step") > step_cap).cast("int")
    passed = F.sum(over).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn("_over", passed).where("_over <= 1").withColumn("terminal_reason", F.when(F.col("_over") == 1, "step_cap")).drop("_over")


def admit(rows: DataFrame, engine: Sequence[str], order: Sequence[str], duration: str, window: int | None) -> DataFrame:
    """``rows`` with the start and end that an engine of at most ``window`` rows in flight gives them.

    Rows are admitted in order, each when a place falls free; None admits all at 0. A task
    streams through the rows of an engine and holds one number per place.
    """
    if window is None:
        return rows.withColumns({"starts": F.lit(0).cast("long"), "ends": F.col(duration).cast("long")})
    schema = rows.schema.add("starts", "long").add("ends", "long")
    keys = list(engine)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free = None, []
        for part in parts:
            starts, ends = [], []
            for key, n in zip(part[keys].itertuples(index=False, name=None), part[duration].tolist(), strict=True):
                if key != now:
                    now, free = key, [0] * window
                starts.append(free[0])
                ends.append(free[0] + n)
                heapq.heapreplace(free, ends[-1])
            yield part.assign(starts=starts, ends=ends)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def outcome(reply: Column, finished: Column) -> Column:
    """ok, error, timeout or worker_crash: only the last is the infrastructure's."""
    return F.when(~finished & reply.isNull(), "worker_crash").when(~finished, "timeout").when(reply.startswith("Error during execution:"), "error").otherwise("ok")


def system_prompt(mode: Column, separator: str, introduction: Column, rules: Column) -> Column:
    """The system prompt of a task: the mode's text, then what its environment is and demands."""
    listed = F.array_join(F.transform(rules, lambda r: F.concat(F.lit("- "), r, F.lit("\n"))), "")
    return F.concat(mode, F.lit(separator), F.lit(BRIEF), introduction, F.lit(RULES), listed)


def covered(expected: DataFrame, actual: DataFrame, key: str, turn: str, value: str) -> DataFrame:
    """Per task and turn: whether what the turn expects occurs, as often, among all results up to it.

    Both sides are counted first, so the exchange holds a row per task, turn and value.
    """
    sides = expected.select(key, turn, value, F.lit(1).alias("want"), F.lit(0).alias("have")).unionByName(
        actual.select(key, turn, value, F.lit(0).alias("want"), F.lit(1).alias("have"))
    )
    counted = sides.groupBy(key, turn, value).agg(F.sum("want").alias("want"), F.sum("have").alias("have"))
    upto = Window.partitionBy(key, value).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    judged = counted.withColumn("have", F.sum("have").over(upto)).where("want > 0")
    return judged.groupBy(key, turn).agg(F.bool_and(F.col("have") >= F.col("want")).alias("covered"))


def eval_record(tasks: DataFrame, episodes: DataFrame, verdicts: DataFrame, key: str = "task_id") -> DataFrame:
    """A row per task with its episode and verdict; a task without an episode was never run."""
    joined = tasks.join(episodes, key, "left").join(verdicts, key, "left")
    return joined.withColumns({
        "wall_s": F.round("wall_s", 4), "terminal_reason": F.coalesce("terminal_reason", F.lit("never_run")), "score": F.coalesce("score", F.lit(0.0))
    })


def study_points(values: Sequence[str], points: Sequence[tuple], names: Sequence[str]) -> Column:
    """An array of structs: every value with every point, in order; explode it for rows."""
    each = [F.struct(F.lit(v).alias(names[0]), *[F.lit(x).alias(n) for x, n in zip(p, names[1:], strict=True)]) for v in values for p in points]
    return F.array(*each)


def advance(decisions: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Each decision of a driver with the state of its episode after it; what follows a terminal one is dropped.

    A decision has env_steps, invalid_call, tools, pending (whether a result is awaited) and
    terminal (a reason, or null). Steps and invalid calls add up, the last tools that were
    set hold, and the state is ``tool`` while a result is awaited, ``done`` after the end,
    else ``ready``.
    """
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    live = decisions.withColumn("_ended", F.coalesce(F.count("terminal").over(ahead), F.lit(0))).where("_ended = 0").drop("_ended")
    state = F.when(F.col("terminal").isNotNull(), "done").when(F.col("pending"), "tool").otherwise("ready")
    return live.withColumns({
        "step_count": F.sum("env_steps").over(upto), "invalid_call_count": F.sum(F.col("invalid_call").cast("int")).over(upto),
        "tools_in_force": F.last("tools", ignorenulls=True).over(upto), "state": state,
    })


def scheduler_log(advanced: DataFrame, key: str, at: str, first: Column) -> DataFrame:
    """at, episode, event: one row for each transition of an episode, in the words of the engine's log."""
    observed = F.when(F.col("observation").isNotNull(), F.concat(F.lit("observation:"), F.coalesce("label", F.lit("tool"))))
    events = F.array(
        F.when(first, F.lit("ready")), observed, F.when(F.col("state") == "tool", F.lit("step")),
        F.when(F.col("terminal").isNotNull(), F.concat(F.lit("terminal:"), F.col("terminal"))), F.when(F.col("state") == "done", F.lit("done")),
    )
    return advanced.select(F.col(at).alias("at"), F.col(key).alias("episode"), F.explode(F.array_compact(events)).alias("event"))


def replaced(crashes: DataFrame, episodes: DataFrame, most: int = 3) -> DataFrame:
    """Every attempt at a position when workers crash: a crash retires all episodes that its worker holds then.

    ``episodes``: position, worker, attempt, opened, ended; ``crashes``: worker, at. An
    attempt that a crash of its worker falls into is retired, and the result it may still
    bring later is stale. The next attempt is named ``~n``. More than ``most`` replacements
    of a position are an error.
    """
    hit = (F.col("e.worker") == F.col("c.worker")) & (F.col("c.at") >= F.col("e.opened")) & (F.col("c.at") < F.col("e.ended"))
    met = episodes.alias("e").join(crashes.alias("c"), hit, "left").groupBy("e.position", "e.worker", "e.attempt", "e.opened", "e.ended").agg(F.min("c.at").alias("crashed_at"))
    message = F.format_string(f"position %s has more than {most} replacements", F.col("position").cast("string"))
    named = F.when(F.col("attempt") == 0, F.col("position").cast("string")).otherwise(F.concat(F.col("position").cast("string"), F.lit("~"), F.col("attempt")))
    before = F.when(F.col("attempt") == 1, F.col("position").cast("string")).when(F.col("attempt") > 1, F.concat(F.col("position").cast("string"), F.lit("~"), F.col("attempt") - 1))
    return met.where(F.when(F.col("attempt") <= most, True).otherwise(F.raise_error(message).cast("boolean"))).select(
        "position", "worker", "attempt", named.alias("episode_id"), before.alias("replaced_episode_id"), "crashed_at",
        F.when(F.col("crashed_at").isNotNull(), "worker_crash").otherwise("finished").alias("outcome"),
    )
