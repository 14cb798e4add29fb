"""What a user plugs in: renderings by name, benchmark adapters, and scripted replies in place of a model."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellium.operators import evaluation, trajectories

#: A rendering takes the array of messages (role, content, ...) and returns the text; an Arrow pandas UDF is one too.
Render = Callable[[Column], Column]
RENDERINGS: dict[str, Render] = {}


def register(name: str, render: Render) -> Render:
    """Adds a rendering; a name that is taken is an error."""
    if name in RENDERINGS:
        raise ValueError(f"there is a rendering {name!r} already")
    RENDERINGS[name] = render
    return render


def rendered(rows: DataFrame, name: str, messages: str = "messages", out: str = "rendered") -> DataFrame:
    """``rows`` with the text that the named rendering makes of the messages."""
    if name not in RENDERINGS:
        raise ValueError(f"no rendering {name!r}; there are {sorted(RENDERINGS)}")
    return rows.withColumn(out, RENDERINGS[name](F.col(messages)))


def _marks(reasoning: bool) -> Render:
    return lambda messages: trajectories.render(trajectories.template_messages(messages, reasoning))


register("marks", _marks(True))
register("marks_without_reasoning", _marks(False))
register("content", lambda messages: F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n"))


class Adapter(Protocol):
    """A benchmark; each method returns a DataFrame, so nothing about tasks is on the driver."""

    def tasks(self) -> DataFrame:
        """task_id, category and what prompts need."""

    def prompts(self, tasks: DataFrame) -> DataFrame:
        """task_id, prompt."""

    def score(self, replies: DataFrame) -> DataFrame:
        """task_id, score, exact_success, invalid_calls, steps, generated_tokens, truncated of the replies (task_id, turn, reply)."""

    def invariants(self) -> DataFrame:
        """key, value: what must agree between runs that are compared."""

    def summarize(self, results: DataFrame) -> DataFrame:
        """Metrics by category."""


def run(adapter: Adapter, backend: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The metrics of an adapter whose prompts a backend answers; a task without a reply scores 0."""
    tasks = adapter.tasks()
    scored = adapter.score(backend(adapter.prompts(tasks)))
    zero = {"score": 0.0, "exact_success": False, "invalid_calls": 0, "steps": 0, "generated_tokens": 0, "truncated": False}
    return adapter.summarize(tasks.select("task_id", "category").join(scored, "task_id", "left").fillna(zero))


@dataclass
class Exact:
    """The adapter of a table of questions (task_id, category, question, answer): a reply is right if it is the answer."""

    questions: DataFrame
    release: str

    def tasks(self) -> DataFrame:
        return self.questions.select("task_id", "category", "question")

    def prompts(self, tasks: DataFrame) -> DataFrame:
        return tasks.select("task_id", F.col("question").alias("prompt"))

    def score(self, replies: DataFrame) -> DataFrame:
        last = replies.groupBy("task_id").agg(F.max_by("reply", "turn").alias("reply"), F.count("*").alias("steps"), F.sum(F.length("reply")).alias("generated_tokens"))
        right = F.coalesce(F.col("reply") == F.col("answer"), F.lit(False))
        return last.join(self.questions.select("task_id", "answer"), "task_id").select(
            "task_id", right.cast("double").alias("score"), right.alias("exact_success"), F.when(F.col("reply") == "", 1).otherwise(0).alias("invalid_calls"),
            "steps", "generated_tokens", F.lit(False).alias("truncated"),
        )

    def invariants(self) -> DataFrame:
        return self.questions.agg(F.count("*").cast("string").alias("value")).select(F.lit("tasks").alias("key"), "value").unionByName(
            self.questions.sparkSession.range(1).select(F.lit("release").alias("key"), F.lit(self.release).alias("value"))
        )

    def summarize(self, results: DataFrame) -> DataFrame:
        return evaluation.category_metrics(results)


def scripted(requests: DataFrame, script: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``requests`` with the scripted ``reply`` of their keys; one that the script does not have is an error."""
    met = requests.join(script.select(*keys, "reply", F.lit(True).alias("_known")), list(keys), "left")
    missing = F.concat(F.lit("no scripted reply for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    return met.where(F.when(F.col("_known"), True).otherwise(F.raise_error(missing).cast("boolean"))).drop("_known")
