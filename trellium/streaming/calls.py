"""Outcomes of calls to workers: what comes back in time, and what does not.

A call is joined with the signal of its own that lies within its limit, a reply or the loss
of its worker. A call without one is a timeout: on a stream the outer join says so when the
watermark has passed its limit, so no row says it for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR = "Error during execution:"


def signals(replies: DataFrame, crashes: DataFrame) -> DataFrame:
    """call_id, signal_at, kind, reply: of replies (call_id, at, reply), and of crashes (lost: the ids of the calls that the worker held, at)."""
    results = replies.select("call_id", F.col("at").alias("signal_at"), F.lit("result").alias("kind"), "reply")
    return results.unionByName(crashes.select(F.explode("lost").alias("call_id"), F.col("at").alias("signal_at"), F.lit("exit").alias("kind"), F.lit(None).cast("string").alias("reply")))


def outcomes(calls: DataFrame, signalled: DataFrame, limit: str, late: str | None = None) -> DataFrame:
    """call_id, at, outcome of calls (call_id, at): ok, error, worker_crash or timeout; only a crash is the infrastructure's.

    A call has one signal at most, and ``limit``, an interval, to have it in. Streams need
    ``late``, how far rows may lag behind the latest of their side.
    """
    if late is not None:
        calls, signalled = calls.withWatermark("at", late), signalled.withWatermark("signal_at", late)
    c, s = calls.alias("c"), signalled.alias("s")
    within = (F.col("s.signal_at") >= F.col("c.at")) & (F.col("s.signal_at") <= F.col("c.at") + F.expr(f"interval {limit}"))
    met = c.join(s, (F.col("c.call_id") == F.col("s.call_id")) & within, "left_outer")
    outcome = (
        F.when(F.col("s.kind").isNull(), "timeout").when(F.col("s.kind") == "exit", "worker_crash").when(F.coalesce(F.col("s.reply").startswith(ERROR), F.lit(False)), "error").otherwise("ok")
    )
    return met.select("c.call_id", "c.at", outcome.alias("outcome"))


def first_signals(signalled: DataFrame) -> DataFrame:
    """The earliest signal of each call, of a table that may have several: what a lost worker still brings is stale."""
    first = F.min(F.struct("signal_at", "kind", "reply")).alias("f")
    return signalled.groupBy("call_id").agg(first).select("call_id", "f.*")
