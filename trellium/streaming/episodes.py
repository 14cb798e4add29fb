"""Episode state: open, step and done events folded into one row per finished episode."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "episode_id string, opened double, ended double, steps long, attempts long, terminal_reason string"
STATE = "opened double, steps long, attempts long"


def episodes(events: DataFrame, budget_s: float, max_attempts: int = 3) -> DataFrame:
    """Finished episodes of a stream of (episode_id, at seconds, event).

    ``open`` starts an attempt, ``step`` counts, ``done`` ends it. ``crash`` replaces the
    attempt, as often as allowed, and is never scored; an event later than the budget ends
    it as ``timeout``, which is. So does the clock, when an open episode stays silent for what
    was left of its budget at its last event. Events of an episode that is not open are ignored.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened, steps, attempts = state.get if state.exists else (None, 0, 0)
        rows = []
        if state.hasTimedOut:
            rows.append((key[0], opened, opened + budget_s, steps, attempts, "timeout"))
            opened = None
            parts = iter(())
        # all that a micro-batch has of the episode, in order of time
        held = list(parts)
        for part in [pd.concat(held, ignore_index=True)] if held else []:
            for at, event in part.sort_values("at", kind="stable")[["at", "event"]].itertuples(index=False):
                last = at
                if event == "open":
                    opened, steps, attempts = at, 0, attempts + 1
                    continue
                if opened is None:
                    continue
                reason = None
                if at - opened > budget_s:
                    reason = "timeout"
                elif event == "step":
                    steps += 1
                elif event == "done":
                    reason = "final_answer"
                elif event == "crash":
                    if attempts >= max_attempts:
                        reason = "worker_crash"
                    else:
                        opened, steps, attempts = at, 0, attempts + 1
                if reason:
                    rows.append((key[0], opened, at, steps, attempts, reason))
                    opened, steps, attempts = None, 0, 0
        if opened is None:
            if state.exists:
                state.remove()
        else:
            state.update((opened, steps, attempts))
            state.setTimeoutDuration(max(1, int(1000 * (budget_s - (last - opened)))))
        yield pd.DataFrame(rows, columns=["episode_id", "opened", "ended", "steps", "attempts", "terminal_reason"])

    return events.groupBy("episode_id").applyInPandasWithState(step, OUT, STATE, "append", "ProcessingTimeTimeout")


def scored(finished: DataFrame) -> DataFrame:
    """Without infrastructure failures."""
    return finished.where(F.col("terminal_reason") != "worker_crash")
