"""The episode state machine on a stream: one slot per position, kept by the worker that holds it.

A worker's state are the slots that are open on it (a map by position), the stage
intervals of their episodes (a list) and the deadline of its timer (a value). An episode
is ``ready``, ``generating`` or ``tool``, and ``done`` once it is emitted. A crash retires
every episode that its worker holds, and opens the next attempt of each, named ``~n``; what
an earlier attempt still brings is stale and ignored. The same transitions serve tables and
streams; on a stream a timer ends episodes that are silent beyond their budget. A table
needs no state store: its events are sorted by worker and time, and replayed in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = (
    "worker string, position long, attempt int, episode_id string, replaced_episode_id string, opened double, ended double, step_count long, generation_count long, "
    "invalid_call_count long, terminal_reason string, stage_timings map<string,array<double>>"
)
#: The events of an episode, the states it may be in for them, the one it is in after, and what they add to its counts.
MOVES = {
    "generate": (("ready",), "generating", "generations"), "call": (("generating",), "tool", "steps"), "invalid": (("generating",), "ready", "invalid"),
    "result": (("tool",), "ready", None),
}
COUNTS = ("steps", "generations", "invalid")
SLOT = "attempt int, state string, opened double, entered double, steps long, generations long, invalid long"
INTERVAL = "position long, stage string, seconds double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ReplacementError(RuntimeError):
    """A position was replaced too often: a failure that repeats is no crash."""


class Slots(StatefulProcessor):
    def __init__(self, budget_s: float, most: int, clock: str):
        self.budget, self.most, self.clock = budget_s, most, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "position long", SLOT)
        self.intervals = handle.getListState("intervals", INTERVAL)
        self.deadline = handle.getValueState("deadline", "at_ms long")

    def _load(self) -> tuple[dict[int, dict], dict[int, dict[str, list[float]]]]:
        """The open slots and their stage timings; a key's state is read and written once a call, not once an event."""
        names = [x.split()[0] for x in SLOT.split(", ")]
        slots = {k[0]: dict(zip(names, v, strict=True)) for k, v in self.slots.iterator()} if self.slots.exists() else {}
        timings: dict[int, dict[str, list[float]]] = {}
        for position, stage, seconds in self.intervals.get() if self.intervals.exists() else ():
            timings.setdefault(position, {}).setdefault(stage, []).append(seconds)
        return slots, timings

    def _save(self, slots: dict[int, dict], timings: dict[int, dict[str, list[float]]]) -> None:
        for position in [k[0] for k in self.slots.keys()] if self.slots.exists() else []:
            if position not in slots:
                self.slots.removeKey((position,))
        for position, slot in slots.items():
            self.slots.updateValue((position,), tuple(slot.values()))
        held = [(p, stage, x) for p, by_stage in timings.items() if p in slots for stage, xs in by_stage.items() for x in xs]
        if held:
            self.intervals.put(held)
        else:
            self.intervals.clear()
        self._set_timer(slots)

    def _set_timer(self, slots: dict[int, dict]) -> None:
        """One timer a worker, at the first deadline of its slots."""
        if self.clock == "None":
            return
        before = self.deadline.get()[0] if self.deadline.exists() else None
        first = min((int(1000 * (s["opened"] + self.budget)) + 1 for s in slots.values()), default=None)
        if first == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
            self.deadline.clear()
        if first is not None:
            self.handle.registerTimer(first)
            self.deadline.update((first,))

    def _retire(self, worker: str, position: int, slots: dict, timings: dict, at: float, reason: str) -> tuple:
        slot = slots.pop(position)
        stages = timings.pop(position, {})
        return (
            worker, position, slot["attempt"], name_of(position, slot["attempt"]), name_of(position, slot["attempt"] - 1), slot["opened"], at,
            slot["steps"], slot["generations"], slot["invalid"], reason, stages,
        )

    @staticmethod
    def _opened(attempt: int, at: float) -> dict:
        return {"attempt": attempt, "state": "ready", "opened": at, "entered": at, "steps": 0, "generations": 0, "invalid": 0}

    def _overdue(self, worker: str, slots: dict, timings: dict, now: float) -> list[tuple]:
        late = sorted(p for p, s in slots.items() if now - s["opened"] > self.budget)
        return [self._retire(worker, p, slots, timings, slots[p]["opened"] + self.budget, "timeout") for p in late]

    def _event(self, worker: str, slots: dict, timings: dict, at: float, event: str, position: int | None, attempt: int | None) -> list[tuple]:
        rows = self._overdue(worker, slots, timings, at)
        if event == "crash":
            for p in sorted(slots):
                attempt = slots[p]["attempt"] + 1
                if attempt > self.most:
                    raise ReplacementError(f"position {p} has more than {self.most} replacements")
                rows.append(self._retire(worker, p, slots, timings, at, "worker_crash"))
                slots[p] = self._opened(attempt, at)
            return rows
        if position is None:
            return rows
        if event == "open":
            slots.setdefault(position, self._opened(attempt or 0, at))
            return rows
        slot = slots.get(position)
        if slot is None or slot["attempt"] != (attempt or 0):  # of an episode that is gone: stale
            return rows
        if event not in MOVES:
            return [*rows, self._retire(worker, position, slots, timings, at, event)]
        allowed, after, count = MOVES[event]
        if slot["state"] in allowed:
            timings.setdefault(position, {}).setdefault(slot["state"], []).append(at - slot["entered"])
            slot |= {"state": after, "entered": at}
            if count:
                slot[count] += 1
        return rows

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slots, timings = self._load()
        out: list[tuple] = []
        for each in pd.concat(list(rows), ignore_index=True).sort_values(["at", "seq"], kind="stable")[["at", "event", "position", "attempt"]].astype(object).itertuples(index=False):
            place, attempt = (None if pd.isna(x) else int(x) for x in (each.position, each.attempt))
            out += self._event(key[0], slots, timings, each.at, each.event, place, attempt)
        self._save(slots, timings)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slots, timings = self._load()
        self.deadline.clear()
        out = self._overdue(key[0], slots, timings, expiredTimerInfo.getExpiryTimeInMs() / 1000)
        self._save(slots, timings)
        yield _frame(out)

    def close(self) -> None:
        pass


def name_of(position: int, attempt: int) -> str | None:
    return None if attempt < 0 else str(position) if attempt == 0 else f"{position}~{attempt}"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.replace("string,array", "string;array").split(", ")])


def _replayed(budget_s: float, most: int):
    """Over rows (worker, at, event, position, attempt) sorted by worker and time: what ends, with the state of one worker at a time."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "map<string,array<double>>": pa.map_(pa.string(), pa.list_(pa.float64()))}
    fields = [x.split(" ") for x in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, current = Slots(budget_s, most, "None"), object()
        slots: dict[int, dict] = {}
        timings: dict[int, dict[str, list[float]]] = {}
        for batch in batches:
            out: list[tuple] = []
            for worker, at, event, position, attempt in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if worker != current:
                    current, slots, timings = worker, {}, {}
                out += machine._event(worker, slots, timings, at, event, position, attempt)
            if out:
                *plain, stages = zip(*out, strict=True)
                columns = [*plain, [list(x.items()) for x in stages]]
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])

    return run


def episode_slots(events: DataFrame, budget_s: float, most: int = 3, clock: str = "None", late: str = "1 millisecond") -> DataFrame:
    """An OUT row for every episode that ends, of events (worker, at, seq, event, position, attempt).

    ``at`` are seconds, of which a micro-batch is put in order, ``seq`` breaks ties. Events
    are open, generate, call, invalid, result; crash, which has no position and is its
    worker's; any other ends its episode and is the reason. One that is later than
    ``budget_s`` after its opening has ended as ``timeout`` before. Events that the
    episode's state does not allow, or of an attempt that is not the current one, are
    ignored. ``clock``: ``EventTime``, where timers follow ``at`` behind ``late``, or
    ``ProcessingTime``, where ``at`` must be the machine's; None for tables.
    """
    spark = events.sparkSession
    cast = {"worker": "string", "at": "double", "seq": "long", "event": "string", "position": "long", "attempt": "int"}
    given = events.select(*[F.col(c).cast(t).alias(c) for c, t in cast.items()])
    if clock == "None" and not events.isStreaming:
        timed = given.withColumn("at", F.coalesce("at", F.lit(float("nan")))).repartition("worker")
        placed = timed.sortWithinPartitions("worker", "at", F.asc_nulls_last("seq")).select("worker", "at", "event", "position", "attempt")
        return placed.mapInArrow(_replayed(budget_s, most), OUT)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    _ = spark.streams.active  # tables keep state in the stores of streams, which this starts
    if clock == "EventTime":
        # a watermark drops what is not above it, and starts at 0
        given = given.withColumn("_ts", F.timestamp_millis((F.col("at") * 1000).cast("long") + 1)).withWatermark("_ts", late)
    return given.groupBy("worker").transformWithStateInPandas(
        statefulProcessor=Slots(budget_s, most, clock), outputStructType=OUT, outputMode="append", timeMode=clock
    )


def feed(attempts: DataFrame, crashes: DataFrame) -> DataFrame:
    """The events of attempts (worker, position, attempt, opened, ended, reason) and of crashes (worker, at).

    First attempts open by themselves, later ones by the crash before; what ends at the
    time of a crash has ended.
    """

    def of(at: str, seq: int, event: Column) -> DataFrame:
        return attempts.select("worker", F.col(at).cast("double").alias("at"), F.lit(seq).alias("seq"), event.alias("event"), "position", "attempt")

    none = F.lit(None)
    crashed = crashes.select(
        "worker", F.col("at").cast("double").alias("at"), F.lit(2).alias("seq"), F.lit("crash").alias("event"), none.cast("long").alias("position"), none.cast("int").alias("attempt")
    )
    return of("opened", 0, F.lit("open")).where("attempt = 0").unionByName(of("ended", 1, F.col("reason"))).unionByName(crashed)
