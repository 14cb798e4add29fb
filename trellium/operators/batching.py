"""Token-budget batches, epoch order, samplers and padding."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellium.operators import ordered
from trellium.sources import shared

#: Rows of a block of ``pack``, at least.
BLOCK = 1 << 18


def next_starts(lengths: np.ndarray, budget: int, padded: bool) -> np.ndarray:
    """For each row, where the batch after the one that starts with it would start."""
    if not padded:
        before = np.concatenate([[0], np.cumsum(lengths)])
        found = np.searchsorted(before, before[:-1] + budget, side="right") - 1
        return np.maximum(found, np.arange(1, len(lengths) + 1))
    out, falling, j = np.empty(len(lengths), np.int64), deque(), 0  # falling: places whose lengths fall, the first is the longest
    sizes = lengths.tolist()
    for i in range(len(sizes)):
        while falling and falling[0] < i:
            falling.popleft()
        j = max(j, i)
        while j < len(sizes) and (j == i or (j - i + 1) * max(sizes[falling[0]], sizes[j]) <= budget):
            while falling and sizes[falling[-1]] <= sizes[j]:
                falling.pop()
            falling.append(j)
            j += 1
        out[i] = j
    return out


def _blocks(numbered: DataFrame, keys: Sequence[str], block: int, reach: int) -> DataFrame:
    """keys, _b, _i, _n: the rows of each block, and after them as many of the next as a batch may reach."""
    own = F.expr(f"_i div {block}")
    ahead = F.when((own > 0) & (F.col("_i") % block < reach), own - 1)
    return numbered.select(*keys, F.explode(F.array_compact(F.array(own, ahead))).alias("_b"), "_i", "_n")


def _types(df: DataFrame, keys: Sequence[str], more: str) -> str:
    return ", ".join([*[f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys], more])


def pack(rows: DataFrame, shard: Sequence[str], order: Sequence[str], length: str, budget: int, padded: bool = False, alone: bool = False, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``batch``, filled greedily in order within each shard; no row is split.

    The cost of a batch is the sum of its lengths, or rows times the longest if padded. A
    row beyond the budget, unless such rows are to stand ``alone`` in a batch, or without
    length, is an error.

    Where a batch ends depends on where it starts, but where the next would start is known
    for every row from a bounded number of rows after it. So a shard is cut into blocks
    that are longer than any batch; each block says for its possible entries, which are
    its first rows, where the chain of batches leaves it, pointer doubling over these finds
    the entry of every block, and each then numbers its batches by itself. A task holds a
    block, two numbers a row, however large the shard.
    """
    keys = list(shard)
    n = F.col(length)
    fault = n.isNull() | ~(n > 0) | (F.lit(False) if alone else n > budget)
    message = F.concat(F.lit("a row of length "), F.coalesce(n.cast("string"), F.lit("null")), F.lit(f" cannot be in a batch of {budget}"))
    checked = rows.withColumn("_n", F.when(fault, F.raise_error(message).cast("long")).otherwise(n.cast("long")))
    numbered = ordered.numbered(checked, list(order), "_i", keys)
    shortest, last = numbered.agg(F.min("_n"), F.max("_i")).first()
    if shortest is None:
        return rows.withColumn("batch", F.lit(0).cast("long"))
    reach = budget // shortest + 1
    block = max(block, 2 * reach)
    parts = _blocks(numbered, keys, block, reach)

    def chained(frame: pd.DataFrame) -> tuple[int, int, np.ndarray]:
        """The first place of the block, how many rows are its own, and the next start of each of these, counted from there."""
        frame = frame.sort_values("_i")
        first, own = int(frame["_i"].iloc[0]), int((frame["_i"] // block == frame["_b"].iloc[0]).sum())
        return first, own, next_starts(frame["_n"].to_numpy(np.int64), budget, padded)[:own]

    def exits(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        first, own, after = chained(frame)
        out = after.tolist()
        for i in range(own - 1, -1, -1):
            if out[i] < own:
                out[i] = out[out[i]]
        some = min(own, reach)
        return pd.DataFrame({**dict(zip(keys, key, strict=False)), "_at": range(first, first + some), "_to": [first + x for x in out[:some]]})

    def starts(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        first, own, after = chained(frame)
        entry, marks = frame["_entry"].iloc[0], np.zeros(own, np.int64)
        at = own if pd.isna(entry) else int(entry) - first  # a last block may lie within the last batch
        while at < own:
            marks[at] = 1
            at = int(after[at])
        return pd.DataFrame({**dict(zip(keys, key, strict=False)), "_b": int(frame["_b"].iloc[0]), "_i": range(first, first + own), "_in": np.cumsum(marks)})

    blocks = int(last) // block + 1
    entered = numbered.where("_i = 0").select(*keys, F.col("_i").alias("_entry"))
    if blocks > 1:
        jumps = shared.cut(parts.groupBy(*keys, "_b").applyInPandas(exits, _types(rows, keys, "_at long, _to long")))
        entered = shared.cut(entered)
        for _ in range((blocks - 1).bit_length()):
            ahead = _by(entered, jumps, keys, "_entry", "_at").select(*keys, F.col("_to").alias("_entry"))
            entered = shared.cut(entered.unionByName(ahead).distinct())
            further = jumps.select(*keys, F.col("_at").alias("_mid"), F.col("_to").alias("_far"))
            jumps = shared.cut(_by(jumps, further, keys, "_to", "_mid").select(*keys, "_at", F.col("_far").alias("_to")))
    # the end of a shard is no entry of its last block
    entries = entered.groupBy(*keys, F.expr(f"_entry div {block}").alias("_block")).agg(F.min("_entry").alias("_entry"))
    met = _by(parts, entries, keys, "_b", "_block", "left").select(*keys, "_b", "_i", "_n", "_entry")
    counted = met.groupBy(*keys, "_b").applyInPandas(starts, _types(rows, keys, "_b long, _i long, _in long"))
    if blocks > 1:
        counted = shared.cut(counted)
        totals = counted.groupBy(*keys, "_b").agg(F.max("_in").alias("_starts"))
        upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(*keys, F.col("_b").alias("_block"), F.coalesce(F.sum("_starts").over(upto), F.lit(0)).alias("_before"))
        counted = _by(counted, before, keys, "_b", "_block").select(*keys, "_i", (F.col("_in") + F.col("_before")).alias("_in"))
    batch = counted.select(*keys, F.col("_i").alias("_place"), (F.col("_in") - 1).alias("batch"))
    return _by(numbered.drop("batch"), batch, keys, "_i", "_place").select(*[c for c in rows.columns if c != "batch"], "batch")


def _by(a: DataFrame, b: DataFrame, keys: Sequence[str], left: str, right: str, how: str = "inner") -> DataFrame:
    """The rows of ``a`` with what ``b`` adds where its keys, nulls among them, and the two columns agree."""
    other = b.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    same = F.col(left) == F.col(right)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return a.join(other, same, how).drop(*[f"_key{i}" for i in range(len(keys))])


def epoch_key(rows: DataFrame, key: str, seed: int, epoch: int, out: str = "epoch_key") -> DataFrame:
    """``rows`` with what orders them in an epoch: a hash of the key that changes with seed plus epoch."""
    return rows.withColumn(out, F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed + epoch}")).cast("binary")))


def epoch_order(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Rows in a fixed pseudo-random order of the epoch."""
    return epoch_key(rows, key, seed, epoch, "_key").orderBy("_key", key).drop("_key")


def resume(batches: DataFrame, cursor: int, column: str = "batch", epoch: int | None = None, at: str = "epoch") -> DataFrame:
    """The batches from the cursor on; with ``epoch`` the cursor counts in that one only and earlier epochs are done."""
    here = F.col(column) >= cursor
    return batches.where(here if epoch is None else (F.col(at) > epoch) | ((F.col(at) == epoch) & here))


def rotated(rows: DataFrame, n: int, cursor: int, chunk: int, repeats: int, mini: int, index: str = "idx") -> DataFrame:
    """Indexes rotated by the cursor, in whole chunks, each repeated, and each index ``mini`` times."""
    place = F.pmod(F.col(index) - cursor, F.lit(n))
    placed = rows.withColumn("place", place).where(F.col("place") < (n // chunk) * chunk)
    again = placed.withColumn("chunk", F.expr(f"cast(place div {chunk} as int)")).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return again.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(mini - 1))))


def cursor_of(start: int, step: int, accumulation: int, per_group: int, groups: int, n: int) -> int:
    return (start + step * accumulation // per_group * groups) % n


def whole_groups(rows: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Rows numbered in order with their group, without an incomplete last group."""
    numbered = ordered.numbered(rows, order)
    total = rows.agg(F.count("*").alias("_total"))
    whole = numbered.join(F.broadcast(total), F.expr(f"position < _total div {size} * {size}")).drop("_total")
    return whole.withColumn("group_index", F.expr(f"position div {size}"))


def padding_saved(batches: DataFrame, by: Sequence[str], length: str) -> DataFrame:
    return batches.groupBy(*by).agg(
        F.count("*").alias("rows"), F.max(length).alias("longest"), F.sum(length).alias("tokens"), (F.count("*") * F.max(length) - F.sum(length)).alias("padding")
    )


def flatten(rows: DataFrame, by: Sequence[str], order: str, length: str) -> DataFrame:
    """Where each row starts and ends in its batch, or among all rows, when rows are laid end to end."""
    if by:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        ended = rows.withColumn("ends", F.sum(length).over(w))
    else:
        ended = ordered.running(rows, [order], F.col(length), "ends")
    return ended.withColumn("starts", F.col("ends") - F.col(length))
