"""Sharding by minimax contiguous partition over ordered atomic groups.

Method. Rows of one group (equal texts) stay together. Groups are ordered by the SHA-256
of their text, and their weights become a running sum. The smallest capacity at which a
greedy pass needs no more than the given number of shards is found by a search that
tries several capacities at a time: a greedy jump is the largest running sum not above
the last cut plus the capacity, one aggregate per capacity in one job per jump. The
shards are cut where the greedy pass with that capacity ends.

Scale. The running sum is made of the sums of cells of digests (three hexadecimal digits,
or as many more as keep a cell at ``CELL_ROWS`` rows) and a window inside a cell, so no
task sees all groups. The table of running sums is written once, in the
shared folder; jumps read only the row groups near their target, by pushed-down bounds.
A document finds its shard by comparing its digest with at most ``shards - 1`` cut
digests: no join, no shuffle of texts. Slots come from the counts of (shard, cell of
doc_id) and a row number inside one.

Defined results. A null text weighs 1 and belongs to the group of the empty text. Fewer
groups than shards leave the last shards empty. Repeated rows are rows of their own.
A group larger than its share makes its shard larger, as it must not be split. Extra
columns are kept, whatever their names; only those named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellium.llm import rows, scratch
from trellium.llm.scratch import store

SHARDS = 8
PROBES = 24
#: Rows of a cell, beyond which cells are made finer.
CELL_ROWS = 1 << 17
ADDED = ("size", "shard", "slot")


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def digest(text: Column) -> Column:
    return F.sha2(_text(text).cast("binary"), 256)


def weight(text: Column) -> Column:
    """UTF-8 bytes plus 1."""
    return F.octet_length(_text(text)).cast("long") + 1


def running_sums(groups: DataFrame, digits: int = 3) -> DataFrame:
    """_group, p: the sum of weights up to and with the group, in order of _group."""
    celled = groups.withColumn("_cell", F.substring("_group", 1, digits))
    cells = celled.groupBy("_cell").agg(F.sum("_weight").alias("_sum"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("_cell", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_cell").orderBy("_group").rowsBetween(Window.unboundedPreceding, 0)
    return celled.join(starts, "_cell").select(
        "_group", "_weight", (F.col("_start") + F.sum("_weight").over(inside)).alias("p")
    )


def _jump(sums: DataFrame, targets: list[int], largest: int) -> list[int | None]:
    """For each target the largest running sum that is not above it."""
    near = sums.where((F.col("p") <= max(targets)) & (F.col("p") > min(targets) - largest))
    row = near.agg(*[F.max(F.when(F.col("p") <= x, F.col("p"))).alias(f"j{i}") for i, x in enumerate(targets)]).first()
    return list(row)


def _greedy(sums: DataFrame, capacities: list[int], shards: int, total: int, largest: int) -> list[list[int]]:
    """The ends of the first ``shards - 1`` shards under each capacity."""
    ends: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards - 1):
        targets = [(e[-1] if e else 0) + c for e, c in zip(ends, capacities, strict=True)]
        if min(targets) >= total:
            found: list[int | None] = [total] * len(targets)
        else:
            found = _jump(sums, targets, largest)
        for e, x in zip(ends, found, strict=True):
            e.append(x if x is not None else (e[-1] if e else 0))
    return ends


def minimax_cuts(sums: DataFrame, shards: int = SHARDS, probes: int = PROBES) -> tuple[int, list[int]]:
    """The smallest feasible capacity and where each shard but the last ends, as running sums."""
    total, largest = sums.agg(F.max("p"), F.max("_weight")).first()
    if total is None:
        return 0, [0] * (shards - 1)
    low = max(-(-total // shards), largest)
    high = low + largest
    best: tuple[int, list[int]] | None = None
    while best is None or low < high:
        step = max(1, -(-(high - low) // (probes + 1)))
        tried = sorted({*range(low, high, step), high} if best is None else {*range(low, high, step)})
        ends = _greedy(sums, tried, shards, total, largest)
        fits = [total - e[-1] <= c for e, c in zip(ends, tried, strict=True)] if shards > 1 else [c >= total for c in tried]
        k = next((i for i, ok in enumerate(fits) if ok), None)
        if k is None:
            low = tried[-1] + 1
        else:
            best = tried[k], ends[k]
            high = tried[k]
            low = tried[k - 1] + 1 if k else high
    return best


@scratch.tidy
def place(docs: DataFrame, group: Column, size: Column, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot``; rows of equal ``group`` digest share a shard."""
    marked = rows.carry(docs, ADDED, doc_id=F.col("doc_id"), _group=group, _weight=size)
    groups = store(marked.groupBy("_group").agg(F.sum("_weight").alias("_weight"), F.count("*").alias("_rows")), "groups")
    count = groups.df.agg(F.sum("_rows")).first()[0] or 0
    digits = 3
    while count > CELL_ROWS * 16**digits:
        digits += 1
    sums = store(running_sums(groups.df.drop("_rows"), digits), "shard-sums")
    groups.drop()
    _, ends = minimax_cuts(sums.df, shards)
    cut = {r["p"]: r["g"] for r in sums.df.where(F.col("p").isin(ends)).groupBy("p").agg(F.max("_group").alias("g")).collect()}
    sums.drop()
    shard = F.lit(0)
    for end in ends:
        # a shard that ends at 0 is empty: every group lies behind it
        shard = shard + (F.when(F.col("_group") > cut[end], 1).otherwise(0) if end in cut else F.lit(1))
    key = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("_group")).cast("binary"))
    placed = marked.withColumn("shard", shard.cast("int")).withColumn("_key", key).withColumn("_cell", F.substring("_key", 1, digits))
    counts = placed.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("shard", "_cell").orderBy("_key")
    slotted = placed.join(starts, ["shard", "_cell"]).withColumn("slot", (F.col("_start") + F.row_number().over(order) - 1).cast("long"))
    return slotted.select(*rows.restore(rows.kept(docs, ADDED)), F.col("_weight").alias("size"), "shard", "slot")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot``; rows of equal text share a shard."""
    return place(docs, digest(F.col("text")), weight(F.col("text")), shards)
