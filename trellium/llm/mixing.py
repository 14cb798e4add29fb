"""Mixing sources to target weights along a time-varying curriculum.

Method. Each source has a weight and a schedule, a piecewise linear factor over training
time 0 to 1. The integral of weight times factor is the source's demand; demands share
all words of the corpus, a source stops at ``max_epochs`` times its size, and what it
cannot take is shared again by weight until no source is above its cap. A source's
documents are laid end to end in a fixed pseudo-random order (by the MD5 of doc_id), as
often as its target asks; the first word of a copy lies at a cumulative demand, whose
inverse under the integrated schedule is the copy's training position in 0 to 1. The
result is range-sorted by position.

Scale. Offsets inside a source come from sums of cells (the first hexadecimal digits of
the MD5, three or as many more as keep a cell of the whole table at ``CELL_ROWS`` rows)
and a running sum inside a cell, so a source with a third of all rows is thousands of
window groups and not one. Sums are combined before the shuffle; the per-source plan is
one row a source. Only the number of rows reaches the driver.

Defined results. Size is the number of words; a text that is null or has none has size 0
and is taken 0 times. A null source is a source of its own and comes last. Repeated rows
are documents of their own; rows of equal doc_id and size are interchangeable. Rows
without doc_id are placed by a hash of their columns. Empty tables give empty results.
Extra columns are kept, whatever their names; only those named like the added ones are
replaced, and ``emit`` keeps these too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from trellium.llm import rows

MAX_EPOCHS = 3
#: Rows of a cell, beyond which cells are made finer.
CELL_ROWS = 1 << 17
#: Weights by rank of the source, repeating, and each one's schedule as (time, factor).
WEIGHTS = (1, 2, 3)
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (1.0, 1.5)),
)
ADDED = ("size", "source_size", "target", "taken", "position")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def integrate(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(start time, factor, slope, area before) of each segment, scaled to area 1 in all."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False))
    out, before = [], 0.0
    for a, b in zip(schedule, schedule[1:], strict=False):
        out.append((a[0], a[1] / area, (b[1] - a[1]) / (b[0] - a[0]) / area, before))
        before += (b[0] - a[0]) * (a[1] + b[1]) / 2 / area
    return out


def invert(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time by which ``share`` of the schedule's area has passed."""
    out = None
    for time, factor, slope, before in integrate(schedule):
        rest = share - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(factor * factor) + F.lit(2 * slope) * rest, F.lit(0.0)))
        at = F.lit(time) + F.lit(2.0) * rest / (F.lit(factor) + root)
        out = at if out is None else F.when(share >= F.lit(before), at).otherwise(out)
    return out


def source_plan(sizes: DataFrame, max_epochs: int, weights: Sequence[int]) -> DataFrame:
    """_s, _n, _rank, source_size, target, one row a source; ``sizes`` has _s, _n, source_size."""
    by_name = Window.orderBy("_n", "_s")
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("_rank") % len(weights) + 1)
    capped = ranked.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * max_epochs)
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        capped.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_all", F.sum("_w").over(everything))
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_ws", F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_left", (F.col("_total") - F.col("_caps")).cast("double"))
        .withColumn("_open", (F.col("_all") - F.col("_ws")).cast("double"))
        .withColumn("_fits", F.col("_left") * F.col("_w") / F.col("_open") <= F.col("_cap"))
    )
    first = F.struct(F.col("_cap") / F.col("_w"), "_rank", "_left", "_open")
    chosen = level.withColumn("_at", F.min(F.when(F.col("_fits"), first)).over(everything))
    share = F.col("_at._left") * F.col("_w") / F.col("_at._open")
    under = F.struct(F.col("_cap") / F.col("_w"), F.col("_rank")) < F.struct(F.col("_at.col1"), F.col("_at._rank"))
    return chosen.select(
        "_s", "_n", "_rank", "source_size", F.when(under, F.col("_cap").cast("double")).otherwise(share).alias("target")
    )


def _key(docs: DataFrame) -> Column:
    """What orders a source: the MD5 of doc_id, or of the other columns' hash where that is null."""
    plain = [rows.named(f.name) for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\x01"), F.xxhash64(*plain).cast("string"))).cast("binary"))


def place(
    docs: DataFrame,
    size: Column | None = None,
    max_epochs: int = MAX_EPOCHS,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    replaced: Sequence[str] = ADDED,
) -> DataFrame:
    """``row``, the columns of ``docs`` but those replaced, and beside it doc_id, ADDED, ``before`` and ``rank``, unsorted.

    ``docs`` has doc_id, source, and text or a given size. ``taken`` counts the words that
    the mix takes from the document, whole passes over the source first and then its order
    up to the target, the last document in part. ``position`` is that of the first copy,
    null where nothing is taken.
    """
    size = word_count(F.col("text")) if size is None else size
    digits = 3
    count = docs.count()
    while count > CELL_ROWS * 16**digits:
        digits += 1
    source = {"_s": F.coalesce("source", F.lit("")), "_n": F.col("source").isNull()}
    keyed = rows.carry(docs, replaced, doc_id=F.col("doc_id"), size=size, _key=_key(docs), **source)
    keyed = keyed.withColumn("_cell", F.substring("_key", 1, digits))
    cells = keyed.groupBy("_s", "_n", "_cell").agg(F.sum("size").alias("_sum"))
    plan = source_plan(cells.groupBy("_s", "_n").agg(F.sum("_sum").alias("source_size")), max_epochs, weights)
    inside = Window.partitionBy("_s", "_n").orderBy("_cell")
    starts = cells.withColumn("_start", F.sum("_sum").over(inside) - F.col("_sum")).drop("_sum")
    # the window below needs rows where the join has put them: no second exchange
    joined = keyed.join(starts.join(plan, ["_s", "_n"]), ["_s", "_n", "_cell"])
    order = Window.partitionBy("_s", "_n", "_cell").orderBy("_key", "doc_id", "size")
    offset = joined.withColumn("_before", F.col("_start") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    part = F.floor(F.col("target") - (F.col("_passes") * F.col("source_size")).cast("double") + F.lit(0.5)).cast("long")
    taken = F.col("_passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_part") - F.col("_before")))
    at = _time(F.col("_before").cast("double") / F.col("target"), F.col("_rank"), schedules)
    return (
        offset.withColumn("_passes", passes)
        .withColumn("_part", part)
        .withColumn("taken", taken)
        .withColumn("position", F.when(F.col("taken") > 0, F.round(at, 9)))
        .select("row", "doc_id", *ADDED, F.col("_before").alias("before"), F.col("_rank").alias("rank"))
    )


def _time(share: Column, rank: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """The training time of a share of its source's demand, by the source's own schedule."""
    at = invert(share, schedules[0])
    for k in range(1, len(schedules)):
        at = F.when(rank % len(schedules) == k, invert(share, schedules[k])).otherwise(at)
    return at


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document with ADDED, range-sorted by training position, untaken ones last."""
    ordered = place(docs, **options).orderBy(F.col("position").asc_nulls_last(), "doc_id")
    return ordered.select(*rows.restore(rows.kept(docs, ADDED)), *ADDED)


def emit(docs: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, a row per whole copy, sorted by position.

    A copy that the target cuts is emitted whole if half of its words or more are taken.
    """
    placed = place(docs, schedules=schedules, replaced=(), **options)
    copies = F.expr("cast(taken div size + if(2 * (taken % size) >= size, 1, 0) as int)")
    repeated = placed.where("taken > 0").withColumn("copies", copies).where("copies > 0").withColumn(
        "copy", F.explode(F.expr("sequence(0, copies - 1)"))
    )
    share = F.least((F.col("copy") * F.col("source_size") + F.col("before")).cast("double") / F.col("target"), F.lit(1.0))
    ordered = repeated.withColumn("at", _time(share, F.col("rank"), schedules)).orderBy("at", "doc_id", "copy")
    return ordered.select(*rows.restore(docs.columns))
