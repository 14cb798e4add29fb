"""Running values along an order, of all rows or by key, without a task that holds a whole group.

Groups of up to ``SMALL`` rows, which one count tells, are plain windows. Larger ones are
dealt by ranges of the order into a written table; the partition number is the range, so
what lies before a range is known from one row per range and key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellium.sources import shared

SMALL, RANGES = 1_000_000, 64


def _dealt(rows: DataFrame, order: Sequence[str], by: Sequence[str]) -> DataFrame | None:
    """``rows`` with ``_range``, the range of order keys that a row is in, equal keys in one range; none where every group is small."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    if (largest or 0) <= SMALL:
        return None
    ranges = max(RANGES, -(-total // SMALL))
    return shared.cut(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))


def _carried(ranged: DataFrame, by: Sequence[str], inside: Column, ahead: Column) -> DataFrame:
    """by, _range, _before: what the ranges ahead of each range of a key amount to; one row a range and key."""
    return ranged.groupBy(*by, "_range").agg(inside.alias("_part")).select(*by, "_range", ahead.alias("_before"))


def _met(ranged: DataFrame, carried: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:  # a row a range
        return ranged.join(F.broadcast(carried), "_range")
    keys = [f"_by{i}" for i in range(len(by))]
    sides = carried.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col("_range").alias("_at"), "_before")
    same = F.col("_range") == F.col("_at")
    for c, k in zip(by, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    return ranged.join(sides, same).drop(*keys, "_at")


def _along(by: Sequence[str], order: Sequence[str], last: int) -> Column:
    """The window of the rows up to ``last`` places from the row."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)


def running(rows: DataFrame, order: Sequence[str], value: Column, out: str, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``out``, the sum of ``value`` up to and including the row, by key.

    Rows with equal keys come in any order.
    """
    valued = rows.withColumn("_value", value)
    sums = lambda keys: F.coalesce(F.sum("_value").over(_along(keys, order, 0)), F.lit(0))
    ranged = _dealt(valued, order, by)
    if ranged is None:
        return valued.withColumn(out, sums(by)).drop("_value")
    before = _carried(ranged, by, F.sum("_value"), F.coalesce(F.sum("_part").over(_along(by, ["_range"], -1)), F.lit(0)))
    return _met(ranged, before, by).withColumn(out, F.col("_before") + sums([*by, "_range"])).drop("_range", "_value", "_before")


def largest_before(rows: DataFrame, order: Sequence[str], value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``out``, the largest ``value`` of the rows before the row, by key; null for none."""
    most = lambda keys: F.max(value).over(_along(keys, order, -1))
    ranged = _dealt(rows, order, by)
    if ranged is None:
        return rows.withColumn(out, most(by))
    before = _carried(ranged, by, F.max(value), F.max("_part").over(_along(by, ["_range"], -1)))
    return _met(ranged, before, by).withColumn(out, F.greatest("_before", most([*by, "_range"]))).drop("_range", "_before")


def previous(rows: DataFrame, order: Sequence[str], value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``out``, the ``value`` of the row before, by key; null for the first."""
    ranged = _dealt(rows, order, by)
    if ranged is None:
        return rows.withColumn(out, F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))
    before = _carried(ranged, by, last, F.lag("_part").over(Window.partitionBy(*by).orderBy("_range")))
    here = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(*by, "_range").orderBy(*order))
    return _met(ranged, before, by).withColumn(out, F.coalesce(here, "_before")["v"]).drop("_range", "_before")


def numbered(rows: DataFrame, order: Sequence[str], out: str = "position", by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with their place in the order, from 0, by key."""
    return running(rows, order, F.lit(1).cast("long"), out, by).withColumn(out, F.col(out) - 1)


#: Beyond so many values in a group a quantile is looked for in a bracket only, this wide in share of the rows on each side.
WHOLE, BRACKET, ACCURACY = 1_000_000, 0.001, 10_000


def ranked_value(df: DataFrame, by: Sequence[str], value: str, q: float, rank: Column) -> DataFrame:
    """by, p: the ``rank``-th smallest value of each group, exact; ``rank`` is made of the count ``n`` and lies near q * n.

    Where all groups are small, which one count tells, they are ranked as they are. Else an
    approximate quantile, whose error is bounded, brackets the value; what lies below the
    bracket is only counted, and the distinct values inside it are counted and ranked. So a
    group of any size is combined where it lies, and its window sees a few thousandths of it.
    """
    some = df.where(F.col(value).isNotNull())
    largest = some.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) <= WHOLE:
        group = Window.partitionBy(*by)
        placed = some.select(*by, F.col(value).alias("p"), F.row_number().over(group.orderBy(value)).alias("_at"), F.count("*").over(group).alias("n"))
        return placed.where(F.col("_at") == rank).select(*by, "p")
    spots = F.array(F.lit(max(0.0, q - BRACKET)), F.lit(min(1.0, q + BRACKET)))
    stats = some.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(value).alias("_least"), F.max(value).alias("_most"), F.percentile_approx(value, spots, ACCURACY).alias("_b")
    )
    small = F.col("n") < WHOLE
    bracket = stats.select(*by, "n", F.when(small, F.col("_least")).otherwise(F.col("_b")[0]).alias("_low"), F.when(small, F.col("_most")).otherwise(F.col("_b")[1]).alias("_high"))
    here = F.lit(True)
    placed = some.select(*by, F.col(value).alias("_v")).alias("s")
    for c in by:
        here = here & F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}"))
    met = placed.join(bracket.alias("b"), here & (F.col("s._v") <= F.col("b._high"))).select(*[F.col(f"s.{c}") for c in by], "s._v", "b.n", "b._low")
    counted = met.groupBy(*by, "n", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.withColumn("_to", F.sum("_c").over(upto)).withColumn("_rank", rank)
    return summed.where((F.col("_to") >= F.col("_rank")) & (F.col("_to") - F.col("_c") < F.col("_rank"))).select(*by, F.col("_v").alias("p"))
