"""Counters, gauges and histograms over time windows; the same functions serve batch and streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.operators import ordered


def counter_increases(samples: DataFrame, series: Sequence[str], at: str | Sequence[str], value: str) -> DataFrame:
    """What each sample adds to its series; after a reset the whole value (batch form)."""
    found = ordered.previous(samples, [at] if isinstance(at, str) else at, value, "_last", series)
    before = F.col("_last")
    added = F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return found.withColumn("increase", added).drop("_last")


def stream_increases(samples: DataFrame, series: str, at: str, value: str) -> DataFrame:
    """The streaming form: the last value of each series is state. A micro-batch is put in time order per series."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        added = []
        part = pd.concat(list(parts), ignore_index=True).sort_values(at, kind="stable")
        for x in part[value].tolist():
            added.append(0.0 if last is None else (x if x < last else x - last))
            last = x
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({series: [key[0]] * len(part), at: part[at], "increase": added})

    return samples.groupBy(series).applyInPandasWithState(
        step, f"{series} {dict(samples.dtypes)[series]}, {at} timestamp, increase double", "last double", "append", "NoTimeout"
    )


def windowed_rate(increases: DataFrame, at: str, width: str, seconds: float, by: Sequence[str] = ()) -> DataFrame:
    grouped = increases.groupBy(F.window(at, width).alias("w"), *by).agg(F.sum("increase").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), *by, F.round(F.col("total") / seconds, 9).alias("rate"))


def windowed_gauge(samples: DataFrame, at: str, width: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    grouped = samples.groupBy(F.window(at, width).alias("w"), *by).agg(
        F.round(F.sum(value), 4).alias("total"), F.max(value).alias("peak"), F.count("*").alias("n")
    )
    return grouped.select(F.col("w.start").alias("start"), *by, "total", "peak", "n")


def histogram_quantile(buckets: DataFrame, by: Sequence[str], le: str, count: str, q: float) -> DataFrame:
    """Linear interpolation inside the first cumulative bucket that reaches q of the total.

    ``count`` is cumulative by ``le``; a quantile in the infinite bucket is the last finite
    bound. The buckets of a group, a handful, are one array, so this runs on streams too.
    """
    listed = buckets.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(le).alias("le"), F.col(count).alias("c")))).alias("_b"), (F.max(count) * F.lit(q)).alias("_want"))
    before = lambda i: F.get("_b", i - 1)
    marked = F.transform(
        "_b", lambda x, i: F.struct(x["le"].alias("le"), x["c"].alias("c"), F.coalesce(before(i)["c"], F.lit(0)).alias("prior"), F.coalesce(before(i)["le"], F.lit(0.0)).alias("bound"))
    )
    first = listed.withColumn("_x", F.get(F.filter(marked, lambda x: (x["c"] >= F.col("_want")) & (x["prior"] < F.col("_want"))), 0)).where("_x is not null")
    inside = F.col("_x.bound") + (F.col("_x.le") - F.col("_x.bound")) * (F.col("_want") - F.col("_x.prior")) / (F.col("_x.c") - F.col("_x.prior"))
    return first.select(*by, F.round(F.when(F.col("_x.le") == float("inf"), F.col("_x.bound")).otherwise(inside), 6).alias("quantile"))


def rate_ratio(hits: DataFrame, queries: DataFrame, keys: Sequence[str] = ("start",)) -> DataFrame:
    """The share of one rate in another (columns ``rate``), window by window; null where the other is 0 or absent."""
    a, b = hits.withColumnRenamed("rate", "_hits"), queries.withColumnRenamed("rate", "_queries")
    return b.join(a, list(keys), "left").select(*keys, F.round(F.try_divide(F.coalesce("_hits", F.lit(0.0)), "_queries"), 6).alias("ratio"))


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Session windows per key, for streams with a watermark."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )


def replay(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a bounded stream yields, run to its end into memory; for tests and small replays."""
    # a stream with processing-time timers asks for batches without data for ever
    key, conf = "spark.sql.streaming.noDataMicroBatches.enabled", df.sparkSession.conf
    before = conf.get(key)
    if "ProcessingTimeTimeout" in df._jdf.queryExecution().logical().toString():
        conf.set(key, "false")
    try:
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(key, before)
    return df.sparkSession.table(name)
