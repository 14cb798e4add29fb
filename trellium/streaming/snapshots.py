"""Streams from landing folders: metric snapshots as they arrive, and records appended as tasks finish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from trellium.operators import evaluation
from trellium.sources import files

#: How often metrics are scraped and rules are evaluated.
SCRAPE, EVALUATE = "5 seconds", "15 seconds"


def snapshots(spark: SparkSession, folder: str, glob: str = "*.prom") -> DataFrame:
    """A stream of name, labels, number, prefix and run of the metric files ``<prefix>-after-run-<n>.prom`` that land in a folder."""
    lines = spark.readStream.option("pathGlobFilter", glob).text(folder).withColumn("path", F.col("_metadata.file_path"))
    named = r"([^/]*)-after-run-(\d+)\.prom$"
    keyed = lines.select("value", F.regexp_extract("path", named, 1).alias("prefix"), F.regexp_extract("path", named, 2).try_cast("int").alias("run"))
    return files.metric_samples(keyed, keep=("prefix", "run"))


def start(stream: DataFrame, path: str, checkpoint: str, every: str | None = SCRAPE) -> StreamingQuery:
    """Appends a stream to Parquet, a micro-batch each ``every``; None takes what is there and stops."""
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def evaluated(finished: DataFrame, records: str, checkpoint: str, every: str | None = EVALUATE) -> StreamingQuery:
    """Appends the record of every finished task as it arrives, one folder a micro-batch, so a batch that is run again replaces itself."""

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{records}/batch={number}")

    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return finished.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def summary(spark: SparkSession, records: str) -> DataFrame:
    """The category metrics of all records appended so far."""
    return evaluation.category_metrics(spark.read.parquet(records))
