"""Adaptive execution splits what a hot window or value brings to one partition."""

import pytest
from pyspark.sql import functions as F

from trellium.llm import line_dedup, secret_scan

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def split_early(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def is_split(df):
    df.collect()
    return "skew=true" in df._jdf.queryExecution().toString()


def test_a_hot_passage_is_split(spark, split_early):
    text = F.when(F.col("id") % 3 == 0, "one\ntwo\nthree").otherwise(F.concat(F.lit("a"), "id", F.lit("\nb\nc")))
    assert is_split(line_dedup.later_places(spark.range(30000).select(F.col("id").alias("doc_id"), text.alias("text"))))


def test_a_hot_secret_is_split(spark, split_early):
    value = F.when(F.col("id") % 3 == 0, "aB3dE6gH9jK2mN5pQ8sT1vW4").otherwise(F.md5(F.col("id").cast("string")))
    docs = spark.range(60000).select(F.col("id").alias("doc_id"), F.concat(F.lit("token = "), value).alias("text"), F.lit("s").alias("source"))
    assert is_split(secret_scan.scan(docs, F.col("source"), F.col("source")))
