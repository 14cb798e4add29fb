"""A training corpus from ``documents``: five stages, each a whole operator of the library.

Every stage reads what the one before has written, so a stage never recomputes another
and a lost executor costs no more than its tasks. All stages but the last return the
columns of ``documents``; the last adds size, shard and slot.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.llm import decontamination, jaccard_join, mixing, scratch, sharding, toxicity

#: Near copies: five-word shingles, Jaccard similarity of 0.8 or more.
NEAR = jaccard_join.Rule(5, 80, 100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the sentence model, trained on the labels' training fold, rejects."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(fold != 0)
    model = toxicity.train(docs, labels)
    return toxicity.remove(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near copies."""
    return jaccard_join.keep_one(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by target weights, a row per copy, sorted by training position."""
    return mixing.emit(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its size, shard and slot."""
    return sharding.assign(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The toxicity model is trained; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = f"{scratch.root(spark)}/stage-{name}-{uuid.uuid4().hex}"
        with scratch.scope():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            before.drop()
        docs = spark.read.parquet(path)
        before = scratch.Stored(spark, path, docs)
    return docs
