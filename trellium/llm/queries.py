"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.llm import (
    decontamination,
    embedding_dedup,
    jaccard_join,
    line_dedup,
    mixing,
    packing,
    pii,
    secret_scan,
    sharding,
    spans,
    spelling,
    toxicity,
    url_filter,
    whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold() -> Column:
    """crc32 of doc_id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "listed")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("_words"))
    mixed = mixing.mix(sized, size=F.col("_words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    marked = docs.select(
        "doc_id", crc.alias("text_crc32"), sharding.digest(F.col("text")).alias("_digest"), sharding.weight(F.col("text")).alias("_bytes")
    )
    placed = sharding.place(marked, F.col("_digest"), F.col("_bytes"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _digest_of(base: Column) -> Column:
    return F.sha2(base.cast("binary"), 256)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = secret_scan.scan(docs, F.concat_ws("/", "source", "lang"), F.col("source"))
    base = F.filter("spans", lambda x: x["ord"] < len(secret_scan.BASE))

    def labelled(name: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["label"] == name)).cast("long").alias(f"n_{name}")

    return found.select(
        "doc_id",
        *[spans.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in secret_scan.BASE],
        _digest_of(spans.listing(base)).alias("base_sha256"),
        spans.listing(F.col("spans")).alias("spans"),
        *[labelled(name) for name in ("live", "shared", "example")],
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold() != 0)
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(fold() == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id", "n_lines", F.size("removed").alias("n_removed"), F.sha2(F.col("clean").cast("binary"), 256).alias("clean_sha256")
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["ord"] < len(pii.BASE))
    return found.select(
        "doc_id",
        *[spans.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in pii.BASE],
        _digest_of(spans.listing(base)).alias("base_sha256"),
        spans.listing(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["score"] >= 0.5)).cast("long").alias("n_confident"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.join(docs, jaccard_join.Rule(4, 85, 100)).select("doc_id", "n_shingles", "component_id")


def op10_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 with the number of links, which the SQL of op10_jaccard_join does not have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = jaccard_join.join(docs, jaccard_join.Rule(4, 85, 100), count=True)
    return found.select("doc_id", "n_shingles", "n_links", "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return whitened.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


#: A run whose checksum this divides loses a letter.
MISSPELT = 199


def misspelt(doc_id: Column, run: Column) -> Column:
    """The run, or what is left of it without one letter, by the checksum of document and run."""
    checksum = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (checksum % F.length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(checksum % MISSPELT == 0, less).otherwise(run)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = runs.select(misspelt(F.col("doc_id"), F.col("run")).alias("word"))
    return spelling.group(spelling.vocabulary(words))


def op13_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """``tokenizer``: the path of a byte-level vocabulary; without it the installed one of 50,000 tokens."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, tokenizer).select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        op1_url_filter, op2_mixing, op3_sharding, op4_secret_scan, op5_toxicity, op6_embedding_dedup,
        op7_line_dedup, op8_decontamination, op9_pii, op10_jaccard_join, op10_jaccard_links, op11_whitening, op12_spelling, op13_packing, pipeline,
    )
    return {f.__name__: f for f in each}
