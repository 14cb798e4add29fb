"""Labels of rendered conversations against a brute-force alignment, character by character."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trellium.functions import subwords

PATH = public_tokenizers.path("byte_bpe_50k.json")


def aligned(messages):
    """Text, ids and labels: each character knows whether the assistant said it, and a token is kept if one of its characters is."""
    text, own = "", []
    for role, content in messages:
        turn = f"<|im_start|>{role}\n{content or ''}<|im_end|>\n"
        text += turn
        own += [role == "assistant"] * len(turn)
    found = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False)
    return text, found.ids, [i if any(own[a:b]) else -100 for i, (a, b) in zip(found.ids, found.offsets, strict=True)]


def labelled(df):
    laid = df.withColumn("l", subwords.laid_out(F.col("messages"))).withColumn("t", subwords.encoded(F.col("l.text"), PATH))
    return laid.select("k", F.col("l.text").alias("text"), F.col("t.ids").alias("ids"), subwords.labels(F.col("t"), F.col("l.spans")).alias("labels"))


def test_labels_of_conversations(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    said = turns.groupBy(F.col("conv_id").alias("k")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    want = {r["k"]: aligned([(m["role"], m["content"]) for m in r["messages"]]) for r in said.collect()}
    got = {r["k"]: (r["text"], r["ids"], r["labels"]) for r in labelled(said).collect()}
    assert got == want and any(x != -100 for _, _, labels in got.values() for x in labels)


@pytest.mark.parametrize("messages", [[], [("user", None)], [("assistant", "ß中😀 naïve"), ("user", "ß"), ("assistant", "")], [("assistant", None)]])
def test_labels_of_odd_messages(spark, messages):
    df = spark.createDataFrame([(1, messages)], "k int, messages array<struct<role:string,content:string>>")
    r = labelled(df).first()
    assert (r["text"], r["ids"], r["labels"]) == aligned(messages)
