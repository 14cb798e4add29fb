"""Token ids of a vocabulary file with the characters that each covers, and the loss mask that follows from spans of text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trellium.functions.arrays import IGNORED

ENCODED = "struct<ids:array<int>,starts:array<int>,ends:array<int>>"


def encoded(text: Column, path: str) -> Column:
    """ids, starts, ends: the tokens of a text by the vocabulary at ``path`` on the workers, and their code points, end exclusive.

    Text is split by ranked merges, without special tokens; a null text has none. Batches
    cross by Arrow, and a worker reads the file once a task.
    """

    def run(parts):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for texts in parts:
            said = [t or "" for t in texts]
            found = tokenizer.encode_batch(said, add_special_tokens=False)
            yield pd.DataFrame({
                "ids": [x.ids for x in found], "starts": [[a for a, _ in x.offsets] for x in found], "ends": [[b for _, b in x.offsets] for x in found],
            })

    from collections.abc import Iterator

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, ENCODED)(text)


def laid_out(messages: Column, supervised: str = "assistant", opening: str = "<|im_start|>", closing: str = "<|im_end|>\n") -> Column:
    """struct<text, spans: array<struct<start, end>>> of messages (role, content): their text between marks, and where the supervised ones stand, marks and role included."""

    def shown(m: Column) -> Column:
        whole = F.concat(F.lit(opening), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(closing))
        return F.struct(whole.alias("text"), (m["role"] == supervised).alias("own"))

    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(0).alias("at"))

    def add(held: Column, part: Column) -> Column:
        ends = held["at"] + F.length(part["text"])
        span = F.when(part["own"], F.array(F.struct(held["at"].alias("start"), ends.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct(F.concat(held["text"], part["text"]).alias("text"), F.concat(held["spans"], span).alias("spans"), ends.alias("at"))

    return F.aggregate(F.transform(messages, shown), start, add, lambda held: F.struct(held["text"], held["spans"]))


def labels(tokens: Column, spans: Column) -> Column:
    """The ids where a token has a character of some span, else the ignored label. ``tokens``: ids, starts, ends; ``spans``: start, end."""
    places = F.arrays_zip(tokens["ids"].alias("id"), tokens["starts"].alias("a"), tokens["ends"].alias("b"))
    return F.transform(places, lambda t: F.when(F.exists(spans, lambda s: (s["start"] < t["b"]) & (t["a"] < s["end"])), t["id"]).otherwise(IGNORED))
