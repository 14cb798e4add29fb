"""Whitening, spelling variants and packing: brute force, odd rows, and trees of several levels."""

import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trellium.llm import packing, queries, spelling, whitening

PATH = public_tokenizers.path("byte_bpe_50k.json")


# whitening


def whitened_by_hand(vectors, k):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return n, [sum(int(d) ** 2 for d in row) for row in n * x - sums], (x - sums / n) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening_is_that_of_the_whole_table(spark, sf):
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    valid = {k: v for k, v in table.items() if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    ids = sorted(valid)
    n, deviation, z, explained = whitened_by_hand([valid[i] for i in ids], 16)
    got = {(r["vec_id"], r["component"]): r for r in queries.op11_whitening(spark, sf).collect()}
    assert len(got) == 16 * len(ids)
    signs = [math.copysign(1, got[ids[0], c + 1]["whitened"] * z[0, c]) for c in range(16)]
    for i, v in enumerate(ids):
        for c in range(16):
            r = got[v, c + 1]
            assert (r["n"], r["deviation"]) == (n, deviation[i]) and r["identity_error"] < 1e-9
            assert math.isclose(r["whitened"], signs[c] * z[i, c], rel_tol=1e-6, abs_tol=1e-6) and math.isclose(r["explained"], explained[c], rel_tol=1e-9)


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [1.0, inf]), (6, [1.0]), (7, [0.5, -1.0]), (7, [0.5, -1.0]), (None, [1e300, 0.0]), (9, [])]
    clash = {c: F.lit("clash") for c in ("row", "y", "v", "z", "at", "n", "deviation", "my col")}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(clash)
    got = whitening.whiten(df).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 2, 6: 2, 7: 4, None: 2, 9: 2}
    assert {r["n"] for r in got} == {5} and all(r["row"] == r["y"] == r["my col"] == "clash" for r in got)
    # the large entry counts as 2^31, whose squares no long holds
    assert all((r["deviation"] is None) == (r["vec_id"] is None) or r["deviation"] > 0 for r in got)
    assert whitening.whiten(df.where("vec_id < 0")).collect() == []
    assert whitening.whiten(df.where("vec_id in (2, 9)")).collect() == []
    alone = whitening.whiten(df.where("vec_id = 7")).collect()
    assert len(alone) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in alone)


def test_whitening_leaves_out_components_without_variance(spark):
    rng = random.Random(3)
    rows = [(i, [a := rng.uniform(-9, 9), a, rng.uniform(-1, 1)]) for i in range(200)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got)
    assert got[0]["identity_error"] < 1e-9 and abs(sum(r["explained"] for r in got if r["vec_id"] == 0) - 1) < 1e-12


def test_deviations_are_exact_or_null():
    big = np.array([[3_037_000_499, 1], [3_037_000_500, 0], [2**31, 2**31]], np.int64)
    assert whitening.deviations(big) == [3_037_000_499**2 + 1, None, 2**63 - 1 if 2 * 2**62 < 2**63 else None]


# spelling variants


def distance_is_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped_by_hand(counts):
    near = {w: [x for x in counts if distance_is_one(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def test_spelling_groups_of_many_close_words(spark):
    rng = random.Random(11)
    stems = ["abcabcab", "zzzzzz", "éèêëéè", "wordswordswords", "hothothothot"]
    counts = {}
    for _ in range(1500):
        w = list(rng.choice(stems))
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            at = rng.randrange(len(w))
            w[at : at + rng.choice((0, 1))] = rng.choice(("", "a", "b", "z", "é", "ÿ", "×"))
        if len(w := "".join(w)) >= 6:
            counts[w] = rng.choice((5, 7, 26, 140, 700, 3600))
    vocab = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group(vocab).collect()}
    assert got == grouped_by_hand(counts)
    # several links long
    assert any(got[got[w][0]][0] for w in got if got[w][0])


def test_forms_are_followed_to_the_last(spark):
    chain = ["aaaaaa" + "b" * i for i in range(9)]
    counts = {w: 5 ** (i + 1) for i, w in enumerate(chain)}
    got = spelling.group(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {r["root"] for r in got} == {chain[-1]} and len(got) == 9


def test_words_of_odd_texts(spark):
    rows = [(1, "Straße STRASSE naïve-Ünder x1abcdefg9 ABCDEF"), (2, None), (None, "abcdef abcdef"), (3, ""), (4, "q" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit("clash"))
    got = Counter(r["run"] for r in spelling.runs(docs).collect())
    assert got == {"straße": 1, "strasse": 1, "abcdefg": 1, "abcdef": 3, "q" * 200_000: 1}
    none = docs.where("doc_id < 0")
    assert spelling.group(spelling.vocabulary(spelling.runs(none).withColumnRenamed("run", "word"))).collect() == []


def test_misspelt_by_checksum(spark):
    rows = [(i, w) for i in range(2000) for w in ("abcdefg", "éàüxyzw")] + [(None, "abcdefg")]
    got = spark.createDataFrame(rows, "doc_id long, run string").select("doc_id", "run", queries.misspelt(F.col("doc_id"), F.col("run")).alias("w")).collect()
    for doc_id, run, w in got:
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        at = h % len(run)
        assert w == (run[:at] + run[at + 1 :] if h % 199 == 0 else run)
    assert any(len(w) < 7 for _, _, w in got)


# packing


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


SAMPLE = st.text(st.one_of(st.characters(), st.sampled_from(" \n\t'sdlvreABab019_-.,  ªµ²½é߿の中😀̀\x1c\x85")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(text=SAMPLE.filter(lambda t: "\ud800" > max(t, default="") or not any("\ud800" <= c <= "\udfff" for c in t)))
def test_tokens_are_those_of_the_tokenizer(encoder, tokenizer, text):
    assert ids_of(encoder.encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_tokens_of_special_and_long_texts(encoder, tokenizer):
    for text in ("a <|endoftext|> b", "it's we'll they'd  x\n\n y", "word " * 300_000 + "  end", "", "中文 text 12² _x_"):
        assert ids_of(encoder.encode(text)) == tokenizer.encode(text, add_special_tokens=False).ids


def check_places(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_packing_of_the_whole_table(spark, tokenizer, scale):
    sf = f"/root/testdata/{scale}"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op13_packing(spark, sf).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == set(texts)
    total = 0
    for doc_id, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        total += len(ids)
        parts = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and len(parts) == -(-len(ids) // 1024)
        assert all(r["length"] == 1024 for r in parts[1:]) and sum(r["length"] for r in parts) == len(ids)
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[r["start"] : r["start"] + r["length"]]))
    assert check_places(rows, 1024) <= 1.005 * total / 1024 + 2


def test_a_tree_of_many_leaves_packs_nearly_as_one(spark):
    rng = random.Random(5)
    lengths = [rng.choice((rng.randint(1, 1024), rng.randint(500, 1024), 1024, 600, 3)) for _ in range(6000)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long")
    whole = len(packing.best_fit(lengths, 1024)[2])
    for fan in (2, 16):
        rows = packing.pack(items, fan=fan, leaf=100, least=100).collect()
        assert sorted(r["id"] for r in rows) == list(range(6000))
        assert check_places(rows, 1024) <= 1.03 * whole


def test_a_small_bin_of_one_leaf_meets_large_ones_of_another(spark):
    # each leaf gets its share of both lengths; only merging above them pairs what is left
    items = spark.createDataFrame([(i, 200 if i == 0 else 800) for i in range(300)], "id long, length long")
    assert check_places(packing.pack(items, leaf=20, least=20, fan=2).collect(), 1024) == 299


def test_packing_of_odd_items(spark):
    rows = [(1, 5), (1, 5), (2, None), (3, 0), (4, 1025), (None, 1024), (5, -1)]
    items = spark.createDataFrame(rows, "id long, length long").withColumns({c: F.lit("clash") for c in ("row", "bin", "at", "fill", "offset", "moved", "into", "my col")})
    got = packing.pack(items).collect()
    assert len(got) == 7 and all(r["bin"] == r["row"] == r["my col"] == "clash" for r in got)
    assert all((r["sequence_id"] is None) == (r["offset"] is None) == (r["length"] is None or not 1 <= r["length"] <= 1024) for r in got)
    assert packing.pack(items.where("id < 0")).collect() == []


def test_tokens_come_back_from_sequences(spark, tokenizer):
    rows = [(1, "one two three " * 500, "x"), (2, None, "y"), (3, "", None), (1, "short", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    packed = packing.pack(packing.pieces(docs, PATH, capacity=64), capacity=64)
    rows = packed.collect()
    check_places(rows, 64)
    assert min(len(ids_of(r["tokens"])) for r in rows) == 1 and all(len(r["tokens"]) == 4 * r["length"] for r in rows)
    whole = {r["sequence_id"]: bytes(r["tokens"]) for r in packing.assemble(packed).collect()}
    for r in rows:
        assert whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["tokens"])
    assert packing.pieces(docs.where("doc_id < 0"), PATH).collect() == []
