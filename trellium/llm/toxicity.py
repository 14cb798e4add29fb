"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or.

Method. A document is a bag of sentences and only the bag has a label. A sentence's
probability is a logistic function of its words and word beginnings; the document's is
one minus the product of what the sentences leave. Training maximises the likelihood of
the document labels through that product, so weight settles on the sentences that explain
a toxic label, and these are what ``score`` reports as offending.

Scale. The model is fitted by one task on a bounded sample: ``TRAIN_ROWS`` labelled
documents (the first by MD5 of doc_id) of up to ``TRAIN_CHARS`` characters, found by a
broadcast join on at most that many ids. It keeps ``FEATURES`` weights, which is what the
workers get. Scoring is one pass over all documents, without a shuffle, in Arrow batches;
whole texts are scored.

Defined results. A null or empty text has no sentence and scores 0. Without labels of
both classes every score is 0. Several labels of a document count as their maximum; null
labels or ids are ignored. Repeated rows are rows of their own. Spans are places in the
text as given. Extra columns are kept, whatever their names; only those named like the
added ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.llm import rows

TRAIN_ROWS = 6000
TRAIN_CHARS = 50_000
FEATURES = 4000
LEAST_DOCS = 4
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7)
CACHE = 100_000
ADDED = ("score", "predicted", "offending")
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    bias: float = -30.0
    weights: dict[int, float] = field(default_factory=dict)


def features(word: str) -> tuple[int, ...]:
    """Hash buckets of the word and its beginnings, marked apart."""
    names = [word, *[word[:n] + "*" for n in PREFIXES if len(word) >= n]]
    return tuple(crc32(x.encode()) % BUCKETS for x in names)


class _Cache(dict):
    """What ``make`` returns for a word, kept for a bounded number of words."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = self.make(word)
        return value


def bag(text: str, known: _Cache) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all sentences one after the other, and how many each sentence has."""
    buckets: list[int] = []
    counts = []
    for m in _SENTENCE.finditer(text):
        before = len(buckets)
        for word in dict.fromkeys(_WORD.findall(m[0].lower())):
            buckets.extend(known[word])
        if len(buckets) > before:
            counts.append(len(buckets) - before)
    return np.array(buckets, np.int32), np.array(counts, np.int32)


def _select(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """The buckets that tell most, by the G statistic over documents."""
    seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for (buckets, _), label in zip(bags, y, strict=True):
        have = np.unique(buckets)
        seen[have] += 1
        if label:
            toxic[have] += 1
    names = np.flatnonzero(seen >= LEAST_DOCS)
    n, t = seen[names], toxic[names]
    rate, rows = y.mean(), len(y)

    def term(part: np.ndarray, want: np.ndarray) -> np.ndarray:
        return np.where(part > 0, part * np.log(np.maximum(part, 1e-9) / np.maximum(want, 1e-9)), 0)

    g = term(t, n * rate) + term(n - t, n * (1 - rate)) + term(y.sum() - t, (rows - n) * rate)
    g += term(rows - n - y.sum() + t, (rows - n) * (1 - rate))
    return np.sort(names[np.argsort(-g, kind="stable")[:FEATURES]])


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(texts: list[str], labels: list[int], rounds: int = 250, ridge: float = 6e-5) -> Model:
    """The model of documents and their 0/1 labels, by full-batch Adam from fixed starts."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model()
    known = _Cache(features)
    bags = [bag(t or "", known) for t in texts]
    chosen = _select(bags, y)
    column, sentence, owner = [], [], []
    blank = np.zeros(len(bags))
    count = 0
    for d, (buckets, sizes) in enumerate(bags):
        at = np.minimum(np.searchsorted(chosen, buckets), max(0, len(chosen) - 1))
        hit = chosen[at] == buckets if len(chosen) else np.zeros(len(buckets), bool)
        used, place = np.unique(np.repeat(np.arange(len(sizes)), sizes)[hit], return_inverse=True)
        blank[d] = len(sizes) - len(used)
        column.append(at[hit])
        sentence.append(place + count)
        owner += [d] * len(used)
        count += len(used)
    del bags
    column, sentence = np.concatenate(column), np.concatenate(sentence)
    col, sen, own = np.array(column, np.int64), np.array(sentence, np.int64), np.array(owner, np.int64)
    w, b = np.zeros(len(chosen)), -6.0
    m1, m2, c1, c2 = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for k in range(1, rounds + 1):
        z = b + np.bincount(sen, w[col], count)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        p0 = 1 / (1 + np.exp(-b))
        keep = -np.bincount(own, _softplus(z), len(y)) - blank * _softplus(np.array(b))
        left = np.exp(keep)
        pull = np.where(y > 0, -left / np.maximum(1 - left, 1e-9), 1.0)
        dz = p * pull[own]
        gw = np.bincount(col, dz[sen], len(w)) / len(y) + ridge * w
        gb = (dz.sum() + (blank * p0 * pull).sum()) / len(y)
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.999 * m2 + 0.001 * gw * gw
        c1, c2 = 0.9 * c1 + 0.1 * gb, 0.999 * c2 + 0.001 * gb * gb
        rate = 0.1 * np.sqrt(1 - 0.999**k) / (1 - 0.9**k)
        w -= rate * m1 / (np.sqrt(m2) + 1e-8)
        b -= rate * c1 / (np.sqrt(c2) + 1e-8)
    return Model(float(b), {int(f): float(x) for f, x in zip(chosen, w, strict=True) if abs(x) > 1e-3})


def score_text(text: str, bias: float, cache: _Cache) -> tuple[float, list[tuple[int, int, float]]]:
    """The noisy-or score, and (start, end, probability) of sentences of 0.5 and more."""
    blank = math.log1p(math.exp(bias))
    kept, offending = 0.0, []
    for m in _SENTENCE.finditer(text):
        words = set(_WORD.findall(m[0].lower()))
        if not words:
            continue
        z = math.fsum(map(cache.__getitem__, words))
        if not z:
            kept += blank
            continue
        z += bias
        kept += z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
        if z >= 0:
            offending.append((m.start(), m.end(), 1 / (1 + math.exp(-z))))
    return min(1.0, max(0.0, -math.expm1(-kept))), offending


def weight_cache(model: Model) -> _Cache:
    weights = model.weights
    return _Cache(lambda word: sum(weights.get(f, 0.0) for f in features(word)))


def _scorer(model: Model, inside: int):
    """Over batches of a column and a text, which may be field ``inside`` of that column: the column, with ADDED."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = weight_cache(model)
        for batch in batches:
            said = batch.column(1) if inside < 0 else batch.column(0).field(inside)
            scored = [score_text(t.as_py() or "", model.bias, cache) for t in said]
            columns = [
                batch.column(0),
                pa.array([s for s, _ in scored], pa.float64()),
                pa.array([int(s >= 0.5) for s, _ in scored], pa.int32()),
                pa.array([[{"start": a, "end": b, "p": p} for a, b, p in o] for _, o in scored], pa.list_(span)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", *ADDED])

    return run


def _fitter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights of a model of all rows, the bias as bucket -1."""
    texts, labels = [], []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        labels += [int(y > 0) for y in batch.column(1).to_pylist()]
    model = fit(texts, labels)
    rows = [(-1, model.bias), *model.weights.items()]
    buckets, weights = zip(*rows, strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(weights, pa.float64())], names=["bucket", "weight"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """A model of the sample that the docstring of this module bounds; ``labels``: doc_id, toxic."""
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    ids = known.orderBy(key, "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.length("text") <= chars)
    first = sample.orderBy(key, "doc_id", F.xxhash64("text")).limit(rows).select("text", "_toxic")
    fitted = first.coalesce(1).mapInArrow(_fitter, "bucket int, weight double").collect()
    weights = {r[0]: r[1] for r in fitted}
    return Model(weights.pop(-1), weights) if weights else Model()


def _scored(docs: DataFrame, model: Model, replaced: tuple[str, ...]) -> DataFrame:
    """``row``, the columns of ``docs`` but those replaced, with ADDED."""
    given = rows.carry(docs, replaced, said=F.col("text"))
    kept = [c.lower() for c in rows.kept(docs, replaced)]
    inside = kept.index("text") if "text" in kept else -1
    given = given if inside < 0 else given.select("row")
    found = (("score", "double"), ("predicted", "int"), ("offending", "array<struct<start:int,end:int,p:double>>"))
    return given.mapInArrow(_scorer(model, inside), rows.schema(given.select("row"), *found))


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """``docs``, without text unless it is kept, with ``score``, ``predicted`` (score >= 0.5) and ``offending`` sentences."""
    replaced = ADDED if keep_text else (*ADDED, "text")
    return _scored(docs, model, replaced).select(*rows.restore(rows.kept(docs, replaced)), *ADDED)


def remove(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs``, without the documents that the model rejects."""
    return _scored(docs, model, ()).where("predicted = 0").select(*rows.restore(docs.columns))
