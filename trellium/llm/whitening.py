"""Whitening of embeddings: principal components of exactly centred vectors, at unit variance.

Method. Every entry c becomes the whole number floor(64 c), so sums are exact. The fit
list holds each distinct vector once. Its rows are centred as whole numbers, n * y - S,
before they are divided by n; a RowMatrix of them gives the Gramian matrix, which over n
is the covariance. Its eigenvectors are computed locally, and broadcast to the tasks that
project every row, in Arrow batches.

Scale. The vectors are shuffled once, for the distinct list, with repeats combined before
the shuffle, so a vector that a third of the rows share is a row per task there. The list
is written once; sums, Gramian matrix and the audit are partial sums per task. What reaches
the driver is the square of the vector length, whatever the number of rows. Projecting is
a pass without a shuffle.

Defined results. A vector that is null or holds null or non-finite entries is dropped.
Entries beyond 2^31 / 64 in size count as that. Shorter vectors are filled up with zeros
to the longest. A deviation that no long can hold is null. A component without variance
has null in ``whitened``; where nothing varies ``explained`` is null as well. Vectors of
no entries, and empty tables, give no rows. Repeated rows are rows of their own. Extra
columns are kept, whatever their names; only those named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellium.llm import rows, scratch
from trellium.llm.scratch import store

STEPS = 64
LARGEST = 1 << 31
COMPONENTS = 16
ADDED = ("component", "n", "deviation", "whitened", "explained", "identity_error")


@dataclass
class Model:
    """``matrix``: a column per component, divided by the root of its eigenvalue; NaN where that is nothing."""

    n: int
    sums: np.ndarray
    matrix: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None


def is_valid(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def steps(vector: Column, width: int) -> Column:
    """The entries as whole numbers, filled up with zeros to ``width``."""
    bound = F.lit(float(LARGEST))
    whole = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * STEPS, bound), -bound)).cast("long"))
    return F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.greatest(width - F.size(vector), F.lit(0))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(fitted: DataFrame, of, size: int, whole: bool) -> np.ndarray:
    """The sum over all rows of what ``of`` makes of a batch of vectors: ``size`` numbers, added up within each task first."""
    kind, arrow = (np.int64, pa.int64()) if whole else (np.float64, pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for batch in batches:
            total += of(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(arrow))], names=["part"])

    parts = fitted.mapInArrow(run, f"part array<{'long' if whole else 'double'}>").select(F.posexplode("part").alias("i", "x"))
    out = np.zeros(size, kind)
    for i, x in parts.groupBy("i").agg(F.sum("x")).collect():
        out[i] = x
    return out


def _covariance(fitted: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    total = F.lit(sums.tolist()).cast("array<long>")
    centred = F.zip_with("y", total, lambda y, s: (y * n - s).cast("double") / n)
    vectors = MLUtils.convertVectorColumnsFromML(fitted.select(array_to_vector(centred).alias("v")), "v")
    return RowMatrix(vectors, n, len(sums)).computeGramianMatrix().toArray() / n


@scratch.tidy
def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Model:
    """The components of largest variance of the distinct vectors of ``df``, with the measured error of their whitening."""
    valid = df.select(rows.named(vector).alias("v")).where(is_valid(F.col("v")))
    width = valid.agg(F.max(F.size("v"))).first()[0] or 0
    if not width:
        return Model(0, np.zeros(0, np.int64), np.zeros((0, 0)), [])
    held = store(valid.select(steps(F.col("v"), width).alias("y")).distinct(), "vectors")
    n = held.df.count()
    sums = _summed(held.df, lambda y: _matrix(y, width).sum(axis=0), width, True)
    covariance = _covariance(held.df, n, sums)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    solid = values > values[0] * width * 8 * np.finfo(float).eps
    trace = np.trace(covariance)
    explained = [float(max(e, 0) / trace) for e in values] if trace > 0 else [None] * len(values)
    model = Model(n, sums, np.where(solid, vectors / np.sqrt(np.where(solid, values, 1)), np.nan), explained)
    k = int(solid.sum())
    if k:
        matrix = model.matrix[:, solid]

        def squares(y: pa.Array) -> np.ndarray:
            z = _centred(y, n, sums) / n @ matrix
            return (z.T @ z).ravel()

        measured = _summed(held.df, squares, k * k, False).reshape(k, k) / n
        model.identity_error = float(np.abs(measured - np.eye(k)).max())
    held.drop()
    return model


def _centred(column: pa.Array, n: int, sums: np.ndarray) -> np.ndarray:
    """n * y - S, in whole numbers."""
    return _matrix(column, len(sums)) * n - sums


def deviations(centred: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; null where no long holds it."""
    near = np.square(centred.astype(float)).sum(axis=1)
    exact = np.square(centred).sum(axis=1).tolist()
    for i in np.flatnonzero(near > 2.0**62):
        full = sum(int(x) ** 2 for x in centred[i])
        exact[i] = full if full < 1 << 63 else None
    return exact


def project(df: DataFrame, model: Model, vector: str = "embedding") -> DataFrame:
    """Per valid row and component: the columns of ``df`` but the vector, with ADDED."""
    replaced = (vector, *ADDED)
    width = len(model.sums)
    given = rows.carry(df, replaced, v=rows.named(vector)).where(is_valid(F.col("v"))).select("row", steps(F.col("v"), width).alias("y"))
    held = df.sparkSession.sparkContext.broadcast((model.n, model.sums, model.matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, matrix = held.value
        for batch in batches:
            centred = _centred(batch.column(1), n, sums)
            z = centred / n @ matrix
            flat = pa.array(z.ravel(), mask=np.isnan(z.ravel()))
            each = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(centred), pa.int64()), each], names=["row", "deviation", "z"])

    if not width:
        shape = given.select("row", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("z"))
    else:
        shape = given.mapInArrow(run, rows.schema(given.select("row"), ("deviation", "long"), ("z", "array<double>")))
    each = shape.select("row", "deviation", F.posexplode("z").alias("at", "whitened"))
    explained = F.get(F.lit(model.explained or [None]).cast("array<double>"), F.col("at"))
    return each.select(
        *rows.restore(rows.kept(df, replaced)), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", explained.alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every valid row of ``df`` on the components fitted on all its distinct vectors."""
    return project(df, fit(df, vector, components), vector)
