"""Written intermediate tables in the folder that all executors share.

Cutting lineage through a written table survives the loss of an executor: a later
read only needs the shared folder. The folder is the one the session names in
``spark.checkpoint.dir``. Only on a local master, where all tasks share the machine's
disk, a temporary folder stands in where that is unset; on a cluster that is an error.

Tables are dropped when an operator has no more use for them and when it fails (``tidy``).
The last tables of a result that is still lazy stay until the block that consumes it ends
(``scope``), or else until the program does.
"""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: The tables that stand, by path.
LIVE: dict[str, Stored] = {}


def root(spark: SparkSession) -> str:
    """The shared folder for scratch tables."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{SETTING} is not set: on a cluster it must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="trellium-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        folder = f"file://{folder}"
        spark.conf.set(SETTING, folder)
    return f"{folder}/trellium"


class Stored:
    """A DataFrame over a written table, and the means to delete that table."""

    def __init__(self, spark: SparkSession, path: str, df: DataFrame):
        self.spark, self.path, self.df = spark, path, df
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._where, self._files = where, where.getFileSystem(spark._jsc.hadoopConfiguration())
        LIVE[path] = self

    def drop(self) -> None:
        self._files.delete(self._where, True)
        LIVE.pop(self.path, None)


def store(df: DataFrame, tag: str) -> Stored:
    """Write ``df`` as Parquet under the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{root(spark)}/{tag}-{uuid.uuid4().hex}"
    held = Stored(spark, path, df)
    df.write.parquet(path)
    held.df = spark.read.schema(df.schema).parquet(path)
    return held


def _drop_since(before: set[str]) -> None:
    for path in [p for p in LIVE if p not in before]:
        LIVE[path].drop()


@contextmanager
def scope() -> Iterator[None]:
    """Drops, at its end, the tables stored inside that still stand: what was made of them is written by then."""
    before = set(LIVE)
    try:
        yield
    finally:
        _drop_since(before)


def tidy(operator: Callable) -> Callable:
    """The operator, which leaves no tables behind when it fails."""

    @functools.wraps(operator)
    def run(*args, **options):
        before = set(LIVE)
        try:
            return operator(*args, **options)
        except BaseException:
            _drop_since(before)
            raise

    return run


@atexit.register
def _drop_all() -> None:
    # the connection to the JVM may be gone by now
    with suppress(Exception):
        _drop_since(set())
