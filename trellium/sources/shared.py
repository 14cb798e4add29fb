"""Checkpoints in the folder that all executors share, for work that reads a table more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame

SETTING = "spark.checkpoint.dir"


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, written under the folder that the session names in ``spark.checkpoint.dir``.

    Where that is unset a local master uses a temporary folder; on a cluster it is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get(SETTING, None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError(f"{SETTING} is not set: on a cluster it must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="trellium-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()
