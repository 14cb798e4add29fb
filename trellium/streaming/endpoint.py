"""Metrics of an HTTP endpoint as a stream whose offsets are numbers of scrapes.

Every trigger scrapes once. A scrape cannot be asked for again, so it is kept in a folder,
as ``<prefix>-after-run-<n>.prom``, before its number is offered as an offset; a batch that
is run again, or a stream that starts anew from its checkpoint, reads the same files. An
endpoint that does not answer adds nothing. The folder is one that all workers share.
"""

from __future__ import annotations

import re
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from trellium.sources import files

FORMAT = "metric_endpoint"
TIMEOUT_S = 30


class Scrape(InputPartition):
    def __init__(self, run: int):
        self.run = run


class Scrapes(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.endpoint, self.folder, self.prefix = options["endpoint"], options["path"], options.get("prefix", "metrics")

    def _store(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        store.create_dir(path, recursive=True)
        return store, path

    def _name(self, run: int) -> str:
        return f"{self.prefix}-after-run-{run}.prom"

    def _kept(self) -> int:
        """How many scrapes the folder has, without a gap."""
        from pyarrow import fs

        store, path = self._store()
        named = re.compile(re.escape(self.prefix) + r"-after-run-(\d+)\.prom")
        runs = {int(m[1]) for x in store.get_file_info(fs.FileSelector(path)) if (m := named.fullmatch(x.base_name))}
        return next(n for n in range(len(runs) + 1) if n not in runs)

    def initialOffset(self) -> dict:
        return {"run": 0}

    def latestOffset(self) -> dict:
        run = self._kept()
        try:
            with urllib.request.urlopen(self.endpoint, timeout=TIMEOUT_S) as answer:
                text = answer.read()
        except OSError:
            return {"run": run}
        store, path = self._store()
        with store.open_output_stream(f"{path}/.{self._name(run)}") as out:
            out.write(text)
        store.move(f"{path}/.{self._name(run)}", f"{path}/{self._name(run)}")
        return {"run": run + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Scrape(run) for run in range(start["run"], end["run"])]

    def read(self, partition: Scrape) -> Iterator[tuple]:
        store, path = self._store()
        with store.open_input_stream(f"{path}/{self._name(partition.run)}") as held:
            for line in held.read().decode().splitlines():
                yield partition.run, self.prefix, line


class Endpoint(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "run long, prefix string, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Scrapes(self.options)


def scraped(spark: SparkSession, endpoint: str, folder: str, prefix: str = "metrics") -> DataFrame:
    """A stream of run, prefix, name, labels, number: a run each trigger."""
    spark.dataSource.register(Endpoint)
    lines = spark.readStream.format(FORMAT).option("endpoint", endpoint).option("prefix", prefix).load(folder)
    return files.metric_samples(lines, keep=("prefix", "run"))
