"""Finished calls of a provider stage, kept in a shared folder: a run that was stopped asks only for the rest.

Tasks append what providers have answered while they go on, as small Parquet files of their own, each moved into place when
it is whole. A task that runs again, after its executor was lost or because its plan is read a second time, finds its
own answers; a run that starts again leaves out all rows that have one.
"""

from __future__ import annotations

import posixpath
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..sources.documents import opened


class Ledger:
    """The answers of one stage. folder must be shared by all executors, on a file system that pyarrow knows, and named with it
    (see documents.qualified) unless it is a local one."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.run = uuid.uuid4().hex
        self._open()

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return opened(self.folder)

    def append(self, part: int, answers: pa.Table) -> None:
        """Keep answers of a task of this run: files whose names begin with _ are not read until they are whole."""
        fs, path = self._open()
        fs.create_dir(path, recursive=True)
        name = f"{self.run}-{part}-{uuid.uuid4().hex}.parquet"
        with fs.open_output_stream(posixpath.join(path, f"_{name}")) as out:
            pq.write_table(answers, out)
        fs.move(posixpath.join(path, f"_{name}"), posixpath.join(path, name))

    def of_task(self, part: int) -> list[dict]:
        """What earlier attempts of a task of this run have kept."""
        fs, path = self._open()
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        rows = []
        for f in found:
            if f.base_name.startswith(f"{self.run}-{part}-"):
                with fs.open_input_file(f.path) as source:
                    rows += pq.read_table(source).to_pylist()
        return rows

    def answers(self, spark: SparkSession, schema: str) -> DataFrame | None:
        """All answers of earlier runs, one for each id; None if there are none."""
        fs, path = self._open()
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        if not any(not f.base_name.startswith("_") for f in found):
            return None
        return spark.read.schema(schema).parquet(self.folder).dropDuplicates(["id"])
