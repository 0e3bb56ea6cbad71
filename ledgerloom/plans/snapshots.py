"""Snapshots of a table, published whole: a reader sees the last one that was, until the next one is.

A run's rows are written to a folder of their own and the pointer to it is made last, as
a file that only one writer can create.  So a refresh that fails on its way, or has
gaps, leaves the rows readable that were there, with the time they were
published; two refreshes at once cannot both become the next one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class NotPublished(RuntimeError):
    """A refresh has gaps, or another one was faster; the earlier snapshot stays."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = lambda *at: hadoop.Path("/".join((self.path, *at)))
        self._fs = self._path("rows").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _pointers(self) -> list[int]:
        at = self._path("pointers")
        if not self._fs.exists(at):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit())

    def _said(self, run: int) -> dict | None:
        """What a pointer says; None where its writer has not come to the end."""
        text = self.spark.read.text(self._path("pointers", str(run)).toString(), wholetext=True).first()
        return json.loads(text.value) if text and text.value.strip() else None

    def current(self) -> dict | None:
        """``run, folder, published_at`` and what else the pointer says of the last snapshot; None before the first."""
        return next(filter(None, map(self._said, reversed(self._pointers()))), None)

    def rows(self, run: int | None = None) -> DataFrame:
        """Rows of the last snapshot, or of run ``run``."""
        said = self.current() if run is None else self._said(run) if run in self._pointers() else None
        if said is None:
            raise NotPublished("no such snapshot has been published")
        return self.spark.read.parquet(f"{self.path}/rows/{said['folder']}")

    def publish(self, rows: DataFrame, published_at: str, gaps: DataFrame | None = None, **said) -> int:
        """Write ``rows`` and make them the current ones; the run's number.  With gaps, or if the write fails, nothing changes."""
        if gaps is not None and gaps.take(1):
            raise NotPublished("the refresh has gaps")
        run = (self._pointers() or [0])[-1] + 1
        folder = f"{run}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/rows/{folder}")
        body = json.dumps({"run": run, "folder": folder, "published_at": published_at} | said)
        try:
            stream = self._fs.create(self._path("pointers", str(run)), False)  # fails where it exists
        except Exception as e:
            self._fs.delete(self._path("rows", folder), True)
            raise NotPublished(f"run {run} has been published by another refresh") from e
        stream.write(body.encode())
        stream.close()
        return run

    def drop_before(self, run: int) -> None:
        """Delete the snapshots before ``run``, which no reader holds any more."""
        for n in self._pointers():
            if n < run:
                said = self._said(n)
                if said:
                    self._fs.delete(self._path("rows", said["folder"]), True)
                self._fs.delete(self._path("pointers", str(n)), False)
