"""Steps that are written to the folder that the cluster shares, so that a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; one of our own only where it is unset, which a cluster refuses.

    It is qualified with its file system, so that Spark and other readers of the path mean the same place.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(at)
    path, fs = _file_system(spark, at)
    at = fs.makeQualified(path).toUri().toString()
    return (at.replace("file:/", "file:///", 1) if at.startswith("file:/") and not at.startswith("file://") else at).rstrip("/")


def _file_system(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, at: str) -> None:
    path, fs = _file_system(spark, at)
    fs.delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once and kept as Parquet in the shared folder.

    A lost executor then costs no recomputation of the stages behind it,
    and each later reader takes only the columns it needs.  :func:`dropped` takes
    it away when its last reader is done; what a returned result still reads stays
    until the shared folder's owner clears it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the files of frames that :func:`written` made and nothing reads any more."""
    for df in frames:
        path = getattr(df, "_ledgerloom_path", None)
        if path:
            delete(df.sparkSession, path)


@contextmanager
def spent() -> Iterator[list[DataFrame]]:
    """A list of written frames that are deleted at the end, whether it went well or not."""
    frames: list[DataFrame] = []
    try:
        yield frames
    finally:
        dropped(*frames)
