"""The bounded sample of labelled rows that a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def remainder(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], most: int) -> DataFrame:
    """``doc_id, text, y, half``: at most ``most`` labelled rows outside ``fold`` (remainder, folds).

    Chosen by the smallest hash of the id, so any size of table gives an even
    sample; the ids, bounded by ``most``, are broadcast to the documents.
    """
    remain, folds = fold
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(remainder(F.col("doc_id"), folds) != remain)
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")  # one row an id, whatever repeats it
    return written(rows.withColumn("half", (F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2))).cast("int")), "labelled")
