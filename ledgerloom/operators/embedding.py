"""Embedding texts in batches, behind a cache that is filled once a distinct text.

The embedder is the caller's: ``make()`` gives a callable of (texts, kind) to as many
vectors, and is called once in each task that has texts to embed, so a client lives as long as its
partition.  Calls hold ``batch`` texts, counted over the partition and not over an Arrow batch.

A text's key is the SHA-256 of model, kind (document or query) and text: another model
or kind finds nothing of this one's.  Texts are made distinct by key before they are asked for, so copies cost one call's
place; what was not in the cache is appended to it when all of it is known.  A failing
call, or one with another number of vectors, fails the job and appends nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Embedder = Callable[[Sequence[str], str], Sequence[Sequence[float]]]
CACHE = "cache_key string, vector array<double>"
BATCH = 128


def cache_key(model: str, kind: str, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(model), F.lit(kind), F.coalesce(text, F.lit(""))), 256)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """``cache_key, vector``, one row a key; empty where nothing has been kept yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path).dropDuplicates(["cache_key"])  # two jobs may have asked for one text


def _calls(make: Callable[[], Embedder], kind: str, batch: int):
    def asked(embed: Embedder, keys: list[str], texts: list[str]) -> pa.RecordBatch:
        vectors = [[float(x) for x in v] for v in embed(texts, kind)]
        if len(vectors) != len(texts):
            raise RuntimeError(f"{len(vectors)} vectors for {len(texts)} texts")
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(vectors, pa.list_(pa.float64()))], ["cache_key", "vector"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed, keys, texts = None, [], []
        for rows in batches:
            embed = embed or make()
            keys += rows.column(0).to_pylist()
            texts += rows.column(1).to_pylist()
            while len(texts) >= batch:
                yield asked(embed, keys[:batch], texts[:batch])
                del keys[:batch], texts[:batch]
        if texts:
            yield asked(embed, keys, texts)

    return run


def embedded(texts: DataFrame, cache_path: str, make: Callable[[], Embedder], model: str, kind: str = "document", text_col: str = "text", name: str = "vector", batch: int = BATCH, tasks: int | None = None) -> DataFrame:
    """``texts`` with their vectors as ``name``; what the cache has not is asked for and kept.  A null text is an empty one.

    ``tasks``: how many tasks ask at once, by default as many as a shuffle has.
    """
    spark = texts.sparkSession
    key = cache_key(model, kind, F.col(text_col))
    distinct = texts.select(key.alias("cache_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["cache_key"])
    missing = distinct.join(read_cache(spark, cache_path).select("cache_key"), "cache_key", "left_anti")
    missing = missing.repartition(*([tasks] if tasks else []), "cache_key")
    missing.mapInArrow(_calls(make, kind, batch), CACHE).write.mode("append").parquet(cache_path)
    found = read_cache(spark, cache_path).select(F.col("cache_key").alias("__key"), F.col("vector").alias(name))
    return texts.withColumn("__key", key).join(found, "__key", "left").drop("__key")
