"""A corpus made ready for training: five stages, each on all that the one before kept.

``run`` writes each stage's rows to the shared folder and reads them again for the
next.  No SQL can express the stages (a learned lexicon, minwise sketches and a
tokenizer are among them), so ``ORACLE_SQL`` is None and the tests hold the
pipeline against brute force, stage by stage (its packing by tokens and places).

Documents with a null text pass every stage and are packed as their end id.
Rows equal in id and text are copies of which near dedup keeps one; rows of one id
with other texts are documents of their own; other columns pass through.  A document that
line dedup leaves without any text is dropped there; one that came empty stays.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import line_dedup, toxicity
from ledgerloom.llm.common import table, written
from ledgerloom.llm.mixing import mixed
from ledgerloom.llm.near_dedup import without_near_copies
from ledgerloom.llm.packing import pack
from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.session import ready


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores under 0.7."""
    terms, curve = toxicity.learn(docs, table(ready(spark), sf_dir, "labels"))
    return toxicity.keep(docs, terms, curve, threshold=0.7)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines of windows seen before; ``n_chars`` follows the text."""
    out, name = line_dedup.deduped(docs)
    removed = F.col(f"{name}.removed")
    out = out.where((removed == 0) | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(removed > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = 85) -> DataFrame:
    """One document of each group of near copies: the one of least id.  The pipeline takes 80 of 100 (``STAGES``); 85 is that of op3."""
    ready(spark)
    return without_near_copies(docs, percent=percent)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it, whole; rows without words, of which there is nothing to take, stay."""
    ready(spark)
    out, mix = mixed(docs, whole=True)
    times = F.when(F.col(f"{mix}.size") > 0, F.expr(f"{mix}.taken div {mix}.size").cast("int")).otherwise(1)
    return out.withColumn(mix, F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path(), length=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", partial(drop_near_copies, percent=80)),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
