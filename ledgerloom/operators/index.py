"""A kept inverted index: postings, lengths and frequencies, written once, of which a search reads what its terms need.

:func:`build` tokenises every chunk once.  Rows ``term, ord, tf, length`` are dealt by the hash
of their term over ``buckets`` and, within a bucket, by their chunk over ``parts``, so the
postings of a frequent word are shared by tasks; counting and writing need one exchange.  Buckets
are partition folders, in each of which rows are in order of their term: a search
reads the folders that its terms hash to, and of these the row groups whose terms
lie around (minima and maxima in the footers).  Bucket -1 has one row a chunk: its length, also of
chunks without a token.  ``frequencies`` has a row a term, ``size`` one row.

What is indexed is a chunk's text or, where the chunk has a title and headings, its
breadcrumb and text, so that a section is found by what stands above it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..steps import delete, new_path
from .chunking import index_text

LEAST_BUCKETS, PARTS, BROADCAST_ROWS = 16, 8, 10_000
NO_TERM = -1
TABLES = {"postings": "term string, ord long, length int, tf long, bucket int", "frequencies": "term string, df long, bucket int"}


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if it has at most ``most`` rows, else leave the choice to the planner."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _bucket(term: Column, buckets: int) -> Column:
    return F.when(term.isNull(), NO_TERM).otherwise(F.pmod(F.xxhash64(term), F.lit(buckets))).cast("int")


def indexed_text(chunks: DataFrame) -> Column:
    """The text, below its breadcrumb where chunks have one."""
    return index_text(F.col("page_title"), F.col("heading_path"), F.col("text")) if {"page_title", "heading_path"} <= set(chunks.columns) else F.col("text")


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    buckets: int
    chunks: int
    average: float

    def _read(self, table: str, asked: DataFrame | None) -> DataFrame:
        df = self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}")
        if asked is None:
            return df.where(F.col("bucket") != NO_TERM)
        found = [r.b for r in asked.select(_bucket(F.col("term"), self.buckets).alias("b")).distinct().collect()]  # at most as many as there are buckets
        return df.where(F.col("bucket").isin(found) if found else F.lit(False))

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """``term, ord, tf, length``; of the buckets of ``terms`` only, where these are given."""
        return self._read("postings", terms).select("term", "ord", "tf", "length")

    def frequencies(self, terms: DataFrame | None = None) -> DataFrame:
        """``term, df``: the chunks that hold each term."""
        return self._read("frequencies", terms).select("term", "df")

    def lengths(self) -> DataFrame:
        return self.spark.read.schema(TABLES["postings"]).parquet(f"{self.path}/postings").where(F.col("bucket") == NO_TERM).select("ord", "length")

    def weights(self, terms: DataFrame) -> DataFrame:
        """``term, idf`` of the terms asked."""
        return self.frequencies(terms).select("term", F.log(1 + (self.chunks - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))

    def drop(self) -> None:
        delete(self.spark, self.path)


def build(chunks: DataFrame, path: str | None = None, buckets: int | None = None, parts: int = PARTS) -> Index:
    """Index ``ord, text`` (and ``page_title, heading_path``, if the chunks have them) at ``path``, by default a step of the shared folder.

    ``buckets``: by default two a shuffle partition, so that their files grow with what the session is set up for.
    """
    spark = chunks.sparkSession
    buckets = buckets or max(LEAST_BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = path or new_path(spark, "index")
    toks = chunks.select(F.col("ord").cast("long").alias("ord"), tokens(indexed_text(chunks)).alias("t"))
    none = F.array(F.lit(None).cast("string"))
    each = toks.select("ord", F.size("t").alias("length"), F.explode(F.concat("t", none)).alias("term"))
    dealt = each.withColumns({"bucket": _bucket(F.col("term"), buckets), "part": F.pmod(F.xxhash64("ord"), F.lit(parts)).cast("int")}).repartition("bucket", "part")
    posts = dealt.groupBy("bucket", "part", "term", "ord", "length").agg(F.count(F.lit(1)).alias("tf")).drop("part")
    posts.sortWithinPartitions("bucket", "term", "ord").write.partitionBy("bucket").parquet(f"{path}/postings")
    kept = spark.read.schema(TABLES["postings"]).parquet(f"{path}/postings")
    kept.where(F.col("bucket") != NO_TERM).groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/frequencies")
    size = kept.where(F.col("bucket") == NO_TERM).agg(F.count(F.lit(1)).alias("chunks"), F.avg("length").alias("average"), F.lit(buckets).alias("buckets"))
    size.write.parquet(f"{path}/size")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    """The index kept at ``path``."""
    size = spark.read.parquet(f"{path}/size").first()
    return Index(spark, path, size.buckets, size.chunks, size.average or 1.0)


def holders(index: Index, items: DataFrame, docs: DataFrame, doc_of: Column) -> DataFrame:
    """``item_id, doc_id`` of documents (``doc_id, body``) that hold an item's ``text``, letter for letter.

    A token inside the item's text, not at its ends, is a token of every text that holds it.  So the
    postings of each item's rarest one give the candidates, whose bodies are then searched;
    ``doc_of`` tells a posting's document.  Items of fewer than three words have no such
    token; they alone are looked for in all bodies.
    """
    inner = F.regexp_replace(F.regexp_replace("text", r"^[A-Za-z0-9._-]*", ""), r"[A-Za-z0-9._-]*$", "")
    words = items.select("item_id", "text", F.explode_outer(F.array_distinct(tokens(inner))).alias("term"))
    asked = small(words.where("term is not null").select("term").distinct())
    found = words.join(small(index.frequencies(asked).join(asked, "term")), "term", "left")
    # A word that no chunk has rules the item out: its frequency is 0.
    rarest = found.where("term is not null").groupBy("item_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    posts = index.postings(rarest).join(small(rarest), "term").select("item_id", doc_of.alias("doc_id")).distinct()
    text = items.select("item_id", "text")
    near = posts.join(docs, "doc_id").join(small(text), "item_id").where(F.contains("body", "text")).select("item_id", "doc_id")
    short = words.where("term is null").select("item_id", "text")
    return near.union(docs.join(small(short), F.contains("body", "text")).select("item_id", "doc_id"))
