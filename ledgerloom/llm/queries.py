"""The thin queries of this package, one an operator, and the pipeline's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import infill, language, line_dedup, media, mixing, quality, sharding, toxicity, trie, warc
from .common import table
from .embed_dedup import embedding_duplicates
from .near_dedup import near_duplicates
from .packing import pack


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_duplicates(table(spark, sf_dir, "documents"))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.fixity(warc.records(pages), warc.records(warc.damaged(pages)))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), length=4096)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.fill_in_middle(table(spark, sf_dir, "documents"))


def op12_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_quality, op3_near_dedup, op4_toxicity, op5_line_dedup, op6_warc_fixity, op7_media_columns, op8_embedding_dedup, op9_pack, op10_language, op11_fill_in_middle, op12_shard, op13_prefix_trie)}
ORACLE_SQL = {"op1_mix_sources": mixing.SQL, "op5_line_dedup": line_dedup.SQL, "op6_warc_fixity": warc.SQL, "op11_fill_in_middle": infill.SQL, "op12_shard": sharding.SQL, "op13_prefix_trie": trie.SQL}
