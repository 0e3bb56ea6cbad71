"""What the operators share: tables, written intermediate results, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..steps import delete, dropped, new_path, shared_folder, spent, written

__all__ = ["CRC_CTES", "components", "crc32_sql", "delete", "dropped", "free_name", "is_empty", "new_path", "shared_folder", "spent", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the undirected links ``(a, b)``.

    Alternating large-star and small-star steps: every step hangs each node's
    neighbours on the least node it knows of, until only stars are left.  The
    number of rounds is logarithmic in the size of a component.  A step is one
    grouped minimum (combined before its shuffle) and one join; the minima are
    written first, so that the join meets two plain tables and a hub's rows can be
    split over tasks.  ``component`` is the least node of the component.
    Self-links and nulls are ignored; no links give no rows.
    """
    made = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    try:
        now = keep(edges.select("a", "b").where("a <> b").distinct(), "links")
        before = None
        for _ in range(most_rounds):
            seen = _fingerprint(now)
            if seen == before or not seen[0]:
                break
            before = seen
            both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
            least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
            large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            down = keep(large.distinct(), "links")
            lower = keep(down.groupBy("a").agg(F.min("b").alias("m")), "least")
            small = down.join(lower, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            now = keep(small.select("x.a", "x.b").where("a <> b").distinct(), "links")
            dropped(*made[:-1])
            del made[:-1]
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    except BaseException:
        dropped(*made)
        raise
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out._ledgerloom_path = now._ledgerloom_path  # for dropped(), when the caller has read it
    return out


#: CRC-32 for oracles in DuckDB, which has no such function: the table of the polynomial's remainders, in a WITH RECURSIVE.
CRC_CTES = """poly(k, v, step) AS (
  SELECT range, range, 0 FROM range(256) UNION ALL
  SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM poly WHERE step < 8),
crc AS (SELECT list(v ORDER BY k) AS t FROM poly WHERE step = 8)"""


def crc32_sql(blob: str) -> str:
    """The checksum of a blob, in a query that also reads ``crc``."""
    codes = f"[('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex({blob}), '..')]"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT"
