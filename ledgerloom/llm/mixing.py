"""Mixing sources to target weights with hash-threshold histograms.

Every document has a size in words and a place given by a hash of its id.  Each
source gets a share of the budget by its weight, at most ``most_repeats`` times
its own size; what it cannot take is shared again by weight.  A source takes
every document ``floor(target / size)`` times, and once more those of smallest
hash until the rest of its target is filled.  Words are counted by the JVM's
regular expressions; no row passes through Python.

That last threshold is found without sorting documents: sizes are summed by
source and hash bucket (a sum combined before its shuffle), a running sum over
a source's buckets shows which bucket holds the threshold, and only the rows of
that boundary bucket are summed again by the next bits of the hash.  After
three levels of 256 buckets the boundary holds one document in 2^24, and the
exact hash decides.  The document on the threshold gives the words still missing
(rows that share its hash give equal shares, rounded down).  Thresholds are
nested: a larger budget takes whatever a smaller one takes, in the same order.

Defined cases: a null text has size 0 and takes 0; a null source is a source of
its own, last in order; sources of size 0 have target 0; a null ``doc_id``
hashes as the empty text; rows that repeat a ``doc_id`` are taken alike.  Other
columns are ignored by :func:`mix` and kept by :func:`mixed`, whatever their names.
An empty table gives no rows.  The table of sources is one row a source; it is
ordered and filled in one pass in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, free_name, written

BITS, LEVELS, HASH_BITS = 8, 3, 60
WORD = r"[^\x20\x09-\x0D]+"


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _place(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most_repeats: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` by water filling.

    Sources are ordered by the level at which they are full.  Running sums of what
    the full ones hold and of the weights still open give the level for every
    number of full sources; the least level that fills no further source holds.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = sources.select("source", "source_size", weight.alias("weight"), (F.lit(float(most_repeats)) * F.col("source_size")).alias("most"))
    everything = Window.partitionBy()
    fuller = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    held, shut = (F.coalesce(F.sum(c).over(fuller), F.lit(0.0)) for c in ("most", "weight"))
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - held) / (F.sum("weight").over(everything) - shut)
    table = table.withColumn("level", level)
    table = table.withColumn("level", F.max(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.col("level"))).over(everything))
    return table.select("source", "source_size", F.round(F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))), 6).alias("target"))


def _thresholds(sized: DataFrame, weights: tuple[float, ...], share: float, most_repeats: float) -> DataFrame:
    """One row a source: ``s, source_size, target, copies, rest``, and ``edge, left, words`` of the threshold."""
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most_repeats)
    goal = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.round("target").cast("long") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = written(goal.withColumn("rest", F.round("target").cast("long") - F.col("copies") * F.col("source_size")), "targets")
    # Where the threshold lies: the bucket in which the running sum passes what is left.
    bound = goal.where("rest > 0").select(F.col("source").alias("s"), F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("left"))
    done = []
    for level in range(1, LEVELS + 2):
        shift = HASH_BITS - BITS * level if level <= LEVELS else 0
        above = HASH_BITS - BITS * (level - 1)
        inside = sized.where("size > 0").join(bound, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("place", above) == F.col("prefix")))
        sums = inside.groupBy("s", "left", F.shiftright("place", shift).alias("prefix")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))
        bound = sums.withColumn("upto", upto).where("upto >= left and upto - words < left").select("s", "prefix", (F.col("left") - (F.col("upto") - F.col("words"))).alias("left"), "words")
        last = written(bound, "threshold")
        done.append(last)
        bound = last.drop("words")
    edge = last.select(F.col("s").alias("e"), F.col("prefix").alias("edge"), "left", "words")
    out = written(goal.withColumnRenamed("source", "s").join(edge, F.col("s").eqNullSafe(F.col("e")), "left").drop("e"), "thresholds")
    dropped(goal, *done)
    return out


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most_repeats: float = 2.0, whole: bool = False) -> tuple[DataFrame, str]:
    """(the input's rows and columns with one struct column ``size, source_size, target, taken`` more, its name).

    Each row's share is worked out on the row itself, so rows that repeat an id,
    under one source or several, are not joined with each other.  ``whole``: take
    each document a whole number of times; the one on the threshold is taken if
    that brings the source nearer to its target.
    """
    sized = docs.select(F.col(source_col).alias("source"), _size(F.col(text_col)).alias("size"), _place(F.col(id_col)).alias("place"))
    sized = written(sized, "sizes")
    goal = _thresholds(sized, weights, share, most_repeats)
    dropped(sized)
    mix, own, to = free_name(docs, "mix"), free_name(docs, "mix_own"), free_name(docs, "mix_to")
    goal = goal.select(F.struct("*").alias(to))
    here = docs.withColumn(own, F.struct(_size(F.col(text_col)).alias("size"), _place(F.col(id_col)).alias("place")))
    met = here.join(goal, F.col(source_col).eqNullSafe(F.col(f"{to}.s")))
    size, place, g = F.col(f"{own}.size"), F.col(f"{own}.place"), lambda name: F.col(f"{to}.{name}")
    if whole:
        on_edge = F.when(2 * g("left") >= g("words"), size).otherwise(0)
    else:
        on_edge = F.expr(f"{own}.size * {to}.left div {to}.words")
    more = F.when(g("rest") <= 0, 0).when(place < g("edge"), size).when(place == g("edge"), F.coalesce(on_edge, F.lit(0))).otherwise(0)
    taken = (g("copies") * size + more).cast("long")
    return met.withColumn(mix, F.struct(size.alias("size"), g("source_size").alias("source_size"), g("target").alias("target"), taken.alias("taken"))).select(*docs.columns, mix), mix


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, taken`` (see :func:`mixed`)."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    out, name = mixed(plain, "doc_id", "text", "source", **how)
    return out.select("doc_id", "source", f"{name}.size", f"{name}.source_size", f"{name}.target", f"{name}.taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight,
      2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS budget FROM s),
f AS (SELECT *, coalesce(sum(most) OVER b, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS free FROM w
      WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((budget - held) / free) FILTER (WHERE most / weight >= (budget - held) / free) AS level FROM f),
t AS (SELECT source, source_size, round(least(most, coalesce(level * weight, most)), 6) AS target FROM w, l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS copies FROM t),
r AS (SELECT *, round(target)::BIGINT - copies * source_size AS rest FROM c),
p AS (SELECT d.*, r.source_size, r.target, r.copies, r.rest,
      sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto,
      sum(size) OVER (PARTITION BY d.source, place) AS tied FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, size, source_size, target, (copies * size + CASE WHEN rest <= 0 THEN 0 WHEN upto <= rest THEN size
  WHEN upto - tied < rest AND tied > 0 THEN size * (rest - (upto - tied)) // tied ELSE 0 END)::BIGINT AS taken FROM p
"""
