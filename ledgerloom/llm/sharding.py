"""Shards of near equal bytes by histogram sort, in DataFrame operations only.

Rows have a place in one global order, given as *digits*: whole numbers compared
one after the other (by default a hash of the text, then one of the id, so equal
texts lie together).  What lies below a shard must hold its part of all bytes.
The bounds between shards (splitters) are found without sorting:

1. Probes cut the range of the first digit into buckets; the exact bytes and rows
   of every bucket are counted (sums, combined before their shuffle), and with a
   running sum those below every probe.
2. A bucket in which a splitter falls, or that holds more than one task should
   sort, is *open*: new probes cut the range between its own least and greatest
   digit, and only rows of open buckets are counted again.  Once all its rows
   share a digit, the next digit is taken.
3. The others are settled, as is a bucket that meets the tolerance.  One that
   holds a splitter goes where its middle lies, and so do all copies of one text
   if they have at most ``together`` of a shard's bytes.

Settled buckets are pieces of the global order whose bytes and rows below are
known.  So one exchange by piece is enough: a row's slot in its shard is its place
within its piece after the rows of the shard's pieces before.  No task sorts more
than a piece, and a piece holds at most ``1 / LEAST_PIECES`` of all bytes and rows.
Rows that share all digits (repeated rows) and are too many for that, or hold a
splitter, are written once with a number of their own, which is then the last digit.

Open buckets are broadcast: there are at most two for ``LEAST_PIECES`` (or for
``PIECE_BYTES`` of a large input) and one a splitter, each a row of a few numbers.

Defined cases: a row has its text's UTF-8 bytes and 1 for its end, a null text 1;
a null id or text has the digit -1, before all others; rows equal in all digits
lie in any order among themselves; other columns are kept, whatever their names.
Short tables may leave shards empty.  An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC_CTES, crc32_sql, dropped, free_name, is_empty, written

HASH_BITS, LEAST_PROBES, MOST_PROBES = 60, 16, 1 << 16
LEAST_PIECES, PIECE_BYTES, PIECE_ROWS = 256, 32 << 20, 1 << 20


def hash_digit(c: Column) -> Column:
    """60 bits of the MD5 of the value's text; null is -1."""
    return F.coalesce(F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long"), F.lit(-1).cast("long"))


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + 1


def _moved(rows: DataFrame, opened: DataFrame, bucket: str, own: str, n: int, how: str) -> DataFrame:
    """``rows`` with the bucket that the open buckets' probes put them in; ``how``: left keeps the others as they are, inner leaves them out."""
    o = free_name(rows, "opened")
    digit = " ".join(f"WHEN {k} THEN {own}_d{k}" for k in range(n))
    cut = F.expr(f"{o}.base + (CASE {o}.digit {digit} END - {o}.least) div {o}.width")
    met = rows.join(F.broadcast(opened.select(F.struct("bucket", "digit", "least", "width", "base").alias(o))), F.col(bucket) == F.col(f"{o}.bucket"), how)
    return met.withColumn(bucket, F.coalesce(cut, F.col(bucket))).drop(o)


def _opened(buckets: DataFrame, n: int, most_bytes: int, level: int) -> DataFrame:
    """The open buckets and their probes: the digit that they cut, its least value, the width between probes, and the first bucket below."""
    first = " ".join(f"WHEN min{k} < max{k} THEN {{}}" for k in range(n))
    pick = lambda what: F.expr("CASE " + first.format(*[what.format(k) for k in range(n)]) + " END")
    out = buckets.where("open").withColumns({"digit": pick("{}"), "least": pick("min{}"), "most": pick("max{}")})
    out = out.withColumn("probes", F.least(F.greatest(F.expr(f"4 * bytes div {most_bytes}"), F.lit(LEAST_PROBES)), F.lit(MOST_PROBES)))
    number = F.row_number().over(Window.orderBy("bucket")).cast("long")
    return out.select("bucket", "digit", "least", F.expr("(most - least) div probes + 1").alias("width"), (F.lit(level << 48) + number * MOST_PROBES).alias("base"), "bytes_below", "rows_below", "held")


def _counted(rows: DataFrame, opened: DataFrame, n: int) -> DataFrame:
    """Exact bytes and rows of the buckets into which open buckets fall, and those below each."""
    ends = [f(f"own_d{k}").alias(f"{name}{k}") for k in range(n) for name, f in (("min", F.min), ("max", F.max))]
    sums = rows.groupBy("bucket").agg(F.sum("own_size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *ends)
    above = opened.select(F.expr(f"base div {MOST_PROBES}").alias("above"), F.col("digit").alias("by"), "bytes_below", "rows_below", "held")
    met = sums.withColumn("above", F.expr(f"bucket div {MOST_PROBES}")).join(F.broadcast(above), "above")
    before = Window.partitionBy("above").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumns({f"{c}_below": F.col(f"{c}_below") + F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("bytes", "rows")})


def _plan(rows: DataFrame, n: int, shards: int, together: float, tolerance: float) -> tuple[list[DataFrame], list[DataFrame]]:
    """(open buckets, counted buckets), a table a level; ``rows`` are ``own_d0, own_d1, ..., own_size``: digits and size."""
    ends = [f(f"own_d{k}").alias(f"{name}{k}") for k in range(n) for name, f in (("min", F.min), ("max", F.max))]
    whole = rows.agg(F.sum("own_size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *ends)
    total, count = whole.select("bytes", "rows").first()
    if not count:
        return [], []
    most_bytes, most_rows = max(1, min(PIECE_BYTES, total // LEAST_PIECES)), max(16, min(PIECE_ROWS, count // LEAST_PIECES))
    middle = f"cast((2 * cast(bytes_below as decimal(38,0)) + bytes) * {shards} div (2 * cast({total} as decimal(38,0))) as int)"
    copies = F.expr(f"by = 0 and min0 = max0 and bytes * {shards} <= {float(together)!r}D * {total}")
    one = F.expr(" and ".join(f"min{k} = max{k}" for k in range(n)))
    cut = F.expr(f"held is null and bytes * {shards} > {float(tolerance)!r}D * {total} and cast(bytes_below as decimal(38,0)) * {shards} div {total} <> (cast(bytes_below + bytes as decimal(38,0)) * {shards} - 1) div {total}")
    start = whole.select(F.lit(0).cast("long").alias("bucket"), "*", F.lit(0).cast("long").alias("bytes_below"), F.lit(0).cast("long").alias("rows_below"), F.lit(None).cast("int").alias("held"), (~one).alias("open"))
    opens, levels = [], []
    buckets, now = start.withColumn("shard", F.expr(middle)).withColumn("tied", one & F.lit(count > 1)), rows.withColumn("bucket", F.lit(0).cast("long"))
    level = 0
    while True:
        buckets = written(buckets, "histogram")
        levels.append(buckets)
        opened = written(_opened(buckets, n, most_bytes, level), "open-buckets")
        if is_empty(opened):
            dropped(opened)
            return opens, levels
        opens.append(opened)
        level += 1
        now = _moved(now, opened, "bucket", "own", n, "inner")
        buckets = _counted(now, opened, n).withColumn("held", F.coalesce("held", F.when(copies, F.expr(middle))))
        more = F.expr(f"bytes > {most_bytes} or rows > {most_rows}") | cut
        buckets = buckets.withColumns({"open": ~one & more, "tied": one & (F.col("rows") > 1) & more, "shard": F.coalesce("held", F.expr(middle))})


def shards(docs: DataFrame, n_shards: int = 8, text_col: str = "text", digits: list[Column] | None = None, together: float = 0.02, tolerance: float = 0.0, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """(the input's rows and columns with one struct column ``size, shard, slot`` more, its name), dealt by one exchange.

    ``digits``: the global order, numbers of at most 60 bits and their sign, none
    null; the first tells the groups that ``together`` keeps whole.  ``tolerance``:
    how far a splitter may lie from its place, as a part of a shard's bytes; 0
    refines it down to single rows.
    """
    bucket, out = (free_name(docs, x) for x in ("shard_bucket", "sharding"))
    own = "own"  # plain columns of this prefix: a struct's fields would be cut out of both sides of the union below by the planner
    while any(c.lower().startswith(f"{own}_") for c in docs.columns):
        own += "_"
    digits = digits or [hash_digit(F.col(text_col)), hash_digit(F.col(id_col))]
    fields = lambda extra: {f"{own}_size": size_of(F.col(text_col))} | {f"{own}_d{k}": d.cast("long") for k, d in enumerate([*digits, extra])}
    n = len(digits) + 1
    alone = lambda df: df.select(*[F.col(f"{own}_{x}").alias(f"own_{x}") for x in ("size", *[f"d{k}" for k in range(n)])])
    placed = docs.withColumns(fields(F.lit(0)))
    narrow = written(alone(placed), "sizes")
    opens, levels = _plan(narrow, n, n_shards, together, tolerance)
    tied = written(_all(levels).where("tied").select(*[f"min{k}" for k in range(n)]), "tied") if levels else None
    if tied is not None and not is_empty(tied):
        # Repeated rows get numbers, which must not change between passes: they are written with them.
        many = tied.select(*[F.col(f"min{k}").alias(f"{own}_min{k}") for k in range(n)])
        same = [F.col(f"{own}_d{k}") == F.col(f"{own}_min{k}") for k in range(n - 1)]
        alike = written(docs.withColumns(fields(F.monotonically_increasing_id())).join(F.broadcast(many), same, "left_semi"), "repeated")
        placed = placed.join(F.broadcast(many), same, "left_anti").unionByName(alike)
        dropped(narrow, *opens, *levels)
        narrow = written(alone(placed), "sizes")
        opens, levels = _plan(narrow, n, n_shards, together, tolerance)
    elif tied is not None:
        dropped(tied)
    dropped(narrow)
    place = placed.withColumn(bucket, F.lit(0).cast("long"))
    for opened in opens:
        place = _moved(place, opened, bucket, own, n, "left")
    pieces = _all(levels).where("not open").select("bucket", "shard", "rows_below") if levels else docs.sparkSession.createDataFrame([], "bucket long, shard int, rows_below long")
    starts = pieces.groupBy("shard").agg(F.min("rows_below").alias("start"))
    pieces = written(pieces.join(starts, "shard").select("bucket", "shard", (F.col("rows_below") - F.col("start")).alias("slot")), "pieces").select(F.struct("*").alias(out))
    dropped(*levels)
    within = F.row_number().over(Window.partitionBy(bucket).orderBy(*[f"{own}_d{k}" for k in range(n)])) - 1
    numbered = place.withColumn(f"{own}_at", within.cast("long"))
    met = numbered.join(pieces, F.col(bucket) == F.col(f"{out}.bucket"))
    return met.withColumn(out, F.struct(F.col(f"{own}_size").alias("size"), F.col(f"{out}.shard"), (F.col(f"{out}.slot") + F.col(f"{own}_at")).alias("slot"))).select(*docs.columns, out), out


def _all(levels: list[DataFrame]) -> DataFrame:
    keep = ["bucket", "shard", "rows_below", "open", "tied", *[c for c in levels[0].columns if c.startswith("min")]]
    return reduce(DataFrame.union, [x.select(*keep) for x in levels])


def sharded(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of eight shards of near equal bytes."""
    out, name = shards(docs.select("doc_id", "text"))
    return out.select("doc_id", f"{name}.size", F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), f"{name}.shard", f"{name}.slot", F.lit(None).cast("int").alias("grown_shard"))


SQL = rf"""
WITH RECURSIVE {CRC_CTES},
d AS (SELECT doc_id, text, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
  coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1) AS a, coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, -1) AS b FROM documents),
o AS (SELECT *, sum(size) OVER (ORDER BY a, b ROWS UNBOUNDED PRECEDING) - size AS below, sum(size) OVER () AS total, row_number() OVER (ORDER BY a, b) AS place FROM d),
g AS (SELECT *, sum(size) OVER (PARTITION BY a) AS copies, min(below) OVER (PARTITION BY a) AS first FROM o),
s AS (SELECT *, (CASE WHEN copies * 8 <= 0.02::DOUBLE * total THEN (2 * first + copies) * 8 // (2 * total) ELSE (2 * below + size) * 8 // (2 * total) END)::INT AS shard FROM g)
SELECT doc_id, size, {crc32_sql("encode(coalesce(text, ''))")} AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INT AS grown_shard FROM s, crc
"""
