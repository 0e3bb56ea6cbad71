"""Merkle fixity audit of WARC replicas.

Pages become WARC response records.  The digests of records, ordered by id and
so by offset, are the leaves of a tree: a node holds the records whose id falls in
its range, and is the SHA-256 of its children's numbers and digests in order,
``2 ** bits`` children a node, up to one root.  Each node keeps its parent's number
in a column, ``up``, which every later step uses: it is the number shifted right,
also for negative ids; records without an id go up a line of their own and meet
the others in the root.  Both replicas' trees are built to one height, from the
least and greatest id of either.

Byte offsets come from the same tree: a node knows its bytes, and a running sum
inside each parent, added down the levels, gives each record's offset without
ordering all records in one task.

An audit compares two replicas' roots and goes down only into nodes that differ:
each level joins the children of differing parents alone, so an intact replica
costs one comparison, and a damaged record one path.

Records that repeat an id, and all without one, share a leaf.  Its digest covers
how many they are and the sums of their digests' parts, which are combined before
the shuffle, so no leaf gathers its records.

Defined cases: a null page body or address is the empty text; rows with a null id
are one leaf together, last in order; repeated rows are counted (an extra copy is
``corrupt``); a missing record is ``missing``, one that only the replica has is
``extra``.  Other columns are ignored.  Two empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, is_empty, written

BITS = 8


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``page_id, record``: a WARC/1.1 response record for each row."""
    url, body = F.coalesce(F.col(url_col).cast("string"), F.lit("")), F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), body)
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(">\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(http).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.concat(head, http, F.lit("\r\n\r\n")).alias("record"))


def leaves(recs: DataFrame) -> DataFrame:
    """``node, digest, bytes``: one leaf an id (written)."""
    each = recs.select(F.col("page_id").alias("node"), F.sha2("record", 256).alias("d"), F.octet_length("record").cast("long").alias("n"))
    widths = [15, 15, 15, 15, 4]  # hexadecimal digits: each part is a number of 60 bits at most
    parts = [F.conv(F.substring("d", 1 + sum(widths[:k]), w), 16, 10).cast("decimal(20,0)") for k, w in enumerate(widths)]
    grouped = each.groupBy("node").agg(F.count(F.lit(1)).alias("times"), F.sum("n").alias("bytes"), *[F.sum(x).alias(f"p{k}") for k, x in enumerate(parts)])
    own = F.concat(*[F.lower(F.lpad(F.hex(F.col(f"p{k}").cast("long")), w, "0")) for k, w in enumerate(widths)])
    all_of = F.sha2(F.concat_ws(",", "times", *[f"p{k}" for k in range(len(widths))]), 256)
    return written(grouped.select("node", F.when(F.col("times") == 1, own).otherwise(all_of).alias("digest"), "bytes"), "leaves")


def height(*bottoms: DataFrame, bits: int = BITS) -> int:
    """Levels under the root that hold the ids of all these leaves."""
    ends = [x.agg(F.min("node"), F.max("node")).first() for x in bottoms]
    ids = [i for pair in ends for i in pair if i is not None] or [0]
    lo, hi, levels = min(ids), max(ids), 1
    while hi - lo >= 1 << bits:
        lo, hi, levels = lo >> bits, hi >> bits, levels + 1
    return levels


def tree(bottom: DataFrame, levels: int, bits: int = BITS) -> list[DataFrame]:
    """Levels ``node, up, digest, bytes, before`` from the leaves to the root, which is number 0.

    ``before``: bytes of the siblings that stand before the node.
    """
    out, now = [], bottom
    for k in range(levels + 1):
        up = F.shiftright("node", bits) if k < levels - 1 else F.lit(0).cast("long")
        siblings = Window.partitionBy("up").orderBy(F.col("node").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        level = now.withColumn("up", up)
        out.append(level.withColumn("before", F.coalesce(F.sum("bytes").over(siblings), F.lit(0))))
        if k < levels:
            kids = F.array_sort(F.collect_list(F.struct("node", "digest")))
            text = F.array_join(F.transform(kids, lambda x: F.concat_ws(":", x["node"].cast("string"), x["digest"])), ",")
            now = written(level.groupBy("up").agg(F.sha2(text, 256).alias("digest"), F.sum("bytes").alias("bytes")).withColumnRenamed("up", "node"), "nodes")
    return out


def offsets(levels: list[DataFrame]) -> DataFrame:
    """``node, digest, bytes, offset`` of the leaves."""
    above = levels[-1].withColumn("offset", F.lit(0).cast("long"))
    for level in reversed(levels[:-1]):
        over = above.select(F.col("node").alias("parent"), F.col("offset").alias("base"))
        above = level.join(over, F.col("up").eqNullSafe(F.col("parent"))).withColumn("offset", F.col("before") + F.col("base")).select("node", "digest", "bytes", "offset")
    return above


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """``node, digest, other``: leaves that differ; a digest is null where a side lacks the leaf."""

    def differ(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(F.col("node").alias("there"), F.col("digest").alias("other"))
        both = a.select("node", "digest").join(b, F.col("node").eqNullSafe(F.col("there")), "full")
        return both.where(~F.col("digest").eqNullSafe(F.col("other"))).select(F.coalesce("node", "there").alias("node"), "digest", "other")

    found = None
    for a, b in zip(reversed(ours), reversed(theirs), strict=True):
        if found is not None:
            parents = found.select(F.col("node").alias("suspect"))
            a, b = (x.join(parents, F.col("up").eqNullSafe(F.col("suspect")), "left_semi") for x in (a, b))
        before, found = found, written(differ(a, b), "suspects")
        if before is not None:
            dropped(before)
        if is_empty(found):
            return found
    return found


def fixity(ours: DataFrame, theirs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per leaf of either replica: ``page_id, offset, bytes, digest, status`` of records from :func:`records`."""
    bottoms = [leaves(x) for x in (ours, theirs)]
    levels = height(*bottoms, bits=bits)
    a, b = (tree(x, levels, bits) for x in bottoms)
    bad = audit(a, b)
    status = F.when(F.col("digest").isNull(), "extra").when(F.col("other").isNull(), "missing").otherwise("corrupt")
    bad = bad.select(F.col("node").alias("at"), status.alias("status"), F.coalesce("digest", "other").alias("seen"))
    out = offsets(a).join(bad, F.col("node").eqNullSafe(F.col("at")), "full")
    return out.select(F.coalesce("node", "at").alias("page_id"), "offset", "bytes", F.coalesce("digest", "seen").alias("digest"), F.coalesce("status", F.lit("ok")).alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica as a failing disk might leave it: some bodies cut or changed, some records lost, some added."""
    body = F.when(F.col("page_id") % 97 == 5, F.expr("concat('#', substring(html, 2))")).when(F.col("page_id") % 101 == 7, F.expr("substring(html, 1, length(html) - 1)")).otherwise(F.col("html"))
    rest = pages.where("page_id % 103 <> 11").select("page_id", "url", body.alias("html"))
    return rest.union(pages.where("page_id % 107 = 13").select(F.col("page_id") + 1_000_000_000_000, "url", "html"))


SQL = r"""
WITH h AS (SELECT page_id, url, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) AS head, html FROM pages),
v AS (SELECT page_id, url, head || html AS http, 1 AS side FROM h
  UNION ALL SELECT page_id, url, head || CASE WHEN page_id % 97 = 5 THEN '#' || substr(html, 2) WHEN page_id % 101 = 7 THEN substr(html, 1, length(html) - 1) ELSE html END, 2 FROM h WHERE page_id % 103 <> 11
  UNION ALL SELECT page_id + 1000000000000, url, head || html, 2 FROM h WHERE page_id % 107 = 13),
r AS (SELECT page_id, side, 'WARC/1.1' || n || 'WARC-Type: response' || n || 'WARC-Target-URI: ' || url || n || 'WARC-Record-ID: <urn:page:' || page_id || '>' || n ||
  'Content-Type: application/http; msgtype=response' || n || 'Content-Length: ' || strlen(http) || n || n || http || n || n AS record FROM v, (SELECT chr(13) || chr(10) AS n)),
x AS (SELECT page_id, side, sha256(record) AS digest, strlen(record)::BIGINT AS bytes FROM r),
a AS (SELECT page_id, digest, bytes, coalesce(sum(bytes) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM x WHERE side = 1),
b AS (SELECT page_id, digest AS other FROM x WHERE side = 2)
SELECT page_id, "offset", bytes, coalesce(digest, other) AS digest,
  CASE WHEN digest = other THEN 'ok' WHEN digest IS NULL THEN 'extra' WHEN other IS NULL THEN 'missing' ELSE 'corrupt' END AS status FROM a FULL JOIN b USING (page_id)
"""
