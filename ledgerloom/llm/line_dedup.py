"""Line dedup by overlapping windows of three lines, in DataFrame operations only.

Lines are what single newlines part.  Every three consecutive lines are a window
and go by two 64-bit hashes.  The first occurrence of a window, by least
``(doc_id, hash of the text, position)``, stays; the lines that later occurrences cover, merged over
all windows of a document, go.  A later occurrence that overlaps the first one in
the same document spares the first one's own lines, so nothing disappears
altogether.

Windows are summed by hash (least occurrence and count, combined before the
shuffle), so a passage that every document holds is one row for each task; only
windows that repeat are written and joined back.  Their size is then known: few of
them are broadcast, and a larger join shuffles two plain tables whose hot keys can
be split.

Defined cases: texts of under three lines have no window and stay as they are;
windows of nothing but empty lines never count; a null text stays null; a null
``doc_id`` is last in order and such rows stay as they are.  Rows that repeat a
``doc_id`` with other texts are documents of their own; rows equal in both are one
document, each treated as the first occurrence is.  A document whose every line goes has an empty text.  Other columns
are kept as they are, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, written

WINDOW = 3


def _spans(docs: DataFrame) -> DataFrame:
    """Of ``id, key, text``: ``id, key, spans``, the merged and ordered ``(lo, hi)`` of the lines that go, for rows that lose any."""
    lines = docs.where("id is not null and text is not null").select("id", "key", F.split("text", "\n").alias("l")).where(F.size("l") >= WINDOW)
    window = lambda i: F.struct(
        i.cast("int").alias("pos"),
        F.xxhash64(F.get("l", i), F.get("l", i + 1), F.get("l", i + 2)).alias("h"),
        F.xxhash64(F.lit(1), F.get("l", i), F.get("l", i + 1), F.get("l", i + 2)).alias("g"),
        (F.length(F.get("l", i)) + F.length(F.get("l", i + 1)) + F.length(F.get("l", i + 2)) > 0).alias("full"),
    )
    windows = lines.select("id", "key", F.explode(F.transform(F.sequence(F.lit(0), F.size("l") - WINDOW), window)).alias("w")).where("w.full").select("id", "key", "w.pos", "w.h", "w.g")
    # Least occurrence and count of every window, combined before the shuffle (a sort aggregate, since the least is a struct).
    first = windows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "key", "pos")).alias("first")).where("n > 1")
    first = written(first.select("h", "g", F.col("first.id").alias("f_id"), F.col("first.key").alias("f_key"), F.col("first.pos").alias("f_pos")), "windows")
    own = (F.col("id") == F.col("f_id")) & (F.col("key") == F.col("f_key"))
    later = windows.join(first, ["h", "g"]).where(~own | (F.col("pos") != F.col("f_pos")))
    start = F.when(own, F.greatest("pos", F.col("f_pos") + WINDOW)).otherwise(F.col("pos"))
    spans = later.select("id", "key", start.alias("lo"), (F.col("pos") + WINDOW - 1).alias("hi")).where("lo <= hi")
    # Covered positions are merged inside their row: a span that begins past all before it opens a new one.
    order = Window.partitionBy("id", "key").orderBy("lo", "hi")
    opens = F.col("lo") > F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1
    spans = spans.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("id", "key", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def deduped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """(the input's rows and columns, with repeated lines out of ``text_col`` and one struct column ``lines, removed`` more, its name)."""
    own, gone, out = (free_name(docs, x) for x in ("line_own", "line_gone", "line_dedup"))
    text = F.col(text_col).cast("string")
    keyed = docs.withColumn(own, F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text")))
    spans = _spans(keyed.select(f"{own}.id", f"{own}.key", f"{own}.text")).select(F.struct("*").alias(gone))
    joined = keyed.join(spans, (F.col(f"{own}.id") == F.col(f"{gone}.id")) & (F.col(f"{own}.key") == F.col(f"{gone}.key")), "left")
    # What stays lies between the spans: as many slices as spans, and one; the text is split once.
    stays = f"""array_join(get(transform(array(split({own}.text, '\n')), l -> flatten(transform(sequence(0, size({gone}.spans)), k -> slice(l,
        coalesce(get({gone}.spans, k - 1).hi + 2, 1),
        coalesce(get({gone}.spans, k).lo, size(l)) - coalesce(get({gone}.spans, k - 1).hi + 1, 0))))), 0), '\n')"""
    kept = F.when(F.col(f"{gone}.spans").isNull(), F.col(f"{own}.text")).otherwise(F.expr(stays))
    lines = F.when(F.col(f"{own}.text").isNull(), 0).otherwise(F.size(F.split(f"{own}.text", "\n")))
    removed = F.coalesce(F.expr(f"aggregate({gone}.spans, 0, (n, s) -> n + s.hi - s.lo + 1)"), F.lit(0))
    return joined.withColumns({out: F.struct(lines.alias("lines"), removed.alias("removed")), text_col: kept}).select(*docs.columns, out), out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`deduped`, its counts as columns ``__lines`` and ``__removed`` (longer names where the input has these)."""
    out, name = deduped(docs, id_col, text_col)
    return out.select(*docs.columns, F.col(f"{name}.lines").alias(free_name(docs, "__lines")), F.col(f"{name}.removed").alias(free_name(docs, "__removed")))


def line_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row: ``doc_id, n_lines, n_removed, n_chars, text_md5`` of what stays."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, p - 1 AS pos, l[p] AS a, l[p + 1] AS b, l[p + 2] AS c FROM d, LATERAL (SELECT unnest(range(1, len(l) - 1)) AS p) WHERE doc_id IS NOT NULL AND len(l) >= 3),
r AS (SELECT *, first_value(doc_id) OVER o AS f, first_value(pos) OVER o AS fp FROM w WHERE a <> '' OR b <> '' OR c <> '' WINDOW o AS (PARTITION BY a, b, c ORDER BY doc_id, pos)),
s AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = f THEN greatest(pos, fp + 3) ELSE pos END, pos + 3)) AS line FROM r WHERE doc_id <> f OR pos <> fp),
g AS (SELECT doc_id, list(line) AS gone FROM s GROUP BY doc_id),
k AS (SELECT d.doc_id, d.text, l, gone, CASE WHEN gone IS NULL THEN d.text ELSE
  coalesce(array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF NOT list_contains(gone, i - 1)], chr(10)), '') END AS stays FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed, length(stays)::BIGINT AS n_chars, md5(stays) AS text_md5 FROM k
"""
