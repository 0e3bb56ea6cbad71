"""Prefix trie of sequences by a Cartesian tree over their LCP array.

A sequence is an id, a key of 16 bytes an element (its MD5) and the elements'
weights.  Sequences are put in order by key and id (range partitions, so equal
ones are split by id), and the elements that each shares with the one before it
are its LCP.  Nodes of the trie are intervals of this order:

* All nearest smaller values: for a position of LCP ``v``, the nearest positions
  with a smaller one to its left and right bound the members of a node of depth ``v``.  Blocks of
  a range partition find theirs with a stack.  What a block leaves open is looked
  up in the block minima, and then in the falling minima of the block found.
* Positions of equal interval and LCP are one node (a grouped minimum).  Depths
  between a node's and its parent's have the same members and are expanded;
  what only one sequence has is a path of its own below its deepest shared node.
* Members are an interval's length.  Leaves and saved weight are differences of
  running sums: position ``p`` repeats the weight of its first ``LCP`` elements.
  The least id is combined from parts of blocks and whole blocks.

Blocks hold ``max(256, sqrt(sequences))`` rows, so the table of block minima has about
``sqrt(sequences)`` rows besides one a range partition; it alone passes through the driver, as
arrays.  Ids of the sequences that end at a node are joined by block and
hashed as a stream, block after block, so a sequence that a third of the table
repeats fills no memory.  A sequence's key and weights (24 bytes an element) are one row.

Defined cases: sequences may be empty (members of the root alone); equal
sequences are counted each; an empty table gives no nodes.  :func:`rebuilt` says
what it does with nulls.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC_CTES, crc32_sql, spent, written

DIGEST, LEAST_BLOCK, FAR = 16, 256, np.iinfo(np.int64).max


def rebuilt(turns: DataFrame, group: int = 100, most_shared: int = 6, gone: list[DataFrame] | None = None) -> DataFrame:
    """``id, key, weights`` of conversations that begin with turns of their group's first one.

    Of ``conv_id, turn, role, text``: turns are ordered by ``turn``, null first, those of one number by
    role and the text's MD5; null roles and texts are empty; rows without a ``conv_id`` belong to
    no conversation and are left out.  The first ``crc32(conv_id) % most_shared`` turns
    come from conversation ``conv_id - conv_id % group``, if there is one.  ``gone`` takes
    the written step that the result reads.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, F.md5(text.cast("binary"))).cast("binary"))
    one = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("text"), digest.alias("digest"), F.length(text).cast("long").alias("weight"))
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("id"), one.alias("t"))
    own = own.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t.digest.alias("digest"), t.weight.alias("weight"))).alias("own"))
    own = written(own, "conversations")
    if gone is not None:
        gone.append(own)
    heads = own.where(F.col("id") % group == 0).select(F.col("id").alias("of"), F.slice("own", 1, most_shared - 1).alias("head"))
    shared = F.crc32(F.col("id").cast("string").cast("binary")) % most_shared
    both = own.withColumns({"of": F.col("id") - F.col("id") % group, "h": shared.cast("int")}).join(heads, "of", "left")
    none = F.expr("cast(array() as array<struct<digest:string,weight:bigint>>)")
    all_ = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    return both.select("id", all_.alias("all")).select("id", F.unhex(F.array_join("all.digest", "")).alias("key"), F.col("all.weight").alias("weights"))


def _shared(a: bytes, b: bytes) -> int:
    """Elements at the start of both keys."""
    lo, hi = 0, min(len(a), len(b)) // DIGEST
    if a[: hi * DIGEST] == b[: hi * DIGEST]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo * DIGEST : mid * DIGEST] == b[lo * DIGEST : mid * DIGEST]:
            lo = mid
        else:
            hi = mid
    return lo


PLACED = "part int, seq long, id long, key binary, len long, lcp long, prev_len long, prev_id long, sums array<long>"


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range partition, in order, with the elements shared with the row before (null for the first)."""
    part, seq, last, last_id = TaskContext.get().partitionId(), 0, None, None
    for batch in batches:
        keys, ids = batch.column("key").to_pylist(), batch.column("id").to_pylist()
        before = [last, *keys[:-1]] if keys else []
        before_ids = [last_id, *ids[:-1]] if keys else []
        weights = batch.column("weights")
        at = weights.offsets.to_numpy()
        flat = np.append(0, np.cumsum(weights.values.to_numpy(zero_copy_only=False)))
        sums = flat[1:][at[0] : at[-1]] - np.repeat(flat[at[:-1]], np.diff(at))
        n = len(keys)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64()), batch.column("id"), batch.column("key"), pa.array([len(k) // DIGEST for k in keys], pa.int64()),
                pa.array([None if a is None else _shared(a, k) for a, k in zip(before, keys, strict=True)], pa.int64()),
                pa.array([None if a is None else len(a) // DIGEST for a in before], pa.int64()), pa.array(before_ids, pa.int64()),
                pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(sums, pa.int64())),
            ],
            ["part", "seq", "id", "key", "len", "lcp", "prev_len", "prev_id", "sums"],
        )
        if keys:
            seq, last, last_id = seq + n, keys[-1], ids[-1]


def _placed(sequences: DataFrame, block: int, keep) -> DataFrame:
    """Sequences in order: ``part, seq, block`` with LCP, the weight ``x`` that it repeats, and whether the sequence before is a leaf."""
    inside = keep(sequences.select("id", "key", "weights").repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(_adjacent, PLACED), "ordered")
    # One row a partition: what its first row shares with the last one of the partition before.
    last = inside.groupBy("part").agg(F.max("seq").alias("seq")).join(inside.select("part", "seq", F.col("key").alias("last"), F.col("len").alias("last_len"), F.col("id").alias("last_id")), ["part", "seq"])
    edge = last.join(inside.where("seq = 0").select("part", F.col("key").alias("first"), F.col("len").alias("first_len")), "part")
    order = Window.orderBy("part")
    edge = edge.select("part", "first", "first_len", *[F.lag(c).over(order).alias(c) for c in ("last", "last_len", "last_id")])
    same = F.expr(f"coalesce(array_min(filter(sequence(0, cast(least(first_len, last_len) as int)), i -> i = least(first_len, last_len) or substring(first, i * {DIGEST} + 1, {DIGEST}) <> substring(last, i * {DIGEST} + 1, {DIGEST}))), -1)")
    edge = keep(edge.select("part", F.when(F.col("last").isNull(), -1).otherwise(same).cast("long").alias("edge_lcp"), "last_len", "last_id"), "edges")
    rows = inside.drop("key").join(F.broadcast(edge), "part")
    first = F.col("seq") == 0
    rows = rows.withColumns({"lcp": F.when(first, F.col("edge_lcp")).otherwise(F.col("lcp")), "prev_len": F.when(first, F.col("last_len")).otherwise(F.col("prev_len")), "prev_id": F.when(first, F.col("last_id")).otherwise(F.col("prev_id"))})
    x = F.when(F.col("lcp") > 0, F.get("sums", (F.col("lcp") - 1).cast("int"))).otherwise(0)
    return rows.select("part", "seq", F.expr(f"seq div {block}").alias("block"), "id", "len", "lcp", "prev_len", "prev_id", "sums", x.cast("long").alias("x"), F.coalesce(F.col("lcp") < F.col("prev_len"), F.lit(False)).cast("long").alias("leaf"))


class Blocks:
    """The blocks in order: size, least LCP and id, first LCP, and what lies before each."""

    def __init__(self, rows: DataFrame):
        stats = rows.groupBy("part", "block").agg(F.count(F.lit(1)).alias("n"), F.min("lcp").alias("low"), F.min("id").alias("id"), F.min_by("lcp", "seq").alias("first"), F.sum("x").alias("x"), F.sum("leaf").alias("leaf"))
        table = sorted(map(tuple, stats.collect()))
        self.number = {(part, block): k for k, (part, block, *_) in enumerate(table)}
        n, self.low, self.id, self.first, x, leaf = (np.array([t[k] for t in table], dtype=np.int64) for k in range(2, 8))
        self.start, self.x, self.leaf = (np.append(0, np.cumsum(c)) for c in (n, x, leaf))

    def left(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Running minima of LCP and id over the blocks before ``b``, the nearest first."""
        return np.minimum.accumulate(self.low[:b][::-1]), np.minimum.accumulate(self.id[:b][::-1])

    def right(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum.accumulate(self.low[b + 1 :]), np.minimum.accumulate(self.id[b + 1 :])


#: kind 0: a position with its nearest smaller values; 1 and 2: a falling minimum that answers blocks to the right and to the left; 3 and 4: what a block asks to its left and right.
NEARER = "kind int, block long, p long, id long, len long, v long, next long, prev_len long, prev_id long, sums array<long>, l long, l_lcp long, l_leaf long, l_x long, l_id long, r long, r_lcp long, r_leaf long, r_x long, r_id long, target long, upper long"


def _nearest(key: tuple, table: pa.Table, blocks: Blocks) -> pa.Table:
    """Nearest smaller values within one block, its falling minima, and what it asks of other blocks."""
    t = table.sort_by("seq")
    b = blocks.number[key[0].as_py(), key[1].as_py()]
    lcp, ids, x, leaf = (t.column(c).to_pylist() for c in ("lcp", "id", "x", "leaf"))
    n, start, end = t.num_rows, int(blocks.start[b]), len(blocks.number)
    # Leaves up to a position, and weight repeated before and up to it.
    upto = (int(blocks.leaf[b]) + np.cumsum(np.array(leaf, dtype=np.int64))).tolist()
    ix = (int(blocks.x[b]) + np.cumsum(np.array(x, dtype=np.int64))).tolist()
    ex = [a - w for a, w in zip(ix, x, strict=True)]
    left, right = [None] * n, [None] * n  # (position, lcp, leaves, weight), where in this block
    l_id, r_id = ids[:], ids[:]  # least id from the left bound to the position; from it to the right bound
    for order, out, least, weight in ((range(n), left, l_id, ix), (range(n - 1, -1, -1), right, r_id, ex)):
        stack: list[tuple[int, int]] = []
        for p in order:
            low = ids[p]
            while stack and lcp[stack[-1][0]] >= lcp[p]:
                low = min(low, stack.pop()[1])
            least[p] = low
            if stack:
                q = stack[-1][0]
                out[p] = (start + q, lcp[q], upto[q], weight[q])
                if out is left:
                    least[p] = min(low, ids[q])
            stack.append((p, low))
    rows: dict[str, list] = {c.split()[0]: [] for c in NEARER.split(", ")}

    def add(**values) -> None:
        for c, column in rows.items():
            column.append(values.get(c))

    # Falling minima: of the block's end backwards, and of its start forwards.
    for kind, order, weight in ((1, range(n - 1, -1, -1), ix), (2, range(n), ex)):
        low, upper = FAR, FAR
        for p in order:
            if kind == 1:
                low = min(low, ids[p])
            if lcp[p] < upper:
                add(kind=kind, block=b, p=start + p, v=lcp[p], upper=upper, l_leaf=upto[p], l_x=weight[p], l_id=low)
                upper = lcp[p]
            if kind == 2:
                low = min(low, ids[p])
    beyond = (int(blocks.start[-1]), -1, int(blocks.leaf[-1]) + 1, int(blocks.x[-1]))
    for kind, near, (lows, least), step in ((3, left, blocks.left(b), -1), (4, right, blocks.right(b), 1)):
        # Running minima fall, so the first block that is low enough is found by binary search.
        open_ = sorted({v for v, found in zip(lcp, near, strict=True) if found is None and v >= 0})
        for v, k in zip(open_, np.searchsorted(-lows, -np.array(open_, dtype=np.int64), side="right").tolist(), strict=True):
            between = int(least[k - 1]) if k else FAR
            if k < len(lows):
                add(kind=kind, block=b, v=v, target=b + step * (k + 1), l_id=between)
            else:  # nothing to the right is smaller: the end of all sequences is
                for p in range(n):
                    if lcp[p] == v and right[p] is None:
                        right[p], r_id[p] = beyond, min(r_id[p], between)
    names = ("", "_lcp", "_leaf", "_x")
    after = [*lcp[1:], int(blocks.first[b + 1]) if b + 1 < end else -1]
    made = {"kind": [0] * n, "block": [b] * n, "p": list(range(start, start + n)), "id": ids, "len": t.column("len"), "v": lcp, "next": after, "prev_len": t.column("prev_len"), "prev_id": t.column("prev_id"), "sums": t.column("sums"), "l_id": l_id, "r_id": r_id}
    for side, near in (("l", left), ("r", right)):
        made |= {side + name: [None if x is None else x[k] for x in near] for k, name in enumerate(names)}
    kinds = {"kind": pa.int32(), "sums": pa.list_(pa.int64())}
    schema = pa.schema([(c, kinds.get(c, pa.int64())) for c in rows])
    columns = lambda m, size: pa.table({c: pa.chunked_array(m[c].chunks, schema.field(c).type) if isinstance(m.get(c), pa.ChunkedArray) else pa.array(m.get(c, [None] * size), schema.field(c).type) for c in rows})
    return pa.concat_tables([columns(made, n), columns(rows, len(rows["kind"]))])


def _positions(rows: DataFrame, keep) -> DataFrame:
    """Every position with the interval of its LCP: bounds, least id, leaves, repeated weight, and the parent's depth and position."""
    blocks = Blocks(rows)
    found = keep(rows.groupBy("part", "block").applyInArrow(_finder(blocks), NEARER), "nearest")
    answers = []
    for kind, side in ((3, "l"), (4, "r")):
        minima = found.where(F.col("kind") == kind - 2).select(F.col("block").alias("target"), F.col("p"), F.col("v").alias("low"), "upper", "l_leaf", "l_x", F.col("l_id").alias("part_id"))
        asked = found.where(F.col("kind") == kind).select("block", "v", "target", F.col("l_id").alias("between"))
        known = asked.select("target", "v").distinct().join(minima, "target").where("low < v and v <= upper")
        answer = asked.join(known, ["target", "v"])
        answers.append(answer.select("block", "v", *[F.col(c).alias(f"{side}_{name}") for c, name in (("p", "at"), ("low", "low"), ("l_leaf", "upto"), ("l_x", "w"))], F.least("between", "part_id").alias(f"{side}_least")))
    out = found.where("kind = 0")
    for answer in answers:
        out = out.join(answer, ["block", "v"], "left")
    for s in "lr":
        open_ = F.col(s).isNull()
        pick = lambda own, theirs: F.when(open_, F.col(theirs)).otherwise(F.col(own))
        least = F.when(open_, F.least(f"{s}_id", f"{s}_least")).otherwise(F.col(f"{s}_id"))
        out = out.withColumns({f"{s}_id": least, f"{s}_lcp": pick(f"{s}_lcp", f"{s}_low"), f"{s}_leaf": pick(f"{s}_leaf", f"{s}_upto"), f"{s}_x": pick(f"{s}_x", f"{s}_w"), s: F.coalesce(s, f"{s}_at")})
    depth = F.greatest("l_lcp", "r_lcp")
    # Weights before each of the depths between the parent's and the node's own.
    before = F.transform(F.sequence(depth + 1, "v"), lambda d: F.when(d > 1, F.get("sums", (d - 2).cast("int"))).otherwise(0))
    return written(
        out.select(
            "block", "p", "id", "len", "v", "next", "prev_len", "prev_id", "l", (F.col("r") - F.col("l")).alias("n"), F.least("l_id", "r_id").alias("least"), (F.col("r_leaf") - F.col("l_leaf")).alias("leaves"),
            (F.col("r_x") - F.col("l_x")).alias("x"), depth.alias("above"), F.when(F.col("l_lcp") >= F.col("r_lcp"), F.col("l")).otherwise(F.col("r")).alias("parent"), F.when(F.col("v") >= 0, before).alias("before"),
        ),
        "positions",
    )


def _finder(blocks: Blocks):
    def near(key: tuple, table: pa.Table) -> pa.Table:
        return _nearest(key, table, blocks)

    return near


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each node, whose blocks come one after the other."""
    now, state, count = None, None, 0
    names = ["l", "v", "ends", "ends_sha256"]
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if (row["l"], row["v"]) != now:
                if now is not None:
                    done.append((*now, count, state.hexdigest()))
                now, state, count = (row["l"], row["v"]), hashlib.sha256(), 0
            state.update((b"," if count else b"") + row["ids"].encode())
            count += row["n"]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names)
    if now is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*now, count, state.hexdigest()), strict=True))])


def _ends(at: DataFrame) -> DataFrame:
    """``l, v, ends, ends_sha256`` of nodes of two or more members at which sequences end."""
    event = lambda when, order, who: F.when(when, F.struct((2 * F.col("p") + order).alias("order"), F.col(who).alias("who")))
    events = F.array_compact(F.array(event((F.col("prev_len") == F.col("v")), 0, "prev_id"), event((F.col("len") == F.col("v")) & (F.col("next") < F.col("v")), 1, "id")))
    each = at.where("v >= 0").select("l", "v", "block", F.explode(events).alias("e"))
    parts = each.groupBy("l", "v", "block").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("e")).alias("e"))
    parts = parts.select("l", "v", "block", "n", F.array_join(F.transform("e.who", lambda i: i.cast("string")), ",").alias("ids"))
    return parts.repartition("l", "v").sortWithinPartitions("l", "v", "block").mapInArrow(_hashed, "l long, v long, ends long, ends_sha256 string")


def trie_nodes(sequences: DataFrame) -> DataFrame:
    """One row a node of the trie of ``id, key, weights``.

    ``conv_id`` (least member), ``depth, parent_conv_id, n_convs, n_children, n_leaves``;
    ``saved_tokens``: over the node's subtree, members but one times the weight of the last
    element; ``ends_sha256``: of the comma-joined ids, ascending, that end there.
    """
    with spent() as gone:

        def keep(df: DataFrame, name: str) -> DataFrame:
            gone.append(written(df, name))
            return gone[-1]

        sequences = keep(sequences, "sequences")
        block = max(LEAST_BLOCK, math.isqrt(sequences.count()))
        at = _positions(_placed(sequences, block, keep), keep)  # written: all that the result reads
    nodes = at.where("v >= 0").groupBy("l", "v").agg(F.min("p").alias("p"), *[F.min(c).alias(c) for c in ("n", "least", "leaves", "x", "above", "parent")], F.count_if(F.col("len") > F.col("v")).alias("kids"))
    nodes = nodes.join(at.select("p", "before"), "p").join(_ends(at), ["l", "v"], "left")
    empty = F.sha2(F.lit(b""), 256)
    # The first member has a child of its own below the node unless it ends there.
    shared = nodes.select(F.col("least").alias("conv_id"), "n", (F.col("above") + 1).alias("top"), F.col("v").alias("bottom"), (F.col("kids") + F.col("ends").isNull().cast("long")).alias("kids"), "leaves", "x", "above", "parent", "before", F.coalesce("ends_sha256", empty).alias("ends"))
    alone = F.greatest("v", "next")
    single = at.where(F.col("len") > alone).select(
        F.col("id").alias("conv_id"), F.lit(1).cast("long").alias("n"), (alone + 1).alias("top"), F.col("len").alias("bottom"), F.lit(0).cast("long").alias("kids"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("x"),
        alone.alias("above"), F.when(F.col("v") >= F.col("next"), F.col("p")).otherwise(F.col("p") + 1).alias("parent"), F.expr("cast(array() as array<bigint>)").alias("before"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("ends"),
    )
    paths = shared.unionByName(single).join(at.select(F.col("p").alias("parent"), F.col("least").alias("up")), "parent", "left")
    node = paths.select("*", F.explode(F.sequence("top", "bottom")).alias("depth"))
    last, top = F.col("depth") == F.col("bottom"), F.col("depth") == F.col("top")
    return node.select(
        "conv_id", "depth", F.when(~top, F.col("conv_id")).when(F.col("above") >= 0, F.col("up")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, F.col("kids")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("x") - (F.col("n") - 1) * F.coalesce(F.get("before", (F.col("depth") - F.col("top")).cast("int")), F.lit(0))).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(empty).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    with spent() as gone:
        return trie_nodes(rebuilt(conversations.select("conv_id", "turn", "role", "text"), gone=gone))


SQL = f"""
WITH RECURSIVE {CRC_CTES},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32_sql("encode(conv_id::VARCHAR)")} % 6 AS h, conv_id - conv_id % 100 AS b FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = b AND pos < h UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= h),
s AS (SELECT conv_id, coalesce(list(struct_pack(role, text) ORDER BY own, pos) FILTER (WHERE pos IS NOT NULL), []) AS s FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
m AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM s),
n AS (SELECT s[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(s) = d), '') AS ends FROM m GROUP BY s[1:d], d),
k AS (SELECT k[1:d - 1] AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY k[1:d - 1]),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (k)),
u AS (SELECT k[1:e] AS k, sum(CASE WHEN d > 0 THEN (n - 1) * length(k[d].text) ELSE 0 END) AS saved, count(*) FILTER (WHERE kids = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM f) GROUP BY k[1:e])
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n::BIGINT AS n_convs, f.kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN u USING (k) LEFT JOIN n p ON f.d > 0 AND p.d = f.d - 1 AND p.k = f.k[1:f.d - 1]
"""
