"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set is its distinct five-word shingles; two documents are linked
when ``100 * |A & B| >= percent * |A | B|`` on the full sets.

1. Documents with equal sets become one class (a grouped minimum, combined
   before its shuffle), so a thousand exact copies cost one row.
2. Every tree sends each class down the path of one minwise token.  Two classes
   of similarity J share a node of one tree with probability J, so the chance
   that ``trees`` independent trees all part a pair is ``(1 - J) ** trees``:
   2.6e-7 at 0.85 with eight trees.
3. Within each node every class is compared with the node's least class, a
   number of pairs in proportion to the rows.  Pairs whose sketches agree enough
   (a pair at the threshold falls short with probability ``miss`` at most, by the
   binomial tail) are confirmed on full sets; the links give components, and a node all of
   whose classes are in one component is done.  Groups of thousands of near
   copies vanish here without their pairs being listed.
4. Nodes of at most ``most`` classes are compared exhaustively between
   components, in blocks of ``block`` that meet two by two.  Larger ones branch:
   each class goes to several children of its node, each named by ``tokens``
   further minwise tokens of its own, so documents that only share a passage
   part.  These tokens are taken from the full sets, anew for every level, tree
   and branch, so trees stay independent; there are as many branches as keep the
   chance that all trees part a pair at the threshold under ``miss`` after
   ``depth - 1`` branchings (``_branches``).  ``depth`` counts the levels; nodes still large at the end are
   compared in blocks like the others, so no pair is dropped for its node's size.
5. The classes of a group whose sketches agree come together with their full
   sets, in parts of a bounded number of shingles; one product of their incidence matrix counts what all pairs share, and
   the group sends on the links that hold its components together: fewer than
   it has members, whatever the number of its pairs.

Sizes of nodes are written before members are joined with them, so that this join
shuffles two plain tables and its hot nodes can be split.

Full sets exist only for classes that share a node with another; they are kept
in a table bucketed by class, so that no later join moves them again.  The table
and all written steps are dropped once the links are known.

Defined cases: null, empty and blank texts have an empty set (``n_shingles`` 0)
and are linked with nothing; a text of one to four words has one shingle, the
whole sequence.  Rows that repeat a ``doc_id`` are judged each by its own text;
rows with a null ``doc_id`` take part and never name a component.  Other columns
of the input are ignored, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import components, delete, free_name, is_empty, new_path, spent, written
from .mixing import WORD

SKETCH = 64


def _rows_of_sketches(id_type: str):
    def run(batches):
        for batch in batches:
            ids, texts, keys = batch.column(0), batch.column(1), batch.column(2)
            for row, end, data, at in S.text_slices(texts):
                hashes, begins = S.shingle_hashes(*S.word_hashes(data, at))
                sketch = S.min_sketches(hashes, begins, SKETCH, 11)
                sizes, classes, kept = [], [], []
                for k in range(end - row):
                    own = np.unique(hashes[begins[k] : begins[k + 1]])
                    sizes.append(len(own))
                    classes.append(S.set_digest(own) if len(own) else None)
                    kept.append(sketch[k].tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays([ids.slice(row, end - row), keys.slice(row, end - row), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(kept, pa.binary())], ["doc_id", "row_key", "n_shingles", "cls", "sketch"])

    return run


def _sets(batches):
    """(cls, text) -> (cls, values) where the text has that class."""
    for batch in batches:
        wanted = batch.column(0).to_pylist()
        names, values = [], []
        for row, own in S.shingle_sets(batch.column(1)):
            if len(own) and S.set_digest(own) == wanted[row]:
                names.append(wanted[row])
                values.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(values, pa.binary())], ["cls", "vals"])


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            a, b, va, vb = (batch.column(k) for k in range(4))
            keep = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(v[k].as_buffer(), dtype=np.uint64) for v in (va, vb))
                same = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return run


def _alike(least: float, percent: int, trees: int):
    """(node, part, tree, level, members) -> (node, part, cls, label): members that resemble one of another label.

    A pair that also meets in a node of the first level that is compared whole, in
    an earlier tree, is left to that node.
    """

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            tree, level = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for g in range(batch.num_rows):
                members = batch.column(4)[g].values
                names, labels = members.field("cls").to_pylist(), members.field("label").to_pylist()
                sketch = np.frombuffer(b"".join(members.field("sketch").to_pylist()), dtype=np.uint32).reshape(len(labels), SKETCH)
                n, small = members.field("n_shingles").to_numpy(), members.field("small").to_numpy()
                _, label = np.unique(np.array(labels, dtype=object), return_inverse=True)
                earlier = np.array([1 << t for t in range(tree[g] if level[g] == 0 else trees)], dtype=np.int64)
                marks = (small[:, None] & earlier[None, :]) != 0
                alike = np.zeros(len(labels), dtype=bool)
                for k in range(len(labels) - 1):
                    rest = slice(k + 1, None)
                    same = sketch[rest] == sketch[k]
                    near = same.mean(axis=1) >= least
                    near &= (label[rest] != label[k]) & (100 * np.minimum(n[rest], n[k]) >= percent * np.maximum(n[rest], n[k]))
                    if near.any() and len(earlier):
                        near &= ~(same[:, : len(earlier)] & marks[k]).any(axis=1)
                    if near.any():
                        alike[k] = True
                        alike[k + 1 :] |= near
                for k in np.flatnonzero(alike):
                    for column, value in zip(out, (batch.column(0)[g].as_py(), batch.column(1)[g].as_py(), names[k], labels[k]), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], ["node", "part", "cls", "label"])

    return run


def _shared(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many values each two of the sets share, exactly."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    times = np.diff(np.append(start, len(values)))
    column = np.repeat(np.cumsum(times > 1) - 1, times)
    inside = np.repeat(times > 1, times)
    column, owner = column[inside], owner[inside]
    counts = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        at = slice(*np.searchsorted(column, [lo, lo + columns]))
        grid = np.zeros((len(sets), columns), dtype=np.float32)
        grid[owner[at], column[at] - lo] = 1
        counts += np.rint(grid @ grid.T).astype(np.int64)
    return counts


def _joined(percent: int):
    """(members: cls, label, vals) -> links, confirmed on full sets, that hold the group's labels together."""

    def run(batches):
        for batch in batches:
            left, right = [], []
            for g in range(batch.num_rows):
                members = batch.column(0)[g].values
                names, labels = members.field("cls").to_pylist(), members.field("label").to_pylist()
                if len(names) < 2:
                    continue
                sets = [np.frombuffer(x, dtype=np.uint64) for x in members.field("vals").to_pylist()]
                size = np.array([len(x) for x in sets])
                shared = _shared(sets)
                parent = {x: x for x in labels}

                def root(x, parent=parent):
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                linked = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
                for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
                    a, b = root(labels[i]), root(labels[j])
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        left.append(names[i])
                        right.append(names[j])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return run


def _agree(least: float):
    """(a, b, sketch of a, sketch of b) -> pairs that agree in enough places."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint32).reshape(-1, SKETCH) for k in (2, 3))
            mask = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _least(percent: int, miss: float) -> float:
    """The share of a sketch in which a pair at the threshold agrees, but for a probability of ``miss``."""
    j, below = percent / 100, 0.0
    for k in range(SKETCH + 1):
        below += math.comb(SKETCH, k) * j**k * (1 - j) ** (SKETCH - k)
        if below > miss:
            return k / SKETCH
    return 1.0


def _branches(percent: int, trees: int, depth: int, tokens: int, miss: float) -> tuple[int, int]:
    """(trees, branches of a node): a pair at the threshold is parted by all trees, at any depth, with probability ``miss`` at most."""
    j = min(max(percent, 1), 99) / 100
    trees = max(trees, math.ceil(math.log(miss / 2) / math.log(1 - j)))
    if trees > SKETCH - 2:
        raise ValueError(f"{trees} trees are needed for {percent} of 100, more than a sketch has")
    if depth < 2:
        return trees, 1
    stay = ((1 - miss ** (1 / trees)) / j) ** (1 / (depth - 1))
    return trees, math.ceil(math.log(1 - stay) / math.log(1 - j**tokens))


def _children(trees: int, branch: int, tokens: int, seed: int, most: int = 1 << 20):
    """(cls, label, at: list of (tree, node), vals) -> (cls, tree, label, node) of the ``branch`` children of every node."""

    def run(batches):
        for batch in batches:
            sizes = np.array([len(v.as_buffer()) // 8 for v in batch.column(3)], dtype=np.int64)
            ends, row = np.cumsum(sizes), 0
            while row < batch.num_rows:
                end = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + most, side="right")))
                part = batch.slice(row, end - row)
                hashes = np.frombuffer(b"".join(part.column(3).to_pylist()), dtype=np.uint64)
                begins = np.concatenate([[0], np.cumsum(sizes[row:end])])
                own = S.min_sketches(hashes, begins, trees * branch * tokens, seed).astype(np.uint64).reshape(end - row, trees, branch, tokens)
                name = np.zeros(own.shape[:3], dtype=np.uint64)
                for k in range(tokens):
                    name = S.mix(name + own[..., k] + np.uint64(1))
                lengths = pa.compute.list_value_length(part.column(2)).to_numpy()
                at = part.column(2).flatten()
                of, tree = np.repeat(np.arange(end - row), lengths), at.field("tree").to_numpy()
                node = S.mix(S.mix(at.field("node").to_numpy().view(np.uint64))[:, None] + name[of, tree])
                take = pa.array(np.repeat(of, branch))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), pa.array(np.repeat(tree, branch), pa.int32()), part.column(1).take(take), pa.array(node.ravel().view(np.int64))], ["cls", "tree", "label", "node"])
                row = end

    return run


def _key(doc_id, text):
    """Tells rows apart by id and text; rows equal in both have one key."""
    return F.xxhash64(doc_id, text)


def _find(docs: DataFrame, percent: int, trees: int, block: int, most: int, depth: int, tokens: int, miss: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``doc_id, text``: (rows ``doc_id, row_key, n_shingles, cls``, classes ``cls, doc_id, row_key``, ``cls, component``), all written."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.withColumn("row_key", _key(F.col("doc_id"), F.col("text")))
    least = _least(percent, miss)
    trees, branch = _branches(percent, trees, depth, tokens, miss)
    sets_name, sets_path = f"ledgerloom_sets_{uuid.uuid4().hex}", new_path(spark, "sets")
    with spent() as gone:
        try:
            return _searched(docs, id_type, sets_name, sets_path, gone, (percent, trees, branch, block, most, depth, tokens, least))
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {sets_name}")
            delete(spark, sets_path)


def _searched(docs: DataFrame, id_type: str, sets_name: str, sets_path: str, gone: list, how: tuple) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = docs.sparkSession
    percent, trees, branch, block, most, depth, tokens, least = how

    def keep(df: DataFrame, name: str) -> DataFrame:
        gone.append(written(df, name))
        return gone[-1]

    rows = written(docs.mapInArrow(_rows_of_sketches(id_type), f"doc_id {id_type}, row_key long, n_shingles long, cls binary, sketch binary"), "sketches")
    classes = written(rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")

    def slot(k):
        return F.substring(F.col("sketch"), 4 * k + 1, 4)

    # Nodes of the first level: a member is one class in one tree.
    members = classes.select("cls", F.posexplode(F.array(*[F.xxhash64(F.lit(k), slot(k)) for k in range(trees)])).alias("tree", "node"))
    nodes = keep(members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("leader")).where("n > 1"), "nodes")
    members = keep(members.join(nodes, "node").select("node", "tree", "cls", "leader"), "members")

    # Full sets of the classes that share any node, bucketed by class: made from the one row that stands for the class.
    shared = members.select("cls").distinct().join(classes.select("cls", "row_key"), "cls")
    texts = docs.select("row_key", "text").join(shared, "row_key").select("cls", "text")
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (texts.mapInArrow(_sets, "cls binary, vals binary").dropDuplicates(["cls"]).repartition(buckets, "cls").write.bucketBy(buckets, "cls").sortBy("cls").option("path", sets_path).saveAsTable(sets_name))
    sets = spark.table(sets_name)

    def confirmed(pairs: DataFrame) -> DataFrame:
        # A leader has many pairs: its set is written apart, so that this join shuffles two plain tables and can be split.
        lead = keep(sets.join(pairs.select(F.col("a").alias("cls")).distinct(), "cls", "left_semi"), "leading")
        both = pairs.join(sets.withColumnsRenamed({"cls": "b", "vals": "vb"}), "b").join(lead.withColumnsRenamed({"cls": "a", "vals": "va"}), "a")
        return keep(both.select("a", "b", "va", "vb").mapInArrow(_confirm(percent), "a binary, b binary"), "confirmed")

    sketches = classes.select("cls", "sketch")
    star = members.where("cls <> leader").select(F.col("leader").alias("a"), F.col("cls").alias("b")).distinct()
    star = star.join(sketches.withColumnsRenamed({"cls": "a", "sketch": "sa"}), "a").join(sketches.withColumnsRenamed({"cls": "b", "sketch": "sb"}), "b")
    links = confirmed(keep(star.select("a", "b", "sa", "sb").mapInArrow(_agree(least), "a binary, b binary"), "agreeing"))
    gone.append(components(links))
    labels = keep(gone[-1].withColumnsRenamed({"node": "cls", "component": "label"}), "labels")

    # Nodes in which more than one component is left, and in which trees a class is in a small one.
    now = members.select("node", "tree", "cls").join(labels, "cls", "left").select("node", "tree", "cls", F.coalesce("label", "cls").alias("label"))
    now = keep(_mixed(now, keep), "mixed")
    marks = now.where(F.col("n") <= most).groupBy("cls").agg(F.bit_or(F.expr("shiftleft(1L, tree)")).alias("small"))
    about = keep(now.select("cls").distinct().join(classes.select("cls", "sketch", "n_shingles"), "cls").join(marks, "cls", "left").withColumn("small", F.coalesce("small", F.lit(0).cast("long"))), "about")

    found = []
    for level in range(depth):
        now = now.withColumn("level", F.lit(level))
        large = now.where(F.col("n") > most)
        last = level == depth - 1 or is_empty(large)
        met = _blocks(now if last else now.where(F.col("n") <= most), block)
        found.append(keep(_compare(met.join(about, "cls"), least, percent, trees), "alike"))
        if last:
            break
        # Children of a tree's nodes are named by further tokens, chosen for the level and the tree.
        nodes_of = large.groupBy("cls").agg(F.first("label").alias("label"), F.collect_list(F.struct("tree", "node")).alias("at"))
        children = nodes_of.join(sets, "cls").select("cls", "label", "at", "vals").mapInArrow(_children(trees, branch, tokens, 12 + level), "cls binary, tree int, label binary, node long")
        children = keep(children, "children")
        now = keep(_mixed(children, keep), "mixed")
    alike = found[0]
    for more in found[1:]:
        alike = alike.union(more)
    # A part whose full sets are large together is dealt again, so that a group is bounded by bytes as well.
    groups = keep(_split(alike, classes.select("cls", "n_shingles"), keep), "groups").join(sets, "cls")
    groups = groups.groupBy("node", "part", "again").agg(F.collect_list(F.struct("cls", "label", "vals")).alias("members")).select("members")
    links = links.union(keep(groups.mapInArrow(_joined(percent), "a binary, b binary"), "confirmed"))
    gone.append(components(links))
    return rows, classes, written(gone[-1].withColumnsRenamed({"node": "cls"}), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, trees: int = 8, block: int = 1024, most: int = 2048, depth: int = 4, tokens: int = 6, miss: float = 1e-5) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept`` (see the module's text)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, classes, named = _find(docs, percent, trees, block, most, depth, tokens, miss)
    least_id = named.join(classes.select("cls", "doc_id"), "cls").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least_id, "component").select("cls", "component_id")
    of_class = written(classes.select("cls", F.col("doc_id").alias("own")).join(named, "cls", "left").select("cls", F.coalesce("component_id", "own").alias("component_id")).where("component_id is not null"), "classes")
    out = rows.select("doc_id", "n_shingles", "cls").join(of_class, "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, trees: int = 8, block: int = 1024, most: int = 2048, depth: int = 4, tokens: int = 6, miss: float = 1e-5) -> DataFrame:
    """The input's rows and columns, with one row of each group of near duplicates.

    The row of least id stays (a null id only where a group has no other), of rows
    with one id that of least row key, of rows equal in id and text any one.  Rows
    without words are linked with nothing, and all stay.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, classes, named = _find(plain, percent, trees, block, most, depth, tokens, miss)
    label = rows.where("cls is not null").select("cls", "doc_id", "row_key").join(named, "cls", "left").select(F.coalesce("component", "cls").alias("component"), "doc_id", "row_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    key = free_name(docs, "row_key")
    stay = written(label.groupBy("component").agg(first).select(F.col("first.row_key").alias(key)), "kept")
    words = F.coalesce(F.col(text_col).cast("string").rlike(WORD), F.lit(False))
    keyed = docs.where(words).withColumn(key, _key(F.col(id_col), F.col(text_col).cast("string")))
    return keyed.join(stay, key, "left_semi").dropDuplicates([key]).select(*docs.columns).union(docs.where(~words))


def _mixed(members: DataFrame, keep) -> DataFrame:
    """Members of the nodes that hold more than one component, with the node's size."""
    nodes = members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return members.join(keep(nodes.select("node", "n"), "nodes"), "node")


def _compare(members: DataFrame, least: float, percent: int, trees: int) -> DataFrame:
    """Members of groups of a bounded size whose sketches agree with another's."""
    lists = members.groupBy("node", "part", "tree", "level").agg(F.collect_list(F.struct("cls", "label", "sketch", "n_shingles", "small")).alias("members"))
    return lists.mapInArrow(_alike(least, percent, trees), "node long, part int, cls binary, label binary")


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """Nodes of any size: members are dealt over blocks, and each two blocks meet in one group of about 2 * block at most."""
    return _meeting(members.withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int")), "part")


def _meeting(members: DataFrame, part: str) -> DataFrame:
    """Members dealt over ``blocks`` blocks; each two blocks meet in one ``part``."""
    dealt = members.withColumn("own", F.pmod(F.xxhash64("cls", F.lit(part)), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumn(part, F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).drop("blocks", "own", "other")


def _split(alike: DataFrame, sizes: DataFrame, keep, most_shingles: int = 1 << 18, most_sets: int = 400) -> DataFrame:
    """Groups, dealt again over blocks that meet two by two where they have more sets, or sets of more shingles together, than a block takes."""
    sized = keep(alike.join(sizes, "cls"), "alike")
    blocks = F.greatest(F.ceil(F.sum("n_shingles") / F.lit(most_shingles)), F.ceil(F.count(F.lit(1)) / F.lit(most_sets)))
    weight = keep(sized.groupBy("node", "part").agg(blocks.cast("int").alias("blocks")), "weights")
    return _meeting(sized.join(weight, ["node", "part"]), "again").select("node", "part", "again", "cls", "label")
