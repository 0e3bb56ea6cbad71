"""Embedding near-duplicates with randomised-rotation binary codes.

A unit vector is turned by several random rotations, and the signs of its turned
coordinates are stored, once a class of equal vectors, with a correction factor a
rotation: the inner product of the vector and its code.  A code divided by its
factor is the vector plus an error of mean zero at right angles to it.  Half of the
rotations give one such reconstruction of a vector and half another, and the inner
product of one vector's first and another's second is an unbiased estimate of the
cosine, since their rotations are independent.  With ``v`` the errors' variance in
a direction, which the factors tell, the estimate of a pair at the threshold has
variance ``(1 - threshold^2)(v_i + v_j) + v_i v_j (d - 1)`` at most; a pair whose
estimate lies more than ``error`` standard deviations below the threshold is passed
over.  The other pairs are undecided: only their members' original vectors are
fetched, and their cosines are computed in double precision.

Pairs meet in buckets: ``k`` sign bits form a bucket, in ``tables`` independent
tables.  ``k`` grows with the logarithm of the number of vectors, so that a
bucket holds a few hundred, and ``tables`` is such that a pair exactly at the
threshold is missed with probability ``miss`` (and by the bound with that of
``error`` deviations); closer pairs are safer.  Equal vectors are one class from
the start.  A bucket over ``block`` vectors is dealt over blocks that meet two by
two, so its size meets no limit.  A pair that meets in several tables counts in the
first of them alone, which its codes tell, so no list of pairs is shuffled: what is
shuffled are codes, then the vectors of members that have an undecided pair in the
pair's first table, then sums of links and the few links that hold a block's members
together.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are their own component; vectors of different
lengths are not compared.  Rows that repeat a ``vec_id`` are rows of their own,
and as equal vectors link with each other.  A null ``vec_id`` takes part and
names no component.  Labels and other columns are ignored.  An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, spent, written

#: A bucket's number holds the vectors' length, the table and the key.
KEY_BITS, TABLE_BITS = 30, 12
#: Bits that the estimate is to have at least, and the error of factors stored in 16 bits.
LEAST_BITS, SLACK = 256, 2e-3


@lru_cache(maxsize=64)
def rotation(dim: int, index: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    rng = np.random.Generator(np.random.PCG64([dim, index, 97]))
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotations(dim: int, bits: int) -> int:
    """How many rotations give ``bits`` signs, an even number."""
    return 2 * max(1, -(-max(bits, LEAST_BITS) // (2 * dim)))


def codes(unit: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(signs: vectors x rotations x dim, factors: vectors x rotations)."""
    turned = np.stack([unit @ rotation(unit.shape[1], k) for k in range(rotations(unit.shape[1], bits))], axis=1)
    return turned > 0, np.abs(turned).sum(axis=2) / math.sqrt(unit.shape[1])


def rebuilt(signs: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two independent reconstructions, the larger variance of their errors in a direction)."""
    n, count, dim = signs.shape
    out = []
    for half in (0, 1):
        total = np.zeros((n, dim), dtype=np.float32)
        for k in range(half, count, 2):
            x = np.where(signs[:, k], np.float32(1), np.float32(-1)) / (math.sqrt(dim) * factors[:, k, None]).astype(np.float32)
            total += x @ rotation(dim, k).T.astype(np.float32)
        out.append(total / (count / 2))
    spread = [np.maximum(1 / factors[:, half::2] ** 2 - 1, 0).mean(axis=1) / (count / 2) / max(1, dim - 1) for half in (0, 1)]
    return out[0], out[1], np.maximum(*spread)


def _keys(signs: np.ndarray, k: int, tables: int) -> np.ndarray:
    if not k:
        return np.zeros((len(signs), tables), dtype=np.int64)
    power = (1 << np.arange(k, dtype=np.int64))[None, None, :]
    return (signs.reshape(len(signs), -1)[:, : k * tables].reshape(len(signs), tables, k) * power).sum(axis=2)


def plan_tables(n: int, threshold: float, miss: float = 1e-4, fill: int = 512) -> tuple[int, int]:
    """Bits a bucket and tables, for ``n`` vectors."""
    k = max(0, min(KEY_BITS, math.ceil(math.log2(max(1, n / fill)))))
    together = (1 - math.acos(threshold) / math.pi) ** k
    tables = 1 if k == 0 else math.ceil(math.log(miss) / math.log1p(-together))
    if tables >= 1 << TABLE_BITS:
        raise ValueError(f"{tables} tables are needed for threshold {threshold}")
    return k, tables


def _classes(batches):
    for batch in batches:
        column = batch.column(1)
        names, kept = [], []
        for k in range(batch.num_rows):
            x = column[k]
            v = x.values if x.is_valid else None
            if v is None or not len(v) or v.null_count:
                names.append(None)
                kept.append(None)
                continue
            v = np.asarray(v, dtype=np.float64) + 0.0  # -0.0 is 0.0
            if not np.isfinite(v).all() or not v.any():
                names.append(None)
                kept.append(None)
                continue
            raw = v.tobytes()
            names.append(hashlib.blake2b(raw, digest_size=16).digest())
            kept.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(kept, pa.binary())], ["vec_id", "cls", "vec"])


def _unit(raws: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), dtype=np.float64).reshape(len(raws), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _encode(bits: int):
    """(id, vec) -> (id, dim, code): sign bits, then factors in 16 bits each."""

    def run(batches):
        for batch in batches:
            raws = batch.column(1).to_pylist()
            for dim in sorted({len(x) // 8 for x in raws}):
                rows = [i for i, x in enumerate(raws) if len(x) == 8 * dim]
                for lo in range(0, len(rows), 1024):
                    some = rows[lo : lo + 1024]
                    signs, factors = codes(_unit([raws[i] for i in some]), bits)
                    packed = np.packbits(signs.reshape(len(some), -1), axis=1)
                    kept = [p.tobytes() + f.tobytes() for p, f in zip(packed, factors.astype("<f2"), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array([dim] * len(some), pa.int64()), pa.array(kept, pa.binary())], ["id", "dim", "code"])

    return run


def _decode(kept: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(kept), dtype=np.uint8).reshape(len(kept), -1)
    count = next(r for r in range(2, raw.shape[1] + 1, 2) if -(-r * dim // 8) + 2 * r == raw.shape[1])
    cut = -(-count * dim // 8)
    signs = np.unpackbits(raw[:, :cut], axis=1)[:, : count * dim].astype(bool).reshape(-1, count, dim)
    return signs, np.ascontiguousarray(raw[:, cut:]).view("<f2").astype(np.float64)


def _deal(k: int, tables: int, with_code: bool):
    """(id, dim, code) -> one row a table, with its bucket."""

    def run(batches):
        for batch in batches:
            kept, dims = batch.column(2).to_pylist(), batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                keys = _keys(_decode([kept[i] for i in rows], dim)[0], k, tables)
                bucket = (keys + (np.arange(tables, dtype=np.int64) << KEY_BITS)[None, :] + (dim << KEY_BITS + TABLE_BITS)).ravel()
                if not with_code:
                    yield pa.RecordBatch.from_arrays([pa.array(bucket)], ["bucket"])
                    continue
                at = pa.array(np.repeat(rows, tables))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(bucket), batch.column(2).take(at)], ["id", "bucket", "code"])

    return run


def _first_here(keys: np.ndarray, lo: int, hi: int, table: int) -> np.ndarray:
    """Pairs (lo..hi) x all that meet in ``table`` and in none before it."""
    first = np.ones((hi - lo, len(keys)), dtype=bool)
    for t in range(table):
        first &= keys[lo:hi, t, None] != keys[None, :, t]
    return first


def _pairs(n: int, own: np.ndarray, apart: bool, lo: int, hi: int) -> np.ndarray:
    wanted = np.arange(n)[None, :] > np.arange(lo, hi)[:, None]
    return wanted & (own[None, :] != own[lo:hi, None]) if apart else wanted


def _table_of(bucket: int) -> int:
    return bucket >> KEY_BITS & (1 << TABLE_BITS) - 1


def _undecided(k: int, tables: int, threshold: float, error: float):
    """(bucket, part, members) -> (bucket, part, own, id) of members that have an undecided pair here."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for g in range(batch.num_rows):
                bucket, part = batch.column(0)[g].as_py(), batch.column(1)[g].as_py()
                members = batch.column(2)[g].values
                n, dim = len(members), bucket >> KEY_BITS + TABLE_BITS
                own, ids = members.field("own").to_numpy(), members.field("id").to_numpy()
                signs, factors = _decode(members.field("code").to_pylist(), dim)
                keys = _keys(signs, k, tables)
                one, two, v = rebuilt(signs, factors)
                del signs
                apart, alive = own.min() != own.max(), np.zeros(n, dtype=bool)
                for lo in range(0, n, 256):
                    hi = min(n, lo + 256)
                    estimate = (one[lo:hi] @ two.T + two[lo:hi] @ one.T) / 2
                    spread = (1 - threshold**2) * (v[lo:hi, None] + v[None, :]) + v[lo:hi, None] * v[None, :] * (dim - 1)
                    maybe = (estimate >= threshold - SLACK - error * np.sqrt(spread)) & _pairs(n, own, apart, lo, hi)
                    if maybe.any():
                        maybe &= _first_here(keys, lo, hi, _table_of(bucket))
                        alive[lo:hi] |= maybe.any(axis=1)
                        alive |= maybe.any(axis=0)
                for column, values in zip(out, ([bucket] * int(alive.sum()), [part] * int(alive.sum()), own[alive], ids[alive]), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["bucket", "part", "own", "id"])

    return run


def _links(k: int, tables: int, threshold: float, bits: int):
    """(bucket, members) -> (id, links counted here, a class it is linked with), by exact cosines."""

    def run(batches):
        for batch in batches:
            out_id, out_links, out_to = [], [], []
            for g in range(batch.num_rows):
                table = _table_of(batch.column(0)[g].as_py())
                members = batch.column(1)[g].values
                n = len(members)
                ids, own, copies = (members.field(x).to_numpy() for x in ("id", "own", "copies"))
                unit = _unit(members.field("vec").to_pylist())
                keys = _keys(codes(unit, bits)[0], k, tables)
                apart = own.min() != own.max()
                counted, parent = np.zeros(n, dtype=np.int64), np.arange(n)

                def root(i, parent=parent):
                    while parent[i] != i:
                        parent[i] = parent[parent[i]]
                        i = parent[i]
                    return i

                for lo in range(0, n, 256):
                    hi = min(n, lo + 256)
                    real = (unit[lo:hi] @ unit.T >= threshold) & _pairs(n, own, apart, lo, hi)
                    if not real.any():
                        continue
                    real &= _first_here(keys, lo, hi, table)
                    counted[lo:hi] += real @ copies
                    counted += copies[lo:hi] @ real
                    for i, near in enumerate(real, lo):
                        for j in np.flatnonzero(near).tolist():
                            a, b = root(i), root(j)
                            if a != b:
                                parent[max(a, b)] = min(a, b)
                for i in np.flatnonzero(counted):
                    out_id.append(int(ids[i]))
                    out_links.append(int(counted[i]))
                    out_to.append(int(ids[root(int(i))]))
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_links, pa.int64()), pa.array(out_to, pa.int64())], ["id", "links", "to"])

    return run


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, miss: float = 1e-4, error: float = 4.0, block: int = 1024, fill: int = 512) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    vectors = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = written(vectors.mapInArrow(_classes, f"vec_id {id_type}, cls binary, vec binary"), "vectors")
    with spent() as gone:

        def keep(df: DataFrame, name: str) -> DataFrame:
            gone.append(written(df, name))
            return gone[-1]

        classes = rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
        classes = keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbered once, as written
        k, tables = plan_tables(classes.count(), threshold, miss, fill)
        coded = keep(classes.select("id", "vec").mapInArrow(_encode(k * tables), "id long, dim long, code binary"), "codes")
        large = coded.mapInArrow(_deal(k, tables, False), "bucket long").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
        large = keep(large.select(F.col("bucket").alias("full"), F.ceil(F.col("n") / block).cast("int").alias("blocks")), "buckets")
        dealt = coded.mapInArrow(_deal(k, tables, True), "id long, bucket long, code binary")
        met = dealt.join(large, F.col("bucket") == F.col("full"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        met = met.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # Two blocks meet once; a block meets itself in a part of its own, so that each pair is seen once a table.
        met = met.select("id", "bucket", "own", "code", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("part"))
        groups = met.groupBy("bucket", "part").agg(F.collect_list(F.struct("id", "own", "code")).alias("members")).where(F.size("members") > 1)
        alive = keep(groups.mapInArrow(_undecided(k, tables, threshold, error), "bucket long, part int, own int, id long"), "undecided")
        exact = alive.join(classes.select("id", "copies", "vec"), "id").groupBy("bucket", "part").agg(F.collect_list(F.struct("id", "own", "copies", "vec")).alias("members")).select("bucket", "members")
        found = keep(exact.mapInArrow(_links(k, tables, threshold, k * tables), "id long, links long, to long"), "links")
        counts = found.groupBy("id").agg(F.sum("links").alias("links"))
        gone.append(components(found.select(F.col("id").alias("a"), F.col("to").alias("b"))))
        named = gone[-1].withColumnsRenamed({"node": "id"})
        least = named.join(classes.select("id", "vec_id"), "id").groupBy("component").agg(F.min("vec_id").alias("component_id"))
        named = named.join(least, "component").select("id", "component_id")
        of_class = classes.select("id", "cls", F.col("vec_id").alias("own"), (F.col("copies") - 1).alias("same")).join(counts, "id", "left").join(named, "id", "left")
        of_class = written(of_class.select("cls", (F.col("same") + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "own").alias("component_id")), "components")
    out = rows.select("vec_id", "cls").join(of_class, "cls", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
