"""Packing token sequences as a cutting-stock problem solved by column generation.

1. Every text becomes token ids and an end id; a document is cut at multiples of
   the sequence length, so it has whole pieces and one remainder.
2. The histogram of piece lengths, in units of ``unit`` tokens rounded up, is all
   that leaves the executors: at most ``length / unit`` numbers, for any corpus.
3. A linear program over patterns (which lengths share a sequence) is solved on
   that histogram: a revised simplex keeps one pattern a length, and a knapsack
   dynamic program prices new patterns until none lowers the number of sequences.
4. Patterns are rounded down; the few pieces left are put together by first fit
   on the counts.  The plan is a table of (length, pattern, first rank, copies).
5. Pieces are ranked within their length: counts by (length, hash bucket; a bucket
   holds about a thousand pieces, however many a length has) give
   each bucket its first rank, and only a bucket's rows are numbered together, so
   a length that half of all documents have is no hot group.  A rank gives the
   pattern, the sequence and the place in it.

Tokens are kept nowhere: lengths and checksums of pieces come from one pass.

Defined cases: null and empty texts are the end id alone; rows that repeat a
``doc_id`` are packed each; a null ``doc_id`` is kept as it is.  Other columns
are ignored, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

END_ID = 2
#: Chunks that are a run of letters and then a run of marks, which this kind of tokenizer cuts apart.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[.,!?;:%$#&*|()\"/+=<>@_-]*)$"
_PROBES = ("one two", "Abc!?", "IDLE, ???", "é... ß:", "a_b <x> it's 12a3", " \t lead", "x,y\u00a0z")
_MOST_KEPT = 400_000
_SLICE_BYTES = 4 << 20
_PARTS_AT_ONCE = 512


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices ``first[k] ... first[k] + count[k] - 1`` for every k in turn."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


class Encoder:
    """Token ids of whole texts, a batch at a time.

    This kind of tokenizer drops white space before it cuts, so a text's ids are
    those of its chunks in turn.  Arrow splits a batch and finds its distinct
    chunks; a plain chunk is made of letters, taken in lower case, and marks.  Only
    parts not met before go to the tokenizer, and at most ``_MOST_KEPT`` are kept.
    ``_PROBES`` are encoded both ways first: where they differ, the tokenizer is of
    another kind, and texts go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        self.ends[[i for word, i in self.tokenizer.get_vocab().items() if word.endswith("</w>")]] = True
        self._forget()
        self.whole = False
        ids, begins = self.batch(pa.array(_PROBES))
        self.whole = [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] != [x.ids for x in self.tokenizer.encode_batch_fast(list(_PROBES), add_special_tokens=False)]

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.first, self.count = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.uint32)

    def _alone(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return np.array([i for x in found for i in x], dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64)

    def _learn(self, parts: list[str]) -> None:
        """Ids of new parts; runs of one kind are put together, and end marks tell them apart again."""
        simple = [p.isalpha() or not any(c.isalnum() or c in "'\u2019" or ord(c) > 127 for c in p) for p in parts]
        all_ids, counts, at = [], [], len(self.first)
        for kind in (True, False):
            own = [p for p, x in zip(parts, simple, strict=True) if x == kind]
            for k in range(0, len(own), _PARTS_AT_ONCE):
                some = own[k : k + _PARTS_AT_ONCE]
                ids = count = None
                if kind:
                    ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
                    stops = np.flatnonzero(self.ends[ids])
                    count = np.diff(stops, prepend=-1) if len(stops) == len(some) and stops[-1] == len(ids) - 1 else None
                if count is None:
                    ids, count = self._alone(some)
                all_ids.append(ids)
                counts.append(count)
            self.known.update(zip(own, range(at, at + len(own)), strict=True))
            at += len(own)
        count = np.concatenate(counts)
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.pool = np.concatenate([self.pool, *all_ids])

    def _places(self, parts: pa.Array) -> np.ndarray:
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > _MOST_KEPT:
            self._forget()
        new = [p for p in distinct if p not in self.known]
        if new:
            self._learn(new)
        known = self.known
        return np.array([known[p] for p in distinct], dtype=np.int64)[coded.indices.to_numpy()]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes."""
        ids, begins = self.batch(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4", copy=False).tobytes() for a, b in zip(begins, begins[1:])]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, index at which each text's begin, and the end)."""
        if self.whole:
            ids, count = self._alone(texts.to_pylist())
            return ids, np.concatenate([[0], np.cumsum(count)])
        split = pc.ascii_split_whitespace(texts)
        words = split.values.dictionary_encode()
        cut = pc.extract_regex(words.dictionary, _PLAIN)
        plain = cut.is_valid()
        letters = pc.if_else(plain, pc.utf8_lower(cut.field("letters")), words.dictionary)
        n = len(letters)
        both = self._places(pa.concat_arrays([letters, pc.if_else(plain, cut.field("marks"), "")]))
        sides = both.reshape(2, n).T.ravel()  # letters and marks of each chunk
        pool = self.pool[_ragged(self.first[sides], self.count[sides])]
        size = self.count[sides].reshape(n, 2).sum(axis=1)
        at = np.cumsum(size) - size
        index = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[index])])
        return pool[_ragged(at[index], size[index])], ends[split.offsets.to_numpy()]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _slices(texts: pa.Array, most: int = _SLICE_BYTES):
    """(first row, rows) of about ``most`` bytes; a longer text is alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + most, side="right")))
        yield row, texts.slice(row, end - row)
        row = end


def _pieces(path: str, length: int):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for at, texts in _slices(batch.column(1).fill_null("")):
                ids, begins = enc.batch(texts)
                tokens = np.diff(begins) + 1
                with_end = np.insert(ids, begins[1:], END_ID).astype("<u4", copy=False)
                parts = -(-tokens // length)
                row = np.repeat(np.arange(len(tokens)), parts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * length
                size = np.minimum(tokens[row] - start, length)
                first = (np.cumsum(tokens) - tokens)[row] + start
                raw = memoryview(with_end).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, size, sums, tokens[row]))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _best_pattern(value: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes 1..units that fits in ``units``."""
    best, last = np.zeros(units + 1), np.zeros(units + 1, dtype=np.int64)
    for room in range(1, units + 1):
        gain = value[:room] + best[room - 1 :: -1][:room]
        k = int(np.argmax(gain))
        if gain[k] > best[room - 1] + 1e-12:
            best[room], last[room] = gain[k], k + 1
        else:
            best[room], last[room] = best[room - 1], 0
    pattern, room = np.zeros(units, dtype=np.int64), units
    while room > 0:
        if last[room]:
            pattern[last[room] - 1] += 1
            room -= last[room]
        else:
            room -= 1
    return float(best[units]), pattern


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """A product by element-wise sums.

    The plan is made on the driver, where a linear-algebra library's threads may
    hang once the process has forked; nothing here starts any.
    """
    return (matrix * vector).sum(axis=1)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By Gauss and Jordan, with the largest pivot of each column."""
    n = len(matrix)
    work = np.concatenate([matrix, np.eye(n)], axis=1)
    for k in range(n):
        row = k + int(np.argmax(np.abs(work[k:, k])))
        work[[k, row]] = work[[row, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0.0
        work -= factor[:, None] * work[k]
    return work[:, n:]


def plan_patterns(demand: np.ndarray, most_steps: int = 4000) -> list[tuple[np.ndarray, int]]:
    """``[(pieces of each size, sequences)]`` for ``demand[k]`` pieces of size k + 1, in a capacity of len(demand).

    Every piece has a place: the patterns cover the demand exactly.
    """
    units = len(demand)
    used = np.flatnonzero(demand)
    left, plan = demand.astype(np.int64).copy(), []
    if len(used):
        need = demand[used].astype(float)
        # One pattern a size to start with: as many of it as fit.
        basis = np.diag((units // (used + 1)).astype(float))
        inverse = np.diag(1.0 / np.diag(basis))
        columns = [np.eye(1, units, int(k), dtype=np.int64)[0] * (units // (int(k) + 1)) for k in used]
        amount = _times(inverse, need)
        for step in range(most_steps):
            price = np.zeros(units)
            price[used] = np.maximum(inverse.sum(axis=0), 0.0)
            worth, pattern = _best_pattern(price, units)
            if worth <= 1 + 1e-7:
                break
            change = _times(inverse, pattern[used].astype(float))
            up = change > 1e-9
            ratio = np.full(len(used), np.inf)
            ratio[up] = np.maximum(amount[up], 0.0) / change[up]
            out = int(np.argmin(ratio))
            columns[out] = pattern
            pivot = inverse[out] / change[out]
            inverse -= np.outer(change, pivot)
            inverse[out] = pivot
            amount = amount - ratio[out] * change
            amount[out] = ratio[out]
            if step % 200 == 199:
                inverse = _inverse(np.array([c[used] for c in columns], dtype=float).T)
                amount = _times(inverse, need)
        for pattern, x in zip(columns, amount, strict=True):
            times = int(x + 1e-6)
            on = pattern > 0
            if times > 0:
                times = min(times, int((left[on] // pattern[on]).min()))
            if times > 0:
                left -= pattern * times
                plan.append((pattern, times))
    # What rounding left: largest first, each into the fullest that still fits.
    rest: dict[bytes, int] = {}
    while left.any():
        pattern, room = np.zeros(units, dtype=np.int64), units
        while room > 0:
            fits = np.flatnonzero(left[:room] - pattern[:room] > 0)
            if not len(fits):
                break
            k = int(fits[-1])
            take = min(int(left[k] - pattern[k]), room // (k + 1))
            pattern[k] += take
            room -= take * (k + 1)
        on = pattern > 0
        times = int((left[on] // pattern[on]).min())
        left -= pattern * times
        rest[pattern.tobytes()] = rest.get(pattern.tobytes(), 0) + times
    return plan + [(np.frombuffer(p, dtype=np.int64), n) for p, n in rest.items()]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, unit: int = 16, rows_a_bucket: int = 1000) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(texts.mapInArrow(_pieces(tokenizer, length), f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long").withColumn("size", F.ceil(F.col("length") / unit).cast("int")), "pieces")

    units = length // unit
    demand = np.zeros(units, dtype=np.int64)
    for size, n in pieces.groupBy("size").count().collect():  # at most `units` rows
        demand[size - 1] = n
    slots, first_sequence, ranked = [], 0, np.zeros(units, dtype=np.int64)
    for p, (pattern, times) in enumerate(plan_patterns(demand)):
        place = 0
        for k in np.flatnonzero(pattern):
            a = int(pattern[k])
            slots.append((int(k) + 1, int(ranked[k]), int(ranked[k] + a * times), a, first_sequence, place))
            ranked[k] += a * times
            place += a
        first_sequence += times
    # A few thousand rows at most: two lists of at most `units` patterns, each of at most `units` sizes.
    slots = F.broadcast(spark.createDataFrame(slots, "s_size int, lo long, hi long, a long, first long, place long"))

    buckets = F.element_at(F.array(*[F.lit(1 + int(n) // rows_a_bucket) for n in demand]), F.col("size"))
    order = ["doc_id", "start", "ids_crc32", "doc_tokens", "length"]
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), buckets).cast("int"))
    counts = dealt.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    base = F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("size").alias("c_size"), F.col("bucket").alias("c_bucket"), F.coalesce(base, F.lit(0)).alias("base"))
    numbered = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("size", "bucket").orderBy(*order)) - 1)
    numbered = numbered.join(counts, (F.col("size") == F.col("c_size")) & (F.col("bucket") == F.col("c_bucket"))).withColumn("rank", F.col("rank") + F.col("base"))
    met = numbered.join(slots, (F.col("size") == F.col("s_size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    met = met.withColumn("sequence_id", F.col("first") + F.expr("(rank - lo) div a")).withColumn("seat", F.col("place") + (F.col("rank") - F.col("lo")) % F.col("a"))
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("seat").rowsBetween(Window.unboundedPreceding, -1))
    return met.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(before, F.lit(0)).alias("offset"))
