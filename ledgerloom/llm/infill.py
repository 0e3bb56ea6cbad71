"""Fill-in-the-middle by run-length class encoding.

A text is coded as maximal *runs* of one class: whether its code points are blank
(``\\x20 \\x09-\\x0D``) and how many UTF-8 bytes each of them takes.  A run stores
where it starts in bytes and code points and how many units end before it does.
Units are words with the blanks before them (trailing blanks are one more) or code
points.  A cut after ``u`` units is found by binary search for the first run up to
which ``u`` units end, and its place follows by arithmetic: a code point lies
``(u - units before) * bytes of each`` into its run, a word ends with its run.

Runs of a whole batch are found at once on the Arrow text buffer (numpy), in slices
of about a megabyte; a text is never cut into tokens.  Cuts come from the first four 32-bit words of the SHA-256 of
``seed:doc_id``; the document's two cuts part prefix, middle and suffix, which are put together
as plain text, ``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm).

Defined cases: a null or empty text is plain with an empty output; so is a text
that holds a sentinel, with itself as output; a null id hashes as the empty text;
rows that repeat an id with one text give equal rows; very long texts are one slice; other
columns are kept, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import free_name
from .shingles import text_slices

#: Class of a byte: 0 inside a code point, else 2 * (bytes of the code point) + (1 if not blank).
_CLASS = np.array([0 if 128 <= b < 192 else 2 * (1 + (b >= 192) + (b >= 224) + (b >= 240)) + (b not in b" \t\n\v\f\r") for b in range(256)], dtype=np.uint8)


class Runs:
    """The runs of the texts of one slice: ``data`` with ``at`` where each text starts and, last, ends."""

    def __init__(self, data: np.ndarray, at: np.ndarray, units: str = "words"):
        kind = _CLASS[data]
        heads = np.flatnonzero(kind)  # first bytes of code points
        kind = kind[heads]
        self.text_head = np.searchsorted(heads, at)  # code points before each text
        new = np.ones(len(heads), dtype=bool)
        new[1:] = kind[1:] != kind[:-1]
        new[self.text_head[:-1][self.text_head[:-1] < len(heads)]] = True
        first = np.flatnonzero(new)
        self.byte, self.point = heads[first], first
        self.wide = kind[first].astype(np.int64) >> 1
        ends = np.append(first[1:], len(heads))
        self.points = ends - first
        self.text_run = np.searchsorted(first, self.text_head)  # runs before each text
        last = np.zeros(len(first), dtype=bool)
        last[(self.text_run[1:] - 1)[self.text_run[1:] > self.text_run[:-1]]] = True
        if units == "words":
            # A word ends where the next run is blank or the text is over; trailing blanks are a unit of their own.
            word = (kind[first] & 1).astype(bool)
            blank_next = np.append(~word[1:], True)
            ended = np.where(word, blank_next | last, last).astype(np.int64)
        else:
            ended = self.points
        self.words = units == "words"
        self.upto = np.cumsum(ended)  # units that end with the run or before it, over the slice
        self.before = np.append(0, self.upto)[self.text_run]  # the same before each text
        self.at = at

    @property
    def units(self) -> np.ndarray:
        return np.diff(self.before)

    def cut(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, code point) from each text's start after ``u`` of its units."""
        run = np.minimum(np.searchsorted(self.upto, self.before[:-1] + u), max(0, len(self.upto) - 1))
        if not len(self.upto):
            return np.zeros_like(u), np.zeros_like(u)
        inside = self.points[run] if self.words else u + self.before[:-1] - (self.upto[run] - self.points[run])
        some = u > 0
        return (np.where(some, self.byte[run] + inside * self.wide[run] - self.at[:-1], 0), np.where(some, self.point[run] + inside - self.text_head[:-1], 0))


def _assembled(batches: Iterator[pa.RecordBatch], marks: tuple[bytes, bytes, bytes], rate: int, spm_rate: int, units: str, text: int) -> Iterator[pa.RecordBatch]:
    pre, suf, mid = marks
    for batch in batches:
        h = [batch.column(batch.num_columns - 1).flatten()[k].to_numpy(zero_copy_only=False) for k in range(4)]
        out, forms, n_units, points, middles = [], [], [], [], []
        for lo, hi, data, at in text_slices(batch.column(text)):
            runs = Runs(data, at, units)
            n = runs.units
            one, two = h[0][lo:hi] % (n + 1), h[1][lo:hi] % (n + 1)
            (a, a_point), (b, b_point) = runs.cut(np.minimum(one, two)), runs.cut(np.maximum(one, two))
            raw = data.tobytes()
            for k in range(hi - lo):
                whole = raw[at[k] : at[k + 1]]
                if not whole or h[2][lo + k] % 100 >= rate or any(m in whole for m in marks):
                    form, text_out = "plain", whole
                else:
                    p, m, s = whole[: a[k]], whole[a[k] : b[k]], whole[b[k] :]
                    form, text_out = ("spm", b"".join((suf, s, pre, p, mid, m))) if h[3][lo + k] % 100 < spm_rate else ("psm", b"".join((pre, p, suf, s, mid, m)))
                out.append(text_out)
                forms.append(form)
                points.append(None if form == "plain" else int(a_point[k]))
                middles.append(None if form == "plain" else int(b_point[k] - a_point[k]))
            n_units.append(n)
        made = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(n_units) if n_units else [], pa.int64()), pa.array(forms, pa.string()), pa.array(points, pa.int64()), pa.array(middles, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
            ["n", "form", "prefix_chars", "middle_chars", "output"],
        )
        columns = batch.columns[:-1]
        yield pa.RecordBatch.from_arrays([*columns, made], [*batch.schema.names[:-1], "made"])


FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


def rearranged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), rate: int = 50, spm_rate: int = 80, seed: int = 42, units: str = "words") -> tuple[DataFrame, str]:
    """(the input's rows and columns with one struct column ``n, form, prefix_chars, middle_chars, output`` more, its name).

    ``rate`` and ``spm_rate``: how many of 100 documents are rearranged, and how many of these
    have the suffix first.  ``marks`` stand for prefix, suffix and middle.
    """
    made = free_name(docs, "infill")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    words = F.struct(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)])
    keyed = docs.withColumn(text_col, F.col(text_col).cast("string")).withColumn(made, words)
    schema = StructType([*keyed.drop(made).schema.fields, StructField(made, StructType.fromDDL(FIELDS))])
    f = partial(_assembled, marks=tuple(m.encode() for m in marks), rate=rate, spm_rate=spm_rate, units=units, text=docs.columns.index(text_col))

    def run(batches):
        for batch in f(batches):
            yield batch.rename_columns(schema.names)

    return keyed.mapInArrow(run, schema), made


def restored(output: Column, form: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text again: what lies between the sentinels, each of which the output holds once."""
    pre, suf, mid = (F.lit(m) for m in marks)
    side = lambda c, mark, k: F.split_part(c, mark, F.lit(k))
    head, tail = side(output, mid, 1), side(output, mid, 2)
    psm = F.concat(side(side(head, suf, 1), pre, 2), tail, side(head, suf, 2))
    spm = F.concat(side(head, pre, 2), tail, side(side(head, pre, 1), suf, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``."""
    out, m = rearranged(docs.select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    output, form = F.col(f"{m}.output"), F.col(f"{m}.form")
    return out.select("doc_id", f"{m}.n", form, f"{m}.prefix_chars", f"{m}.middle_chars", digest(output).alias("output_sha256"), digest(restored(output, form)).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(w)::BIGINT AS n, h1 % (len(w) + 1) AS c1, h2 % (len(w) + 1) AS c2 FROM t),
p AS (SELECT doc_id, text, n, coalesce(array_to_string(w[1:least(c1, c2)], ''), '') AS p, coalesce(array_to_string(w[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS m,
  coalesce(array_to_string(w[greatest(c1, c2) + 1:], ''), '') AS s,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
