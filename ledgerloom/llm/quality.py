"""Quality by a generalised additive model with pairwise interactions.

Twenty numbers describe a text's shape.  Each is cut into bins at quantiles of a
bounded labelled sample (``most_labels`` rows).  Shallow trees on one feature at
a time are boosted in turn, again and again, each step small, so that every
feature ends with a table of log odds by bin.  The pairs of features whose coarse
grid explains most of what is left get tables of their own, boosted in turn as
well.  A score is the sum of looked-up bins through the logistic curve: for a
batch of texts, one vectorised addition a table.

Defined cases: null and empty texts have the features of an empty text and get
a score; repeated rows score alike; without usable labels of both kinds the model
is the base rate (0.5 without any label).  Other columns are not read.  An empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample, remainder

NAMES = ("words", "mean_word", "longest_word", "distinct", "top_share", "echo", "upper", "digit", "mark", "odd_mark", "bar", "shout", "space", "wide", "lines", "line_words", "line_repeats", "short_lines", "ended", "capital_words")
# Classes of bytes: 0 lower, 1 upper, 2 digit, 3 white space, 4 usual marks, 5 odd marks, 6 bar, 7 shout, 8 beyond ASCII.
_CLASS = np.full(256, 5)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 8
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 4
_CLASS[ord("|")], _CLASS[ord("!")] = 6, 7


def features(text: str | None) -> list[float]:
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    kind = np.bincount(_CLASS[raw], minlength=9) / max(1, len(raw))
    words, lines = text.split(), text.split("\n")
    n, m = max(1, len(words)), len(lines)
    lengths = list(map(len, words))
    seen, line_seen = Counter(words), Counter(lines)
    return [
        np.log1p(len(words)), sum(lengths) / n, max(lengths, default=0), len(seen) / n, max(seen.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n, kind[1], kind[2], kind[4], kind[5], kind[6], kind[7], kind[3], kind[8],
        np.log1p(m), len(words) / m, 1 - len(line_seen) / m, sum(len(x) < 20 for x in lines) / m,
        sum(x.rstrip()[-1:] in (".", "!", "?") for x in lines) / m, sum(w[0].isupper() for w in words) / n,
    ]


class AdditiveModel:
    """Tables of log odds by bin, for features and for pairs of them."""

    def __init__(self, bins: int = 32, coarse: int = 8, rounds: int = 120, pairs: int = 8, pair_rounds: int = 60, rate: float = 0.08, ridge: float = 2.0):
        self.bins, self.coarse, self.rounds, self.pairs, self.pair_rounds, self.rate, self.ridge = bins, coarse, rounds, pairs, pair_rounds, rate, ridge
        self.base, self.edges, self.tables, self.chosen, self.pair_tables = 0.0, [], [], [], []

    def _binned(self, x: np.ndarray, k: int) -> np.ndarray:
        return np.searchsorted(self.edges[k], x[:, k], side="right")

    def _coarse(self, binned: np.ndarray, k: int) -> np.ndarray:
        return binned * self.coarse // (len(self.edges[k]) + 1)

    def _gain(self, g, h):
        return g * g / (h + self.ridge)

    def _cut(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """The best place to cut a row of bins, and what it gains."""
        if len(g) < 2:
            return 0.0, 0
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = self._gain(a, b) + self._gain(g.sum() - a, h.sum() - b) - self._gain(g.sum(), h.sum())
        k = int(np.argmax(gain))
        return float(gain[k]), k + 1

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A step for each bin, from a tree of at most four leaves."""
        _, mid = self._cut(g, h)
        parts = []
        for lo, hi in ((0, mid), (mid, len(g))):
            gain, at = self._cut(g[lo:hi], h[lo:hi])
            parts += [(lo, lo + at), (lo + at, hi)] if gain > 0 else [(lo, hi)]
        out = np.zeros(len(g))
        for lo, hi in parts:
            if hi > lo:
                out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + self.ridge)
        return self.rate * out

    def _cross(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The best cross of one cut on each axis of a grid: its gain and a step for each cell."""
        cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
        quarters = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
        qg, qh = quarters(cg), quarters(ch)
        gain = sum(self._gain(a, b) for a, b in zip(qg, qh, strict=True)) - self._gain(cg[-1, -1], ch[-1, -1])
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        out = np.zeros_like(g)
        for rows, cols in ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + self.ridge)
        return float(gain[i, j]), self.rate * out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(rate / (1 - rate)))
        if not len(y) or y.min() == y.max():
            return self
        d = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(d)]
        at = [self._binned(x, k) for k in range(d)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        logit = np.full(len(y), self.base)
        chance = lambda: 1 / (1 + np.exp(-logit))
        for _ in range(self.rounds):
            for k in range(d):
                p = chance()
                n = len(self.tables[k])
                step = self._tree(np.bincount(at[k], y - p, n), np.bincount(at[k], p * (1 - p), n))
                self.tables[k] += step
                logit += step[at[k]]
        c = self.coarse
        grid = [self._coarse(at[k], k) for k in range(d)]
        cells = lambda i, j, v: np.bincount(grid[i] * c + grid[j], v, c * c).reshape(c, c)
        p = chance()
        ranked = sorted(((self._cross(cells(i, j, y - p), cells(i, j, p * (1 - p)))[0], i, j) for i in range(d) for j in range(i)), reverse=True)
        self.chosen = [(i, j) for _, i, j in ranked[: self.pairs]]
        self.pair_tables = [np.zeros((c, c)) for _ in self.chosen]
        for _ in range(self.pair_rounds):
            for q, (i, j) in enumerate(self.chosen):
                p = chance()
                _, step = self._cross(cells(i, j, y - p), cells(i, j, p * (1 - p)))
                self.pair_tables[q] += step
                logit += step[grid[i], grid[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.base)
        if self.tables:
            at = [self._binned(x, k) for k in range(x.shape[1])]
            for k, t in enumerate(self.tables):
                logit += t[at[k]]
            for (i, j), t in zip(self.chosen, self.pair_tables, strict=True):
                logit += t[self._coarse(at[i], i), self._coarse(at[j], j)]
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def _features(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])


def _score(model: AdditiveModel):
    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], dtype=float).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return run


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", fold_out: tuple[int, int] = (0, 5), most_labels: int = 20_000, **shape) -> AdditiveModel:
    sample = labelled_sample(docs, labels, label, fold_out, most_labels)
    rows = sample.select("text", "y").mapInArrow(_features, "x array<double>, y int").toPandas()  # twenty numbers a labelled row
    x = np.array(rows.x.tolist(), dtype=float).reshape(len(rows), len(NAMES))
    order = np.lexsort(x.T)  # the same sums whatever order the rows came in
    return AdditiveModel(**shape).fit(x[order], (rows.y.to_numpy()[order] > 0).astype(float))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_score(model), f"doc_id {id_type}, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fold_out: tuple[int, int] = (0, 5), **learning) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    scored = score(docs, learn(docs, labels, fold_out=fold_out, **learning))
    held = F.coalesce(remainder(F.col("doc_id"), fold_out[1]) == fold_out[0], F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
