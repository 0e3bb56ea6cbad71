"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches.

Text is folded first: case, full-width and look-alike letters of other scripts,
digits and signs that stand for letters inside a word.  Words are then set apart
by single spaces, so that the automaton's patterns carry their own word bounds.
A pattern is a word, the beginning of a word, or an exception phrase; a match
inside an exception phrase does not count, and each word counts once, with its
heaviest pattern.  The sum of weights is divided by the number of words, and a
logistic curve turns this density into a score.

Weights are smoothed log odds of documents with the word among toxic and other
labelled documents, in two halves of a bounded sample (``most_labels`` rows);
the curve is fitted on each half with the other half's lexicon, and the lexicon
in use has both halves.  The lexicon holds every term with enough support in the
sample, whose size alone bounds it.  Words without evidence keep the weight of ``BASE``.

Defined cases: null and empty texts, and texts without words, have density 0;
repeated rows score alike; a table without usable labels leaves ``BASE`` and a
fixed curve.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample, remainder

#: Insults that count without any label, and phrases in which such a word is harmless.
BASE = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
EXCEPTIONS = ("class clown", "clown fish", "idiot proof", "sore loser", "stupid simple", "trash bag", "trash bin", "trash can")
BASE_WEIGHT, MOST_WEIGHT = 3.0, 8.0

# Look-alikes of Latin letters: Cyrillic and Greek.
_LOOKALIKES = dict(zip("аеорсухіјѕԁһνοαερτικυ", "aeopcyxijsdhvoaeptiku", strict=True))
_WIDE = {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | {chr(0xFF10 + k): chr(48 + k) for k in range(10)}
_FOLD = str.maketrans(_LOOKALIKES | _WIDE | {"​": "", "‌": "", "‍": "", "­": ""})
_ODD = re.compile("[" + "".join(_LOOKALIKES) + "０-９ａ-ｚ​-‍­]")
_DIGITS = str.maketrans("01345789@$!", "oieastbgasi")
_MIXED = re.compile(r"(?<![^\W_])(?:[@$](?=[^\W\d_])|[^\W_])(?:[^\W_]|[@$!](?=[^\W\d_]))*")
_HAS_SIGN = re.compile(r"[0-9@$!]")
_APART = re.compile(r"[\W_]+")


def _plain_word(match: re.Match) -> str:
    word = match[0]
    if not _HAS_SIGN.search(word) or not any(c.isalpha() for c in word):
        return word
    read = word.translate(_DIGITS)
    return f"{read} {word.replace('1', 'l').translate(_DIGITS)}" if "1" in word else read


def fold(text: str) -> str:
    """Folded words, each between single spaces."""
    text = text.lower()
    if _ODD.search(text):
        text = text.translate(_FOLD)
    if _HAS_SIGN.search(text):
        text = _MIXED.sub(_plain_word, text)
    return f" {_APART.sub(' ', text).strip()} "


def _counts(batches):
    """(text, y, half) -> documents with each term, of each label and half; summed over the batch."""
    for batch in batches:
        found = [[Counter(), Counter()], [Counter(), Counter()]]
        for text, y, half in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = set(fold(text or "").split())
            words |= {f"{w[:k]}*" for w in words for k in (4, 5, 6) if len(w) > k}
            found[half][1 if y else 0].update(words)
        for half in (0, 1):
            for y in (0, 1):
                terms = found[half][y]
                n = len(terms)
                yield pa.RecordBatch.from_arrays([pa.array(terms.keys(), pa.string()), pa.array([half] * n, pa.int32()), pa.array([y] * n, pa.int32()), pa.array(terms.values(), pa.int64())], ["term", "half", "y", "n"])


def weights_of(rows: list[tuple], toxic: int, clean: int, support: int = 3, purity: float = 0.8) -> dict[str, float]:
    """Weights of ``(term, toxic documents, other documents)``; BASE for words without evidence."""
    out = {w: BASE_WEIGHT for w in BASE}
    for term, t, c in rows:
        stem = term.endswith("*")
        if t >= (support + 2 if stem else support) and t >= (0.95 if stem else purity) * (t + c):
            odds = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
            out[term] = min(MOST_WEIGHT, max(0.0, odds)) * t / (t + 2.0)
        elif term in out and t + c >= 10 and t < 0.5 * (t + c):
            del out[term]
    return out


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for term, weight in weights.items():
            word = f" {term[:-1]}" if term.endswith("*") else f" {term} "
            self.machine.add_word(word, (len(word), weight, False))
        for phrase in exceptions:
            word = f" {fold(phrase).strip()} "
            self.machine.add_word(word, (len(word), 0.0, True))
        self.machine.make_automaton()

    def density(self, text: str | None) -> tuple[float, int]:
        """Weight for each word, and the number of words."""
        folded = fold(text or "")
        words = folded.count(" ") - 1 if folded.strip() else 0
        heaviest, spared = {}, []
        for end, (size, weight, harmless) in self.machine.iter(folded):
            start = end - size + 1
            if harmless:
                spared.append((start, end))
            elif weight > heaviest.get(start, 0.0):
                heaviest[start] = weight
        # One sweep over both in order of place, so that a very long text of many phrases stays linear.
        spared.sort()
        total, k, until = 0.0, 0, -1
        for at in sorted(heaviest):
            while k < len(spared) and spared[k][0] <= at:
                until = max(until, spared[k][1])
                k += 1
            if at >= until:
                total += heaviest[at]
        return (total / words if words else 0.0), words


def _x(density: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(density), np.log(density + 1e-4)], axis=1)


#: Where there is nothing to fit the curve on: even at one base insult in 100 words.
DEFAULT_CURVE = (1.5 * -math.log(BASE_WEIGHT / 100), 1.5)


def fit_curve(density: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    if not len(y) or y.min() == y.max():
        return DEFAULT_CURVE
    x, w = _x(density), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(2), grad)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[1] > 0 else DEFAULT_CURVE


@lru_cache(maxsize=4)
def _lexicon(terms: tuple) -> Lexicon:
    return Lexicon(dict(terms))


def _densities(halves: list[tuple]):
    def run(batches):
        for batch in batches:
            text, y, half = (batch.column(k).to_pylist() for k in range(3))
            d = [_lexicon(halves[1 - h]).density(t)[0] for t, h in zip(text, half, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.float64()), pa.array(y, pa.int32())], ["density", "y"])

    return run


def _score(terms: tuple, curve: tuple[float, float]):
    def run(batches):
        lexicon = _lexicon(terms)
        for batch in batches:
            d = np.array([lexicon.density(t)[0] for t in batch.column(1).to_pylist()], dtype=float)
            score = 1 / (1 + np.exp(-np.clip(_x(d) @ np.array(curve), -35, 35))) if len(d) else d
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(d, pa.float64())], ["doc_id", "score", "density"])

    return run


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold_out: tuple[int, int] = (1, 3), most_labels: int = 20_000) -> tuple[tuple, tuple[float, float]]:
    """(terms with weights, curve) from ``most_labels`` labelled rows at most outside ``fold_out`` (remainder, folds).

    The lexicon has every term of the sample that two toxic rows hold and that is toxic in six of ten of its rows.
    """
    sample = labelled_sample(docs, labels, label, fold_out, most_labels).select("text", "y", "half")
    size = {(r.half, r.y): r.n for r in sample.groupBy("half", F.when(F.col("y") > 0, 1).otherwise(0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = sample.mapInArrow(_counts, "term string, half int, y int, n long")
    sums = [F.sum(F.when((F.col("half") == h) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{h}{y}") for h in (0, 1) for y in (0, 1)]
    found = counts.groupBy("term").agg(*sums)
    toxic = F.col("n01") + F.col("n11")
    telling = found.where((toxic >= 2) & (toxic >= 0.6 * (toxic + F.col("n00") + F.col("n10"))) | F.col("term").isin(*BASE))
    rows = telling.collect()  # terms of the bounded sample
    n = {k: size.get(k, 0) for k in ((0, 0), (0, 1), (1, 0), (1, 1))}

    def terms(use: tuple[int, ...]) -> tuple:
        stats = [(r.term, sum(r[f"n{h}1"] for h in use), sum(r[f"n{h}0"] for h in use)) for r in rows]
        weights = weights_of(stats, sum(n[h, 1] for h in use), sum(n[h, 0] for h in use))
        return tuple(sorted(weights.items()))

    scored = sample.mapInArrow(_densities([terms((0,)), terms((1,))]), "density double, y int").toPandas()  # two numbers a labelled row
    return terms((0, 1)), fit_curve(scored.density.to_numpy(), (scored.y > 0).to_numpy().astype(float))


def score(docs: DataFrame, terms: tuple, curve: tuple[float, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, density`` of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_score(terms, curve), f"doc_id {id_type}, score double, density double")


def _keep(terms: tuple, curve: tuple[float, float], threshold: float, at: int):
    def run(batches):
        lexicon = _lexicon(terms)
        for batch in batches:
            d = np.array([lexicon.density(t)[0] for t in batch.column(at).to_pylist()], dtype=float)
            score = 1 / (1 + np.exp(-np.clip(_x(d) @ np.array(curve), -35, 35))) if len(d) else d
            yield batch.filter(pa.array(score < threshold))

    return run


def keep(docs: DataFrame, terms: tuple, curve: tuple[float, float], threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score under ``threshold``."""
    return docs.mapInArrow(_keep(terms, curve, threshold, docs.columns.index(text_col)), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fold_out: tuple[int, int] = (1, 3), **learning) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    scored = score(docs, *learn(docs, labels, fold_out=fold_out, **learning))
    held = F.coalesce(remainder(F.col("doc_id"), fold_out[1]) == fold_out[0], F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
