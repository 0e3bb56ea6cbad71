"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a page are multiplied as likelihoods:

* its text, by byte-trigram models of each language learned from a bounded sample
  of documents with a known language, tempered because trigrams overlap;
* the language its markup declares and the one its address suggests (a path
  step, a query value or a top domain), by how often pages of each language say
  so, which grouped sums over the text's own posteriors tell;
* its host: the mean posterior of the host's other pages, smoothed towards its
  domain's, and that towards the whole corpus's, all by grouped sums (combined
  before their shuffle, so a host that holds a third of all pages is no hot
  group), with the page's own share taken out.

Texts are read whole.  Defined cases: null, empty and mark-up-only pages have no
text evidence and go by the rest; a null or odd address has neither host nor
suffix; repeated rows count each.  A page without any evidence has the corpus's
prior.  Other columns are ignored.  An empty table gives no rows.  Without any
sample document the languages are those of ``fallback`` and texts say nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

CELLS = 1 << 14
_ENTITY = r"&[a-z#0-9]+;"
_MARK = re.compile(rf"(?i)<(script|style|nav)\b|<!--|<|{_ENTITY}")
_CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "nav")} | {"<!--": re.compile("-->")}


def page_text(html: str | None) -> str:
    """The text between tags, comments, scripts, styles and menus, each of which leaves a blank.

    One pass: what closes is searched from where the last one ended, and not again once none follows.
    """
    html, out, at, unclosed = html or "", [], 0, set()
    while mark := _MARK.search(html, at):
        out.append(html[at : mark.start()])
        kind, close = (mark[1] or mark[0]).lower(), None
        if kind in _CLOSE and kind not in unclosed:
            close = _CLOSE[kind].search(html, mark.end())
            if close is None:
                unclosed.add(kind)
        at = close.end() if close else mark.end() if kind[0] == "&" else html.find(">", mark.end()) + 1
        if not at:  # no tag is closed from here on
            return "".join(out) + re.sub(rf"(?i){_ENTITY}", " ", html[mark.start() :])
        out.append(" ")
    return "".join(out) + html[at:]


def trigrams(text: str) -> np.ndarray:
    """Counts of byte trigrams, by cell; ASCII letters lower-cased, everything else ASCII is a gap."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    raw = np.where((raw >= 128) | ((raw >= 97) & (raw <= 122)), raw, 32).astype(np.int64)
    if len(raw) < 3:
        return np.zeros(CELLS, dtype=np.int64)
    keep = (raw[:-2] != 32) | (raw[1:-1] != 32)
    code = (raw[:-2] * 961 + raw[1:-1] * 31 + raw[2:])[keep] % CELLS
    return np.bincount(code, minlength=CELLS)


def _model_counts(batches):
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[lang] = sums.get(lang, 0) + trigrams(text or "")
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at])], ["lang", "cell", "n"])


def learn(docs: DataFrame, most_docs: int = 4_000, least_docs: int = 200) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log probabilities by cell, from ``lang, text``.

    The languages are those of a count over all documents, however many; the model
    takes 64 kB a language.  Each has an even share of about ``most_docs``
    documents, ``least_docs`` or all it has at least, chosen by hash, so that a
    rare language has a model as well.
    """
    known = docs.where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return langs, np.zeros((0, CELLS), dtype=np.float32)
    share = max(least_docs, most_docs // len(langs))
    below = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1 << 30, (share << 30) // sizes[lang]))])
    sample = known.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 30)) < below[F.col("lang")]).select("text", "lang")
    counts = sample.mapInArrow(_model_counts, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    table = np.full((len(langs), CELLS), 0.5)
    for lang, own in counts.toPandas().groupby("lang"):  # at most CELLS numbers a language
        table[langs.index(lang), own.cell] += own.n
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _text_evidence(table: np.ndarray, temper: float, most: float):
    """(id, html, declared, suffix, host) -> the same without the page, its log likelihoods and what they make alone."""

    def run(batches):
        for batch in batches:
            logs, alone = [], []
            for html in batch.column(1).to_pylist():
                n = trigrams(page_text(html))
                at = np.flatnonzero(n)
                like = temper * (table[:, at] @ n[at]) if len(at) else np.zeros(len(table))
                like = np.maximum(like - like.max(), -most).astype(float)
                logs.append(like)
                alone.append(np.exp(like) / np.exp(like).sum())
            lists = [pa.array(x, pa.list_(pa.float64())) for x in (logs, alone)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:5], *lists], ["page_id", "declared", "suffix", "host", "evidence", "p"])

    return run


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a column of lists; a null one is zeros."""
    out = np.zeros((len(lists), width))
    out[lists.is_valid().to_numpy(zero_copy_only=False)] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _fused(langs: list[str], prior: np.ndarray, said: list[dict[str, np.ndarray]], kappas: tuple[float, float]):
    """(id, declared, suffix, host, evidence, p, host's sums, domain's sums) -> (id, lang, confidence, declared, suffix, host)."""
    at = {v: k for k, v in enumerate(["", *langs])}
    tables = [np.stack([t[v] for v in at]) for t in said]
    names = np.array(langs, dtype=object)
    kappa_host, kappa_domain = kappas

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                evidence, own, of_host, of_domain = (_matrix(part.column(k), len(langs)) for k in (4, 5, 6, 7))
                of_host, of_domain = np.maximum(of_host - own, 0), np.maximum(of_domain - own, 0)
                domain = (of_domain + kappa_domain * prior) / (of_domain.sum(axis=1, keepdims=True) + kappa_domain)
                host = (of_host + kappa_host * domain) / (of_host.sum(axis=1, keepdims=True) + kappa_host)
                logs = evidence + np.log(host + 1e-12)
                for k, t in zip((1, 2), tables, strict=True):
                    logs += t[[at[v] for v in part.column(k).to_pylist()]]
                p = np.exp(logs - logs.max(axis=1, keepdims=True))
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(1 / p.sum(axis=1)), *part.columns[1:4]], ["page_id", "lang", "confidence", "declared", "suffix", "host"])

    return run


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fallback: tuple[str, ...] = ("de", "en", "es", "fr"), temper: float = 0.15, most: float = 12.0, kappa_host: float = 4.0, kappa_domain: float = 20.0, **learning) -> DataFrame:
    """One row per page: ``page_id, lang, confidence, declared, suffix, host``."""
    langs, table = learn(docs, **learning)
    if not langs:
        langs, table = list(fallback), np.zeros((len(fallback), CELLS), dtype=np.float32)
    id_type = pages.schema[id_col].dataType.simpleString()
    known = F.array(*[F.lit(x) for x in langs])
    html, url = F.col(html_col).cast("string"), F.lower(F.col(url_col).cast("string"))
    said = F.lower(F.regexp_extract(F.regexp_extract(html, r"(?i)<html([^>]*)", 1), r"(?i)\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1)
    step = F.regexp_extract(url, r"^[^?#]*?//[^/]+/([a-z]{2})(?:[/?#]|$)", 1)
    value = F.regexp_extract(url, r"[?&](?:lang|hl|locale)=([a-z]{2})", 1)
    top = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    among = lambda c: F.when(F.array_contains(known, c), c)
    rows = pages.select(F.col(id_col).alias("page_id"), html.alias("html"), F.coalesce(among(said), F.lit("")).alias("declared"), F.coalesce(among(step), among(value), among(top), F.lit("")).alias("suffix"), F.coalesce(host, F.lit("")).alias("host"))
    post = written(rows.mapInArrow(_text_evidence(table, temper, most), f"page_id {id_type}, declared string, suffix string, host string, evidence array<double>, p array<double>"), "evidence")

    n = len(langs)
    sums = lambda c: F.array(*[F.sum(F.get(c, F.lit(k))) for k in range(n)])
    # How pages of each language declare and address themselves: at most languages + 1 rows each.
    shares = []
    for sign in ("declared", "suffix"):
        share = {v: np.ones(n) * 0.5 for v in ["", *langs]}
        for row in post.groupBy(sign).agg(sums("p").alias("s")).collect():
            share[row[sign]] = share[row[sign]] + np.array(row.s)
        whole = sum(share.values())
        shares.append({v: np.log(x / whole) for v, x in share.items()})
    total = np.array([x or 0.0 for x in post.agg(sums("p").alias("s")).first().s]) + 1.0

    # Host within domain within corpus.
    hosts = post.where("host <> ''").groupBy("host").agg(sums("p").alias("s")).withColumn("domain", F.when(F.contains("host", F.lit(".")), F.substring_index("host", ".", -2)).otherwise(""))
    hosts = written(hosts, "hosts")
    domains = hosts.groupBy("domain").agg(sums("s").alias("ds"))
    priors = written(hosts.join(domains, "domain").select(F.col("host").alias("at"), "s", "ds"), "host-priors")
    dropped(hosts)
    # Pages without a host meet nothing: they are dealt evenly instead of under one key.
    at = F.when(F.col("host") != "", F.col("host")).otherwise(F.concat(F.lit("/"), F.xxhash64("page_id", "evidence").cast("string")))
    met = post.withColumn("at", at).join(priors, "at", "left").select("page_id", "declared", "suffix", "host", "evidence", "p", "s", "ds")
    scored = met.mapInArrow(_fused(langs, total / total.sum(), shares, (kappa_host, kappa_domain)), f"page_id {id_type}, lang string, confidence double, declared string, suffix string, host string")
    empty = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return scored.select("page_id", "lang", F.round("confidence", 6).alias("confidence"), empty("declared"), empty("suffix"), empty("host"))
