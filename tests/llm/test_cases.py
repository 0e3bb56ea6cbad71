"""Repeated, null and negative ids, clashing names, branching, recall, and the pipeline against brute force."""

import hashlib
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import language, line_dedup, media, mixing, packing, quality, queries, toxicity, warc
from ledgerloom.llm.common import free_name
from ledgerloom.llm.embed_dedup import embedding_duplicates
from ledgerloom.llm.near_dedup import near_duplicates, without_near_copies

from .test_llm import DOCS, WORDS, lines_by_hand, odd_rows, shingles, text

TINY = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


def groups_by_hand(sets, linked):
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if linked(a, b):
                parent[root(a)] = root(b)
    return [root(k) for k in range(len(sets))]


# ------------------------------------------------------------------ line dedup


def test_lines_of_a_repeated_id_are_kept(spark):
    rows = [(2, "p\nq\nr", "x", 1), (2, "one\ntwo\nthree\nfour", "y", 1), (3, "one\ntwo\nthree\nfive", "z", 1), (None, "one\ntwo\nthree", "n", 1), (4, None, "m", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string, __removed int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "__lines", "__removed_"]
    got = sorted((r[2], r[1], r[5]) for r in out.collect())
    # Rows of one id go by the hash of their text, so either row of id 2 may come first, but no other row's lines are its own.
    assert got == [("m", None, 0), ("n", "one\ntwo\nthree", 0), ("x", "p\nq\nr", 0), ("y", "one\ntwo\nthree\nfour", 0), ("z", "five", 3)]


def test_lines_of_one_very_long_text(spark):
    rng = random.Random(4)
    block = "\n".join(text(rng, 4) for _ in range(400))
    rows = [(1, block), (2, "\n".join([text(rng, 3), block, text(rng, 3), block]))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(lines_by_hand(rows)) and got[2].count("\n") == 1


def test_many_spans_of_one_long_text(spark):
    rng = random.Random(5)
    blocks = ["\n".join(text(rng, 4) for _ in range(3)) for _ in range(2_000)]
    rows = [(1, "\n".join(blocks)), (2, "\n".join(f"{b}\nown {k}" for k, b in enumerate(blocks))), (3, "\n".join(blocks[::-1]))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "\n".join(f"own {k}" for k in range(2_000)), 3: ""}


# ------------------------------------------------------------------ fixity


def fixity_by_hand(ours, theirs):
    def leaf(rows):
        out = {}
        for i, url, html in rows:
            http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "")
            record = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {url or ''}\r\nWARC-Record-ID: <urn:page:{'' if i is None else i}>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http.encode())}\r\n\r\n{http}\r\n\r\n"
            out.setdefault(i, []).append(record.encode())
        return {i: sorted(x) for i, x in out.items()}

    a, b = leaf(ours), leaf(theirs)
    at, out = 0, {}
    for i in sorted(a, key=lambda x: (x is None, x)):
        size = sum(map(len, a[i]))
        out[i] = (at, size, "ok" if a[i] == b.get(i) else "corrupt" if i in b else "missing")
        at += size
    return out | {i: (None, None, "extra") for i in b if i not in a}


@pytest.mark.parametrize("bits", [1, 8])
def test_fixity_of_null_negative_and_far_ids(spark, bits):
    rng = random.Random(bits)
    ids = [None, None, -(1 << 63), -70_000, -2, -1, 0, 1, 1, 5, 255, 256, 70_000, (1 << 62) + 3] if bits == 8 else [None, -9, -3, -1, 0, 2, 3, 3, 40]
    ours = [(i, f"http://h/{k}", text(rng, 20), "clash") for k, i in enumerate(ids)]
    schema = "page_id long, url string, html string, digest string"
    left = warc.records(spark.createDataFrame(ours, schema))
    for lost, changed in ((None, None), (0, 2), (3, 5), (len(ids) - 1, 4), (1, 0)):
        theirs = [(i, u, h + "!" if k == changed else h, c) for k, (i, u, h, c) in enumerate(ours) if lost is None or k != lost] + ([] if lost is None else [(77, "new", None, "clash")])
        got = warc.fixity(left, warc.records(spark.createDataFrame(theirs, schema)), bits=bits).collect()
        assert {r.page_id: (r.offset, r.bytes, r.status) for r in got} == fixity_by_hand([x[:3] for x in ours], [x[:3] for x in theirs])


def test_fixity_goes_down_only_where_nodes_differ(spark):
    pages = [(k, "u", f"page {k}") for k in range(600)]
    left, right = (warc.leaves(warc.records(spark.createDataFrame([(k, u, h + "x" * (k == bad)) for k, u, h in pages], "page_id long, url string, html string"))) for bad in (-1, 333))
    a, b = (warc.tree(x, warc.height(left, right, bits=4), 4) for x in (left, right))
    assert [x.count() for x in a] == [600, 38, 3, 1]
    assert [r.node for r in warc.audit(a, b).collect()] == [333]
    # With the damaged branch's parent hidden from the level above, nothing below it is found.
    spoiled = [*b[:-1], a[-1]]
    assert warc.audit(a, spoiled).count() == 0


# ------------------------------------------------------------------ mixing


def test_rows_of_one_id_are_mixed_each(spark):
    import corpus_pipeline as P

    rng = random.Random(5)
    rows = [(7, text(rng, 30), "en", "a", 0, "s", 0), (7, text(rng, 30), "en", "b", 0, "s", 0)] + [(k, text(rng, 30), "en", "b" if k % 4 else "a", 0, "s", 0) for k in range(10, 30)] + [(40, None, "en", "a", 0, "s", 0), (None, "word", "en", None, 0, "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    taken = {(r.doc_id, r.source): r.taken // r.size for r in mixing.mix(df, whole=True).collect() if r.size}
    got = {}
    for r in P.mix_sources(spark, df, TINY).collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    assert got == {k: n for k, n in taken.items() if n} | {(40, "a"): 1}


def test_free_names(spark):
    assert free_name(spark.createDataFrame([], "a int, A_ int"), "a") == "a__"


# ------------------------------------------------------------------ near dedup


def test_near_dedup_where_small_nodes_branch(spark):
    rng = random.Random(8)
    passage, rows = text(rng, 60), []
    for k in range(60):
        own = f"{passage} {text(rng, 90)}".split()
        for copy in range(3):
            rows.append((3 * k + copy, " ".join(own)))
            own[rng.randrange(len(own))] = f"x{k}"
    sets = [shingles(t) for _, t in rows]
    roots = groups_by_hand(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    least = {r: min(i for i, s in enumerate(roots) if s == r) for r in roots}
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), most=8, block=4).collect()}
    assert got == {k: least[r] for k, r in enumerate(roots)}


def test_null_and_repeated_ids_near_dedup(spark):
    base = [f"v{k}" for k in range(120)]
    near, far = " ".join(["x", *base[1:]]), " ".join(reversed(base))
    rows = [(None, " ".join(base), "a"), (None, near, "b"), (None, far, "c"), (None, far, "d"), (5, "lone text of some six words", "e"), (5, " ".join(base), "f"), (9, "", "g"), (None, None, "h"), (9, "", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near_duplicates(df).collect())
    assert got == sorted([(-1, 116, 5, False), (-1, 116, 5, False), (-1, 116, -1, False), (-1, 116, -1, False), (5, 2, 5, True), (5, 116, 5, True), (9, 0, 9, True), (-1, 0, -1, False), (9, 0, 9, True)])
    left = without_near_copies(df)
    assert left.columns == df.columns
    names = sorted(r.row_key for r in left.collect())
    assert [n for n in names if n not in "cd"] == ["e", "f", "g", "h", "i"] and len(names) == 6
    assert not any(t.name.startswith("ledgerloom_sets") for t in spark.catalog.listTables())


def test_recall_of_near_dedup(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared: dict = {}
    for x in holders.values():
        for a in range(len(x)):
            for b in range(a):
                key = (min(x[a], x[b]), max(x[a], x[b]))
                shared[key] = shared.get(key, 0) + 1
    parent = {i: i for i in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


# ------------------------------------------------------------------ embeddings


def links_by_hand(vecs, threshold=0.9):
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(vecs))
    while True:
        new = np.array([min(label[k], *label[near[k]]) if near[k].any() else label[k] for k in range(len(vecs))])
        if (new == label).all():
            return near.sum(axis=1), label
        label = new


@pytest.mark.parametrize("dim", [3, 24])
def test_embeddings_by_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((250, dim))
    vecs = np.concatenate([base, base[:80] + 0.15 * rng.standard_normal((80, dim)), base[:10], base[:40] + 0.3 * rng.standard_normal((40, dim))])
    n, label = links_by_hand(vecs)
    df = spark.createDataFrame([(k, [float(x) for x in v], "x") for k, v in enumerate(vecs)], "vec_id long, embedding array<double>, cls string")
    got = {r.vec_id: r for r in embedding_duplicates(df, block=16, fill=32).collect()}
    assert [got[k].n_links for k in range(len(vecs))] == n.tolist()
    assert [got[k].component_id for k in range(len(vecs))] == label.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embeddings_of_repeated_ids_and_the_recall(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id")
    rows = table.collect()
    n, label = links_by_hand(np.array([r.embedding for r in rows], dtype=float))
    got = {r.vec_id: r for r in embedding_duplicates(table, fill=64).collect()}
    assert [got[r.vec_id].n_links for r in rows] == n.tolist()
    assert [got[r.vec_id].component_id for r in rows] == [rows[k].vec_id for k in label]


# ------------------------------------------------------------------ media


def test_media_by_hand_and_header_only_reads(spark, odd, tmp_path, monkeypatch):
    got = {}
    for r in media.media_columns(odd).collect():
        got.setdefault(r.payload_sha256, set()).add((r.n_bytes, r.media_bytes, r.media_sha256, r.feature, r.width, r.height, r.bits, r.colour))
    for row in odd_rows():
        n, pay = len((row[1] or "").encode()), (row[1] or "").encode()
        pay += b" " * (max(1, math.ceil(n / 192)) * 192 - n)
        lines = b"".join(b"\0" + pay[k : k + 192] for k in range(0, len(pay), 192))
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, len(pay) // 192, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")
        feature = f"png 64x{len(pay) // 192}x8 colour 2 mean {sum(pay) / len(pay):.4f}"
        assert (n, len(png), hashlib.sha256(png).hexdigest(), feature, 64, len(pay) // 192, 8, 2) in got[hashlib.sha256(pay).hexdigest()]
    folder = f"file://{tmp_path}/media"
    index = media.store(odd, folder).toArrow().combine_chunks().to_batches()
    read = []
    real = media._Shards.read
    monkeypatch.setattr(media._Shards, "read", lambda self, shard, offset, length: read.append(length) or real(self, shard, offset, length))
    list(media._headers(folder)(iter(index)))
    assert set(read) == {33} and len(read) == len(odd_rows())


# ------------------------------------------------------------------ packing


def test_every_piece_and_the_fill(spark, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)

    def pieces(rows, length):
        out = []
        for i, t in rows:
            ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
            for at in range(0, len(ids), length):
                piece = ids[at : at + length]
                out.append((-1 if i is None else i, at, len(piece), zlib.crc32(np.array(piece, dtype="<u4").tobytes()), len(ids)))
        return sorted(out)

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    for df, rows, length in ((odd, [(r[0], r[1]) for r in odd_rows()], 256), (docs, [(r.doc_id, r.text) for r in docs.collect()], 4096)):
        got = packing.pack(df, path, length=length, rows_a_bucket=3).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == pieces(rows, length)
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in by.values():
            assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1]] and sum(n for _, n in own) <= length
    used = sum(r.length for r in got)
    assert used / (4096 * len(by)) > 0.97


def test_a_tokenizer_of_another_kind_gets_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"a": 0, "b": 1, "▁a": 3, "▁b": 4, "?": 5}, unk_token="?"))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="never")
    tok.save(str(tmp_path / "t.json"))
    enc = packing.Encoder(str(tmp_path / "t.json"))
    assert enc.whole and [np.frombuffer(x, dtype="<u4").tolist() for x in enc.encode(["a b", "b a", ""])] == [[0, 4], [1, 3], []]


# ------------------------------------------------------------------ classifiers


def density_by_hand(weights, value):
    folded = toxicity.fold(value or "")
    words = folded.split()
    spared = set()
    for phrase in toxicity.EXCEPTIONS:
        own = toxicity.fold(phrase).split()
        spared |= {k + j for k in range(len(words)) if words[k : k + len(own)] == own for j in range(len(own))}
    total = 0.0
    for k, w in enumerate(words):
        fits = [x for t, x in weights.items() if (w.startswith(t[:-1]) if t.endswith("*") else w == t)]
        total += 0 if k in spared else max(fits, default=0.0)
    return total / len(words) if words else 0.0


def test_scores_by_hand(spark, odd):
    docs, labels = (spark.read.parquet(f"{TINY}/{t}.parquet") for t in ("documents", "labels"))
    terms, curve = toxicity.learn(docs, labels)
    extra = [(500, "You stupid class clown and stupid 1D10T", "en", "a", 0, "", 0), (501, "trash can, trash", "en", "a", 0, "", 0)]
    some = odd.union(spark.createDataFrame(extra, DOCS))
    want = sorted(density_by_hand(dict(terms), r[1]) for r in odd_rows() + extra)
    rows = toxicity.score(some, terms, curve).collect()
    assert sorted(r.density for r in rows) == pytest.approx(want)
    for r in rows:
        assert r.score == pytest.approx(1 / (1 + math.exp(-(curve[0] + curve[1] * math.log(r.density + 1e-4)))))
    model = quality.learn(docs, labels)
    want = sorted(float(model.score(np.array([quality.features(r[1])]))[0]) for r in odd_rows())
    assert sorted(r.score for r in quality.score(odd, model).collect()) == pytest.approx(want)


def test_exceptions_of_one_very_long_text():
    weights = {"clown": 3.0, "stupid": 2.0, "idiot": 1.0}
    value = "class clown fish, stupid idiot proof clown. " * 300
    lexicon = toxicity.Lexicon(weights)
    assert lexicon.density(value)[0] == pytest.approx(density_by_hand(weights, value)) == pytest.approx(5 / 7)
    began = time.time()
    assert lexicon.density(value * 200) == (pytest.approx(5 / 7), 420_000)
    assert time.time() - began < 20  # pairs of a match and a phrase would take hours


def test_quality_leaves_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in quality.quality(docs, labels).where("held_out").collect() if r.doc_id in truth]
    assert np.mean([p for p, y in held if y]) > 0.97 and np.mean([p for p, y in held if not y]) < 0.05


def test_a_repeated_labelled_id_is_learned_from_once(spark):
    docs = spark.createDataFrame([(1, f"text {k % 3}") for k in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    from ledgerloom.llm.sampling import labelled_sample

    assert sorted((r.doc_id, r.text, r.y) for r in labelled_sample(docs, labels, "toxic", (9, 10), 10).collect()) == [(1, "text 0", 1), (2, "other", 0)]


# ------------------------------------------------------------------ language


def identify_by_hand(pages, docs, temper=0.15, most=12.0, kappa_host=4.0, kappa_domain=20.0):
    langs, table = language.learn(docs)
    n, rows = len(langs), []
    for i, url, html in pages:
        counts = language.trigrams(language.page_text(html))
        at = np.flatnonzero(counts)
        e = temper * (table[:, at] @ counts[at]) if len(at) else np.zeros(n)
        e = np.maximum(e - e.max(), -most)
        u = (url or "").lower()
        host = (re.match(r"[a-z][a-z0-9+.-]*://([^/?#:]+)", u) or ["", ""])[1]
        first = lambda p, s: next((m for m in [(re.search(p, s) or ["", ""])[1]] if m in langs), None)
        suffix = first(r"^[^?#]*?//[^/]+/([a-z]{2})(?:[/?#]|$)", u) or first(r"[?&](?:lang|hl|locale)=([a-z]{2})", u) or first(r"\.([a-z]{2})$", host) or ""
        declared = first(r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", (html or "").lower()) or ""
        rows.append([i, e.astype(float), np.exp(e) / np.exp(e).sum(), declared, suffix, host])
    total = sum(r[2] for r in rows) + 1.0
    prior = total / total.sum()
    said = {}
    for col in (3, 4):
        share = {v: np.ones(n) * 0.5 for v in ["", *langs]}
        for r in rows:
            share[r[col]] = share[r[col]] + r[2]
        said[col] = {v: np.log(x / sum(share.values())) for v, x in share.items()}
    domain = lambda h: (re.search(r"([^.]+\.[^.]+)$", h) or ["", ""])[1]
    out = []
    for r in rows:
        at_host = sum((x[2] for x in rows if r[5] and x[5] == r[5]), np.zeros(n)) - (r[2] if r[5] else 0)
        at_domain = sum((x[2] for x in rows if r[5] and x[5] and domain(x[5]) == domain(r[5])), np.zeros(n)) - (r[2] if r[5] else 0)
        at_host, at_domain = np.maximum(at_host, 0), np.maximum(at_domain, 0)
        of_domain = (at_domain + kappa_domain * prior) / (at_domain.sum() + kappa_domain)
        of_host = (at_host + kappa_host * of_domain) / (at_host.sum() + kappa_host)
        e = r[1] + said[3][r[3]] + said[4][r[4]] + np.log(of_host + 1e-12)
        p = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        out.append((r[0], langs[int(p.argmax())], round(float(p.max()), 4)))
    return out


def test_language_by_hand(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    some = docs.where("text is not null").orderBy("doc_id").limit(30).collect()
    pages = [(k, [f"http://{h}.site.fr/p{k}", f"https://{h}.site.fr/de/p{k}", f"http://other.org/?lang=es&p={k}", None][k % 4], f"<html{' lang=en' * (k % 3 == 0)}><body>{r.text}</body></html>") for k, r in enumerate(some) for h in (["a", "b"][k % 2],)]
    pages += [(100, "http://a.site.fr/x", None), (101, None, None), (102, "odd", ""), (103, "http://lone.example.es/", "<p></p>"), (103, "http://lone.example.es/", "<p></p>")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    got = sorted((r.page_id, r.lang, round(r.confidence, 4)) for r in language.identify(df, docs).collect())
    assert [g[:2] for g in got] == [w[:2] for w in sorted(identify_by_hand(pages, docs))]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in sorted(identify_by_hand(pages, docs))], abs=2e-4)


def test_a_rare_language_has_a_model(spark):
    rows = [(k, text(random.Random(k), 20), "en") for k in range(3000)] + [(5000 + k, "zq xk vj " * 20, "xx") for k in range(2)]
    assert language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_docs=100)[0] == ["en", "xx"]


# ------------------------------------------------------------------ pipeline


def planted():
    rng = random.Random(12)
    passage = "\n".join(text(rng, 8) for _ in range(6))
    rows = []
    for k in range(40):
        own = text(rng, rng.randrange(60, 160))
        if k % 5 == 0:
            own = f"{own}\n{passage}\n{text(rng, 30)}"
        rows.append((k, own, "en", "abc"[k % 3], len(own)))
    for k in range(40, 52):  # copies: equal, and near ones at over 80 of 100
        words = rows[k - 40][1].replace("\n", " ").split()
        if k % 2:
            words[len(words) // 2] = "changed"
        rows.append((k, " ".join(words), "en", "abc"[k % 3], 0))
    rows += [(60 + k, f"you stupid idiot moron {text(rng, 6)} pathetic scum", "en", "a", 0) for k in range(4)]
    rows += [(70, None, None, None, None), (71, "", "en", "a", 0), (72, " \n\n ", "en", None, 4), (None, text(rng, 50), "en", "b", 0), (0, text(rng, 70), "de", "c", 0), (73, text(rng, 5000), "en", "a", 0)]
    return rows


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(planted(), schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [tuple(r) for r in docs.collect()]
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]

    def ran(name):
        nonlocal docs
        out = stages[name](spark, docs, str(tmp_path))
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        return sorted((tuple(r) for r in docs.collect()), key=key)

    # Without labels, the base lexicon and the fixed curve decide.
    curve = toxicity.DEFAULT_CURVE
    weights = {w: toxicity.BASE_WEIGHT for w in toxicity.BASE}
    kept = [r for r in kept if 1 / (1 + math.exp(-(curve[0] + curve[1] * math.log(density_by_hand(weights, r[1]) + 1e-4)))) < 0.7]
    assert not any(r[0] is not None and 60 <= r[0] < 64 for r in kept) and len(kept) == len(planted()) - 4
    assert ran("toxicity") == sorted(kept, key=key)

    # Line dedup: rows of one id in order of their text's hash; none of these share a window.
    texts = [(r[0], r[1]) for r in kept if r[0] is not None and r[1] is not None]
    stays = dict(zip(texts, (t for _, t in lines_by_hand(texts)), strict=True))
    kept = [r if (r[0], r[1]) not in stays or stays[r[0], r[1]] == r[1] else (r[0], stays[r[0], r[1]], *r[2:4], len(stays[r[0], r[1]])) for r in kept]
    assert ran("line dedup") == sorted(kept, key=key)

    sets = [shingles(r[1]) for r in kept]
    roots = groups_by_hand(sets, lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    best = {}
    for r, root in zip(kept, roots, strict=True):
        best[root] = min(best.get(root, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    kept = [r for r, root in zip(kept, roots, strict=True) if best[root] is r]
    assert ran("near dedup") == sorted(kept, key=key) and len(kept) < len(roots) - 8

    # Mixing, whole: water filling by hand, then documents in order of their hash.
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[3] for r in kept}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r[1]) for r in kept if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    goal, open_ = dict.fromkeys(sources, 0.0), set(sources)
    budget = 1.5 * sum(total.values())
    while open_:
        level = (budget - sum(goal[s] for s in sources if s not in open_)) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * total[s]}
        for s in full or open_:
            goal[s] = 2 * total[s] if full else weight[s] * level
        open_ = open_ - full if full else set()
    want = []
    for s in sources:
        own = sorted((r for r in kept if r[3] == s and size(r[1])), key=lambda r: int(hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest()[:15], 16))
        times, left = divmod(round(round(goal[s], 6)), total[s]) if total[s] else (0, 0)
        for r in own:
            more = left > 0 and (left >= size(r[1]) or 2 * left >= size(r[1]))
            want += [r] * (times + more)
            left -= size(r[1])
        want += [r for r in kept if r[3] == s and not size(r[1])]
    assert ran("mixing") == sorted(want, key=key)

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = [tuple(r) for r in stages["packing"](spark, docs, str(tmp_path)).collect()]
    tokens = sorted((r[0] is None, r[0] or 0, len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in want)
    assert sorted((r[0] is None, r[0] or 0, r[4]) for r in got if r[1] == 0) == tokens
    assert sum(r[2] for r in got) == sum(n for *_, n in tokens)
    assert len(P.run(spark, str(tmp_path)).collect()) == len(got)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_clashing_names(spark, odd):
    import corpus_pipeline as P

    wide = odd.withColumns({"__times": F.lit(1), "row_key": F.lit("k"), "mix": F.lit(0), "line_dedup": F.lit(2), "__gone": F.lit(3)})
    for name, stage in P.STAGES[1:4]:
        out = stage(spark, wide, TINY)
        assert out.columns == wide.columns and out.where("row_key <> 'k' or line_dedup <> 2 or mix <> 0").count() == 0, name
