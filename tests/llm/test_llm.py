"""The ten operators against brute force, round trips, held-out rows and odd tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import language, line_dedup, media, mixing, packing, quality, queries, toxicity, warc
from ledgerloom.llm.common import components
from ledgerloom.llm.embed_dedup import embedding_duplicates
from ledgerloom.llm.near_dedup import near_duplicates

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, node int"
WORDS = [f"w{k}" for k in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(3)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one two", "en", "b"), (5, "ONE  two", "en", "b"), (6, text(rng, 30_000), "en", "a"), (7, text(rng, 50), None, "b"), (7, text(rng, 50), None, "b"), (None, text(rng, 40), "de", None), (8, "é ß " * 20, "de", "c")]
    base = text(rng, 200).split()
    for k in range(9, 40):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 4])):
            own[rng.randrange(200)] = rng.choice(WORDS)
        rows.append((k, " ".join(own), "en", "a" if k % 3 else "b"))
    rows.append(rows[-1])
    return [(i, t, lang, s, len(t or ""), "clash", 0) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(t):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_dedup_equals_brute_force(spark, odd, empty):
    rows = odd_rows()
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), 10**9), r[0])
    want = sorted((r[0] or -1, len(sets[k]), least.get(root(k), -1)) for k, r in enumerate(rows))
    got = sorted((r.doc_id or -1, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in near_duplicates(odd).collect())
    assert got == want
    assert near_duplicates(empty).count() == 0


def test_near_dedup_keeps_its_recall_where_nodes_branch(spark):
    # A passage in all documents makes nearly every node large; each pair shares 170 of 200 shingles, others at most 159 of 211.
    passage = " ".join(f"c{k}" for k in range(163))
    rows = [(2 * p + side, f"{passage} {' '.join(f'p{p}x{k}' for k in range(11))} {' '.join(f'd{p}x{side}x{k}' for k in range(15))}") for p in range(100) for side in range(2)]
    sets = [shingles(t) for _, t in rows]
    assert all((100 * len(a & b) >= 85 * len(a | b)) == (i // 2 == j // 2) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), most=1).collect()}
    assert got == {k: k // 2 * 2 for k in range(200)}


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (5, 5), (200, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 200: 100}


def test_mixing(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(odd_rows())
    total = sum(r.size for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2  # rows that share a hash round down
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * total, rel=1e-6)
    assert mixing.mix(empty).count() == 0
    assert all(r.taken in (0, r.size, 2 * r.size) for r in mixing.mix(odd, whole=True).collect())


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    want = sorted((zlib.crc32(np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [2], dtype="<u4").tobytes()[:16384])) for r in odd_rows())
    rows = packing.pack(odd, path).collect()
    assert sorted(r.ids_crc32 for r in rows if r.start == 0) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(empty, path).count() == 0
    tricky = ["It's <|endoftext|> 12a3 İstanbul ΣΑΣ", "Ünïcödé-mix: éx (a) don't!! 100% ab​c", "x" * 5000]
    enc = packing.Encoder(path)
    for t, ids in zip(tricky, enc.encode(tricky), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_patterns_cover_the_demand():
    rng = np.random.default_rng(1)
    demand = np.zeros(64, dtype=np.int64)
    demand[rng.integers(0, 64, 30)] = rng.integers(1, 500, 30)
    plan = packing.plan_patterns(demand)
    assert (sum(p * n for p, n in plan) == demand).all()
    assert all((p * np.arange(1, 65)).sum() <= 64 for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.1 * (demand * np.arange(1, 65)).sum() / 64 + 2
    assert packing.plan_patterns(np.zeros(8, dtype=np.int64)) == []


def test_media_round_trip(spark, odd, empty, tmp_path):
    folder = f"file://{tmp_path}/media"
    index = media.store(odd, folder)
    got = media.read_back(index, folder).collect()
    want = []
    for r in odd_rows():
        raw = (r[1] or "").encode()
        pay = raw + b" " * (max(1, math.ceil(len(raw) / 192)) * 192 - len(raw))
        want.append((len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:])))
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert all(r.width == 64 and r.bits == 8 for r in media.with_metadata(index, folder).collect())
    assert media.media_columns(empty).count() == 0
    import tarfile

    for shard in (tmp_path / "media").iterdir():
        assert all(m.name.endswith(".png") for m in tarfile.open(shard))


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 16))
    vecs = np.concatenate([base, base[:60] + 0.2 * rng.standard_normal((60, 16)), base[:5], 3 * base[5:8]])
    rows = [(k, [float(x) for x in v], "x") for k, v in enumerate(vecs)] + [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [float("nan")] * 16, "x"), (903, [], "x"), (904, [1.0, None], "x"), (905, [1.0, 2.0], "x"), (None, [float(x) for x in base[0]], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, links string")
    got = {r.vec_id: r for r in embedding_duplicates(df, block=16).collect()}
    every = np.concatenate([vecs, base[:1]])
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert [got[k].n_links for k in range(len(vecs))] == links[: len(vecs)].tolist()
    assert all(got[k].n_links == 0 and got[k].kept for k in range(900, 906))
    assert embedding_duplicates(df.where("false")).count() == 0


def _rates(rows, labels, held):
    pairs = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out == held and r.doc_id in labels]
    good = [p for p, y in pairs if y]
    bad = [p for p, y in pairs if not y]
    return sum(good) / max(1, len(good)), sum(bad) / max(1, len(bad))


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).collect()
    caught, wrong = _rates(rows, {r.doc_id: r.toxic for r in labels.collect()}, True)
    assert caught > 0.9 and wrong < 0.02
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out and 0 <= r.score <= 1 for r in rows)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs, labels).collect()
    caught, wrong = _rates(rows, {r.doc_id: r.quality for r in labels.collect()}, True)
    assert caught > 0.97 and wrong < 0.25


def test_classifiers_on_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for f in (toxicity.toxicity, quality.quality):
        rows = f(odd, labels).collect()
        assert len(rows) == len(odd_rows()) and all(r.predicted in (0, 1) for r in rows)
        assert len(f(odd, labels.where("false")).collect()) == len(rows)
        assert f(empty, labels).count() == 0


def test_folding():
    assert toxicity.fold("You 1D10T, ѕсum! $tupid 2024 ok") == " you idiot ldlot scum stupid 2024 ok "
    lexicon = toxicity.Lexicon({"trash": 2.0, "mor*": 1.0})
    assert lexicon.density("trash can trash") == (2 / 3, 3)
    assert lexicon.density("morons, mor, humor")[0] == pytest.approx(2 / 3)  # a beginning also matches the whole word
    assert lexicon.density(None) == (0.0, 0)


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.AdditiveModel(rounds=30).fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def lines_by_hand(rows):
    first, out = {}, []
    split = [(i, t.split("\n")) for i, t in rows]
    for i, ls in sorted(split):
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if any(w):
                first.setdefault(w, (i, p))
    for i, ls in split:
        gone = set()
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if any(w) and first[w] != (i, p):
                gone |= {q for q in range(p, p + 3) if first[w][0] != i or q >= first[w][1] + 3}
        out.append((i, "\n".join(x for q, x in enumerate(ls) if q not in gone)))
    return out


def test_line_dedup(spark, odd, empty):
    rng = random.Random(1)
    rows = [(k, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))) for k in range(60)] + [(90, "a\na\na\na\na\na"), (91, "\n\n\n"), (92, "x\ny")]
    df = spark.createDataFrame([(i, t, "keep") for i, t in rows], "doc_id long, text string, h string")
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect())
    assert got == sorted(lines_by_hand(rows))
    plan = line_dedup.dedup_lines(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert line_dedup.line_duplicates(odd).count() == len(odd_rows()) and line_dedup.line_duplicates(empty).count() == 0


def test_warc(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html")
    good = warc.records(pages)
    assert warc.fixity(good, good).where("status <> 'ok'").count() == 0
    bad = warc.fixity(good, warc.records(warc.damaged(pages))).groupBy("status").count().collect()
    ids = [r.page_id for r in pages.collect()]
    want = {"missing": sum(i % 103 == 11 for i in ids), "extra": sum(i % 107 == 13 for i in ids), "corrupt": sum(i % 103 != 11 and (i % 97 == 5 or i % 101 == 7) for i in ids)}
    assert {r.status: r["count"] for r in bad if r.status != "ok"} == {k: v for k, v in want.items() if v}
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "x")], "page_id long, url string, html string")
    assert warc.fixity(warc.records(odd), warc.records(odd.where("page_id is null or page_id <> 2"))).where("status = 'missing'").count() == 1
    assert warc.fixity(warc.records(odd.where("false")), warc.records(odd.where("false"))).count() == 0


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = docs.where("length(text) > 200").select("doc_id", "lang", F.concat(F.lit("<html><body>"), "text", F.lit("</body></html>")).alias("html"), F.lit(None).cast("string").alias("url"))
    got = language.identify(truth.withColumnRenamed("doc_id", "page_id"), docs).join(truth.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("true")), "page_id").collect()
    assert sum(r.lang == r.true for r in got) / len(got) > 0.95
    odd = spark.createDataFrame([(1, None, None), (2, "http://h.example.fr/de/x", "<html lang=de>"), (2, "nonsense", "<p>"), (None, "", "")], "page_id long, url string, html string")
    rows = language.identify(odd, docs).collect()
    assert len(rows) == 4 and [r.lang for r in rows if r.declared] == ["de"]
    assert language.identify(odd.where("false"), docs.where("false")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = P.drop_toxic(spark, docs, SMALL)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = [i for i, y in labels.items() if not y]
    assert sum(i in left for i in clean) >= 0.98 * len(clean)
    rows = P.run(spark, SMALL).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())
    near = {r.doc_id for r in P.drop_near_copies(spark, docs, SMALL).select("doc_id").collect()}
    assert near == {r.doc_id for r in near_duplicates(docs).where("kept").collect()}


def test_pipeline_drops_near_copies_from_80(spark):
    import corpus_pipeline as P

    def changed(*at):
        return " ".join(f"x{k}" if k in at else f"v{k}" for k in range(104))

    # Of 100 shingles, two words apart change ten (90 of 110 shared, 0.82) and three change fifteen (85 of 115, 0.74).
    docs = spark.createDataFrame([(1, changed(), "en", "a", 0, "", 0), (2, changed(30, 60), "en", "a", 0, "", 0), (3, changed(20, 50, 80), "en", "a", 0, "", 0)], DOCS)
    assert sorted(r.doc_id for r in dict(P.STAGES)["near dedup"](spark, docs, SMALL).collect()) == [1, 3]
