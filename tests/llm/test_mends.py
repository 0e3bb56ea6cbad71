"""Folders, left steps, hostile pages and the whole lexicon."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import language, sharding, toxicity, trie
from ledgerloom.llm.common import shared_folder
from ledgerloom.llm.embed_dedup import embedding_duplicates
from ledgerloom.llm.near_dedup import near_duplicates

from .test_llm import text


def steps(spark):
    at = shared_folder(spark).removeprefix("file://") + "/ledgerloom"
    return {f for f in os.listdir(at) if not f.startswith(".")} if os.path.isdir(at) else set()


def warehouse(spark):
    at = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
    return [f for f in os.listdir(at)] if os.path.isdir(at) else []


def copies(spark):
    rng = random.Random(8)
    base = [text(rng, 60) for _ in range(40)]
    return spark.createDataFrame([(k, base[k % 40] + (" and one more" if k % 3 else "")) for k in range(120)], "doc_id long, text string")


def test_the_shared_folder_has_its_file_system(spark):
    assert shared_folder(spark).startswith("file:///")


def test_near_dedup_leaves_what_the_result_reads(spark):
    before, was = steps(spark), warehouse(spark)
    out = near_duplicates(copies(spark))
    left = {f.rsplit("-", 1)[0] for f in steps(spark) - before}
    assert left <= {"sketches", "classes", "components"} and warehouse(spark) == was
    assert len({r.component_id for r in out.collect()}) == 40


def test_near_dedup_leaves_nothing_when_it_fails(spark, monkeypatch):
    from ledgerloom.llm import near_dedup

    before = steps(spark)
    monkeypatch.setattr(near_dedup, "_split", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        near_duplicates(copies(spark))
    assert {f.rsplit("-", 1)[0] for f in steps(spark) - before} <= {"sketches", "classes"}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ledgerloom_sets")]


def test_embedding_dedup_leaves_what_the_result_reads(spark):
    rng = random.Random(9)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(60)]
    before = steps(spark)
    out = embedding_duplicates(spark.createDataFrame(rows + [(100 + k, v) for k, v in rows], "vec_id long, embedding array<double>"))
    assert {f.rsplit("-", 1)[0] for f in steps(spark) - before} <= {"vectors", "components"}
    assert all(r.n_links >= 1 for r in out.collect())


@pytest.mark.parametrize("page", ["<" * 4_000_000, "<script" * 600_000, "<!--" * 1_000_000, "&" * 4_000_000, "<html" * 800_000 + " lang", "<script>" * 500_000 + ">"], ids=["open", "script", "comment", "entity", "html", "scripts"])
def test_hostile_pages_take_linear_time(page):
    began = time.time()
    language.page_text(page)
    assert time.time() - began < 6


def test_hostile_pages_take_linear_time_in_the_query(spark):
    page = "<html" * 400_000 + "x" * 1_000_000
    pages = spark.createDataFrame([(1, "http://" + "a" * 100_000, page), (2, "https://h.de/x", "<HTML x='1' LANG=de><p>a</p>")], "page_id long, url string, html string")
    docs = spark.createDataFrame([(k, f"{w} words here", lang) for k, (w, lang) in enumerate([("das", "de"), ("the", "en")] * 5)], "doc_id long, text string, lang string")
    began = time.time()
    got = {r.page_id: r.declared for r in language.identify(pages, docs).collect()}
    assert got == {1: None, 2: "de"} and time.time() - began < 60


def test_page_text_of_small_pages():
    assert language.page_text("a<b>c</b>d") == "a c d"
    assert language.page_text("a<SCRIPT x>var</script >b<style>q</STYLE>c") == "a b c"
    assert language.page_text("a<script>open <b>x") == "a open  x"
    assert language.page_text("a<!-- <b> -->c&amp;d&#12;e") == "a c d e"
    assert language.page_text("a < b &lt; c") == "a < b   c"
    assert language.page_text("<navy>x</navy>") == " x "
    assert language.page_text(None) == ""


def test_the_lexicon_has_all_supported_terms(spark):
    words = ["vile" + "".join(chr(97 + k // 26**d % 26) for d in range(4)) for k in range(6_000)]
    toxic = [" ".join(words[k * 200 : (k + 1) * 200]) for k in range(30)]
    docs = spark.createDataFrame([(3 * k, t) for k, t in enumerate(toxic * 4 + ["kind plain words"] * 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(3 * k, int(k < 120)) for k in range(180)], "doc_id long, toxic int")
    terms, _ = toxicity.learn(docs, labels, fold_out=(7, 5))
    assert len({t for t, _ in terms} & set(words)) == 6_000


def test_over_two_hundred_languages(spark):
    """Every language of the corpus has a model; a page goes to the one whose words it has."""
    rng = random.Random(12)
    words = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 9))) for _ in range(12)] for k in range(250)}
    say = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(60))
    docs = spark.createDataFrame([(k, say(lang), lang) for k, lang in enumerate(sorted(words) * 2)], "doc_id long, text string, lang string")
    pages = [(k, f"http://h{k % 7}.example/", f"<p>{say(lang)}</p>", lang) for k, lang in enumerate(sorted(words))]
    got = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string, truth string"), docs).collect()
    assert len(got) == 250 and sum(r.lang == pages[r.page_id][3] for r in got) >= 245


def test_hosts_priors_are_dropped_but_for_what_the_result_reads(spark):
    docs = spark.createDataFrame([(1, "der hund", "de"), (2, "the dog", "en")], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.example/", "<p>the dog</p>"), (None, None, None)], "page_id long, url string, html string")
    before = steps(spark)
    out = language.identify(pages, docs)
    assert {f.rsplit("-", 1)[0] for f in steps(spark) - before} == {"evidence", "host-priors"}
    assert out.count() == 2


def test_shards_and_trie_leave_what_the_result_reads(spark):
    before = steps(spark)
    rows = spark.createDataFrame([(k % 50, str(k % 40) * (k % 9), k, k) for k in range(400)], "doc_id long, text string, min0 long, own_d0 long")
    out, name = sharding.shards(rows)
    assert {f.rsplit("-", 1)[0] for f in steps(spark) - before} <= {"open-buckets", "pieces", "repeated", "tied"}
    assert out.count() == 400  # no column is read, also where repeated rows have numbers of their own
    assert out.columns == [*rows.columns, name] and sorted(r.min0 for r in out.collect()) == list(range(400))
    before = steps(spark)
    turns = spark.createDataFrame([(c, t, "user", str(c * t % 5)) for c in range(30) for t in range(4)], "conv_id long, turn int, role string, text string")
    nodes = trie.prefix_trie(turns)
    assert {f.rsplit("-", 1)[0] for f in steps(spark) - before} == {"positions"}
    assert nodes.where("depth = 0").collect()[0].n_convs == 30
