"""The kept index: what a search reads, breadcrumbs, hot terms, empty chunks, and who holds a passage."""

import os
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import tokens
from ledgerloom.operators import index, retrieval


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(k, f"common word{k % 7} text{k}") for k in range(200)] + [(1_000, ""), (1_001, "the of and"), (1_002, None)]
    return spark.createDataFrame(rows, "ord long, text string").repartition(4)


@pytest.fixture(scope="module")
def kept(chunks):
    return index.build(chunks, buckets=16, parts=3)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_are_tokenised_once(spark, chunks, monkeypatch):
    asked = []
    monkeypatch.setattr(index, "tokens", lambda c: asked.append(c) or tokens(c))
    kept = index.build(chunks)
    found = retrieval.search(kept, spark.createDataFrame([(1, "common")], "query_id int, text string"))
    assert len(asked) == 1 and found.count() == 200
    # The search's own plan splits the question's text alone.
    leaves = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Relation [" in x]
    assert leaves and not any("text#" in x for x in leaves)


def test_what_is_kept(kept, spark):
    assert (kept.chunks, kept.buckets) == (203, 16) and abs(kept.average - 600 / 203) < 1e-9
    assert {r.term: r.df for r in kept.frequencies().collect()}["common"] == 200
    assert sorted(r.ord for r in kept.lengths().where("length < 1").collect()) == [1_000, 1_001, 1_002]
    again = index.opened(spark, kept.path)
    assert again == kept
    folders = [f for f in os.listdir(kept.path.removeprefix("file://") + "/postings") if f.startswith("bucket=")]
    assert 3 < len(folders) <= 17


def test_a_search_reads_the_asked_buckets_only(kept, spark):
    terms = spark.createDataFrame([("text17",), ("absent",)], "term string")
    read = plan(kept.postings(terms).where("term = 'text17'"))
    assert "PartitionFilters: [isnotnull(bucket" in read or "PartitionFilters: [bucket" in read
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,text17)]" in read
    asked = re.search(r"PartitionFilters: \[([^\]]*)\]", read)[1]
    assert len(re.findall(r"(?<![#\w])\d+(?!\w)", re.sub(r"#\d+", "", asked))) <= 2, "a folder a term"
    assert [r.ord for r in kept.postings(terms).where("term = 'text17'").collect()] == [17]
    assert kept.postings(terms.where("false")).collect() == []


def test_a_frequent_term_is_shared_by_parts(kept, spark):
    common = kept.postings(spark.createDataFrame([("common",)], "term string")).where("term = 'common'")
    assert common.count() == 200


def test_search_scores_and_ties(kept, spark):
    asked = spark.createDataFrame([(1, "common text5 text5"), (2, "nothing"), (3, None), (4, "")], "query_id int, text string")
    found = retrieval.search(kept, asked)
    best = retrieval.ranked(found, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.ord) for r in best] == [(1, 5), (1, 0)]
    again = {(r.query_id, r.ord): r.score for r in retrieval.bm25(spark.createDataFrame([(k, f"common word{k % 7} text{k}") for k in range(200)] + [(1_000, "")] * 1 + [(1_001, ""), (1_002, "")], "ord long, text string"), asked).collect()}
    assert again == pytest.approx({(r.query_id, r.ord): r.score for r in found.collect()})


def test_breadcrumbs_are_found(spark):
    rows = [(1, "Payments", ["Design", "Context"], "we chose queues"), (2, "Search", [], "we chose trees"), (3, "Search", ["Context"], "")]
    kept = index.build(spark.createDataFrame(rows, "ord long, page_title string, heading_path array<string>, text string"))
    hits = lambda q: sorted(r.ord for r in retrieval.search(kept, spark.createDataFrame([(1, q)], "query_id int, text string")).collect())
    assert hits("payments") == [1] and hits("context") == [1, 3] and hits("search trees") == [2, 3] and hits("design queues") == [1]


def test_an_empty_index(spark):
    kept = index.build(spark.createDataFrame([], "ord long, text string"))
    assert kept.chunks == 0 and retrieval.search(kept, spark.createDataFrame([(1, "a word")], "query_id int, text string")).collect() == []


def test_holders_of_passages(spark):
    bodies = {1: "x alpha beta gamma delta y", 2: "alphabeta gamma", 3: "alpha beta gammadelta", 4: "alpha beta\ngamma delta", 5: "", 6: "short one"}
    docs = spark.createDataFrame(list(bodies.items()), "doc_id long, body string")
    chunks = docs.select("doc_id", F.posexplode(F.split("body", "\n")).alias("p", "text")).select((F.col("doc_id") * 10 + F.col("p")).alias("ord"), "text")
    items = [(1, "alpha beta gamma"), (2, "beta gamma"), (3, "a beta gamma"), (4, "one"), (5, "beta\ngamma"), (6, "alpha nowhere gamma"), (7, "-beta gamma delta"), (8, "")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.item_id, r.doc_id) for r in index.holders(index.build(chunks), asked, docs, F.expr("ord div 10")).collect())
    assert got == sorted((i, d) for i, t in items for d, b in bodies.items() if t in b)
