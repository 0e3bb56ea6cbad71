"""Literal cases of parsing, chunking, grounding, links, percentiles, logs and plans."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerloom import catalogue
from ledgerloom.functions import text as T
from ledgerloom.operators import chunking, grounding, ranks, retrieval, rollup, rules, trace, wording
from ledgerloom.plans import gates, views
from ledgerloom.sources import ingest, readers

SMALL = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# ---------------------------------------------------------------- parsing


def test_sections_of_storage_format():
    page = (
        "<p>Before</p><h1>Top  level</h1><p>a<br/>b</p><ac:structured-macro ac:name='TOC'><p>gone</p></ac:structured-macro>"
        "<ac:structured-macro ac:name='Info'><ac:parameter ac:name='title'>gone</ac:parameter><ac:rich-text-body><p>kept</p></ac:rich-text-body></ac:structured-macro>"
        "<h2>Table</h2><table><tr><th>h</th><td>c</td></tr></table><ri:attachment ri:filename='f.png'/><![CDATA[x < y]]><h3></h3>"
    )
    got = ingest.sections_of(page)
    assert [(s["heading"], s["level"]) for s in got] == [(None, 0), ("Top level", 1), ("Table", 2)]
    assert got[0]["text"] == "Before" and got[1]["text"] == "a\n\nb\n\nkept" and got[2]["text"].split("\n")[0] == "| h | c"
    assert [s["text"] for s in ingest.sections_of("<p>a</p><ac:structured-macro ac:name='code'><ac:plain-text-body><![CDATA[if x:\n\ty]]></ac:plain-text-body></ac:structured-macro>")] == ["a\n\nif x:\ny"]
    assert "[attachment: f.png]" in got[2]["text"] and "x < y" in got[2]["text"] and "gone" not in json.dumps(got)
    assert ingest.sections_of(None) == ingest.sections_of("") == []


def chunked(sections, **how):
    return list(chunking.chunks_of([{"heading": h, "level": lv, "text": t} for h, lv, t in sections], **how))


def test_chunks_merge_forward_and_name_their_headings():
    long, short = "x" * 250, "y" * 50
    assert chunked([("A", 1, short), ("B", 2, long)]) == [(["A"], f"{short}\n\n{long}", "B")]
    assert chunked([(None, 0, short), ("B", 2, long)]) == [(["B"], f"{short}\n\n{long}", None)]
    assert chunked([("A", 1, long), ("B", 2, ""), ("C", 3, long), ("D", 2, short)]) == [(["A"], long, None), (["A", "B", "C"], long, None), (["A", "D"], short, None)]
    assert chunked([("A", 1, long), (None, 0, long)]) == [(["A"], long, None), ([], long, None)]
    assert chunked([("A", 1, short), ("B", 1, "z" * 1990)]) == [(["A"], short, None), (["B"], "z" * 1990, None)]
    assert chunked([("A", 1, "one two. three four.\n\nfive six.")], most=12, least=0) == [(["A"], "one two.", None), (["A"], "three four.", None), (["A"], "five six.", None)]


def test_chunk_queries_run(spark):
    rows = catalogue.queries()["chunk_pages"](spark, SMALL).collect()
    pages = {r.page_id: r for r in ingest.page_sections(views.read(spark, SMALL, "pages")).collect()}
    for page_id, page in pages.items():
        own = sorted((r for r in rows if r.page_id == page_id), key=lambda r: int(r.chunk_id.split("#")[1]))
        want = list(chunking.chunks_of([s.asDict() for s in page.sections]))
        assert [r.text for r in own] == [t for _, t, _ in want] and [r.chunk_id for r in own] == [f"{page_id}#{k}" for k in range(len(want))]
    split = catalogue.queries()["split_oversized"](spark, SMALL).collect()
    texts = {str(r.doc_id): r.text for r in views.read(spark, SMALL, "documents").collect()}
    joined = {}
    for r in sorted(split, key=lambda r: (r.page_id, int(r.chunk_id.split("#")[1]))):
        joined.setdefault(r.page_id, []).append(r.text)
    assert all("".join("".join(parts).split()) == "".join(texts[i].split()) for i, parts in joined.items())


def test_comments_and_release_by_path(spark):
    tree = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "see"}, {"type": "text", "text": '"cf_1"'}]}]}
    fields = {"project": {"key": "P"}, "created": "2001-01-01T00:00:00.000+0000", "summary": 'names "cf_1" here', "cf_1": [{"value": " Q1 "}], "comment": {"comments": [{"id": "1", "body": tree}, {"id": "2", "body": "42"}, {"id": "3", "body": None}, {"id": "4", "body": "{odd"}]}}
    issue = ingest.map_issues(spark.createDataFrame([(json.dumps({"key": "P-1", "fields": fields}),)], "payload string"), "cf_1")[0].first()
    assert issue.target_release == "Q1" and issue.summary == 'names "cf_1" here'
    assert [c.body for c in issue.comments] == ['see "cf_1"', "42", "", "{odd"]


def test_links_by_direction(spark):
    kind = {"name": "Blocker", "inward": "is caused by", "outward": "causes"}
    side = {"key": "B-1", "fields": {"status": {"statusCategory": {"key": "done"}}}}
    fields = {"project": {"key": "P"}, "created": "2001-01-01T00:00:00Z", "issuelinks": [{"type": kind, "inwardIssue": side, "outwardIssue": {"key": "no"}}, {"type": kind, "outwardIssue": side}, {"type": kind}, {"type": {"name": "", "inward": "blocked by"}, "inwardIssue": {"key": "C"}}]}
    links = ingest.map_issues(spark.createDataFrame([(json.dumps({"key": "P-1", "fields": fields}),)], "payload string"))[0].first().links
    assert [(x.target_key, x.link_type, x.target_blocks_this, x.target_status_category) for x in links] == [("B-1", "blocker", True, "done"), ("B-1", "blocker", False, "done"), ("C", "unknown", False, None)]


def test_search_pages_end_where_they_say(spark):
    pages = [("a", 0, '{"issues":[{"key":"1"}],"nextPageToken":"x"}'), ("a", 1, '{"issues":[{"key":"2"}],"nextPageToken":"y","isLast":true}'), ("a", 2, '{"issues":[{"key":"3"}]}'), ("b", 0, '{"issues":[],"isLast":false}'), ("b", 1, '{"issues":[{"key":"4"}]}')]
    df = spark.createDataFrame(pages, "scope string, number int, payload string")
    assert sorted(r.payload for r in readers.items(readers.until_last(df), "issues").collect()) == ['{"key":"1"}', '{"key":"2"}']


def test_json_files(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [{"question": "q", "relevant_page_ids": ["1"]}, {"question": "r", "relevant_page_ids": [], "category": "negative", "must_not_retrieve": ["2"], "note": "n"}]}, indent=2))
    assert sorted(tuple(r) for r in readers.read_cases(spark, str(tmp_path / "cases.json")).collect()) == [("q", ["1"], "general", [], ""), ("r", [], "negative", ["2"], "n")]
    observed = spark.createDataFrame([("recall_at_5", 0.7), ("new", 0.25)], "key string, value double")
    thresholds = spark.createDataFrame([("recall_at_5", "recall@5", 0.5, 0.1, "higher_is_better", "ratio", False, "", 1)], "key string, name string, baseline double, tolerance double, direction string, unit string, sampled boolean, note string, baseline_runs int")
    bad = spark.createDataFrame([("recall_at_5", "regressed")], "key string, status string")
    with pytest.raises(RuntimeError):
        rollup.rebaseline(observed, bad, thresholds, f"file://{tmp_path}/b", "now", "why")
    with pytest.raises(ValueError):
        rollup.rebaseline(observed, bad.where("false"), thresholds, f"file://{tmp_path}/b", "now", " ")
    rollup.rebaseline(observed, bad.where("false"), thresholds, f"file://{tmp_path}/b", "now", "why", runs=3)
    got = {r.key: r for r in readers.read_thresholds(spark, f"file://{tmp_path}/b").collect()}
    assert got["recall_at_5"].baseline == 0.7 and got["recall_at_5"].tolerance == 0.1 and got["new"].baseline_runs == 3


def test_cache_write_through_and_replay(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    texts = spark.createDataFrame([("a",), ("b",)], "text string")
    empty = spark.createDataFrame([], "cache_key string, vector array<double>")
    readers.write_through(path, ingest.cache_misses(texts, empty, "m").withColumn("vector", F.array(F.lit(1.0))))
    more = spark.createDataFrame([("b",), ("c",)], "text string")
    assert [r.text for r in ingest.cache_misses(more, spark.read.parquet(path), "m").collect()] == ["c"]


# --------------------------------------------------------------- grounding


def test_sentences_keep_their_numbers(spark):
    assert one(spark, T.sentences(F.lit("0 of 3 done. 12 late 1. 2"))) == ["0 of 3 done.", "12 late 1.", "2"]
    assert one(spark, grounding.sentence_units(F.lit("First fact. [1] [2] Second fact. [3]"))) == ["First fact. [1] [2]", "Second fact. [3]"]
    assert one(spark, T.citations(F.lit("[3] and [99999999999999999999]"))) == [3, 2147483647]


def test_claims_and_sentence_grounding(spark):
    rows = [("a", "The gateway is late by a week. It was signed off in March [2].\n\nShort one. [1]", 2), ("b", "Nothing here has any source at all today.", 2), ("c", "Cited beyond the passages that are here [7].", 2)]
    df = spark.createDataFrame(rows, "answer_id string, text string, passages int")
    got = sorted((r.answer_id, r.claim, r.indices) for r in grounding.claims(df).collect())
    assert got == [("a", "It was signed off in March .", [2]), ("a", "The gateway is late by a week.", [2]), ("c", "Cited beyond the passages that are here .", [7])]
    by = {r.answer_id: (r.uncited_units, r.grounded, r.out_of_range) for r in grounding.check(df, per_sentence=True).collect()}
    assert by == {"a": (1, False, []), "b": (1, False, []), "c": (0, False, [7])}


def test_questions_part(spark):
    asked = ["Who owns Acme and any dates slip for O7?", "What does Acme Portal owe us, and there is a plan for it and who pays for that and what about audits?", "Is it late and why?", "Which pilot is blocked or stalled"]
    want = [["Who owns Acme", "any dates slip for O7 Acme"], ["What does Acme Portal owe us", "there is a plan for it Acme Portal", "who pays for that Acme Portal"], ["Is it late and why?"], ["Which pilot is blocked or stalled"]]
    df = spark.createDataFrame([(k, q) for k, q in enumerate(asked)], "k int, q string")
    assert [r.x for r in df.select("k", retrieval.subqueries(F.col("q")).alias("x")).orderBy("k").collect()] == want


def test_quoted_as_shown(spark):
    for raw in ("Blocked", "a\\b", "it's", "it's \"so\"", 'say "x"', "\\'"):
        assert one(spark, rules.quoted(F.lit(raw))) == repr(raw)


# ------------------------------------------------------------------- spans


@pytest.mark.parametrize("buckets", [2, 1024])
def test_percentiles_by_index(spark, buckets):
    rng = random.Random(buckets)
    rows = [(k, v) for k in ("a", None, "c") for v in [rng.choice([0.0, 1.0, 1.5, rng.random() * 10 ** rng.randrange(6), -3.0]) for _ in range(97)]] + [("one", 4.0), ("same", 2.0), ("same", 2.0), ("none", None)]
    got = {r.k: r for r in trace.index_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", buckets=buckets).collect()}
    for k in ("a", None, "c", "one", "same"):
        own = sorted(v for key, v in rows if key == k)
        at = lambda p, own=own: own[min(int(len(own) * p), len(own) - 1)]
        assert (got[k].n, got[k].p50, got[k].p95, got[k].max) == (len(own), at(0.5), at(0.95), own[-1])
    assert "none" not in got
    whole = trace.index_percentiles(spark.createDataFrame(rows, "k string, v double"), [], "v").first()
    assert whole.n == sum(v is not None for _, v in rows)


def test_export_of_spans(spark):
    rows = [("t", "1", None, "n", "llm", "2001-01-01 00:00:00", "2001-01-01 00:00:01.005", 10, 5, "claude-opus-1", ""), ("t", "2", "1", "m", "tool", "2001-01-01 00:00:00", None, None, None, None, "failed")]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, name string, kind string, s string, e string, input_tokens long, output_tokens long, model string, error string")
    df = df.withColumns({"started_at": F.to_timestamp("s"), "ended_at": F.to_timestamp("e")}).drop("s", "e")
    got = {r.span_id: json.loads(r.json) for r in trace.export_json(df).collect()}
    assert got["1"] == {"trace_id": "t", "span_id": "1", "name": "n", "kind": "llm", "duration_ms": 1005.0, "self_ms": 1005.0, "input_tokens": 10, "output_tokens": 5, "cost_usd": 0.000525, "model": "claude-opus-1", "error": ""}
    assert got["2"]["duration_ms"] == 0.0 and got["2"]["error"] == "failed" and "model" not in got["2"]


# --------------------------------------------------------------------- plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cosine_topk", "bm25_topk", "rrf_hybrid"])
def test_top_rows_are_kept_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(catalogue.queries()[name](spark, SMALL))


def test_source_filters_reach_the_scan(spark):
    p = catalogue.queries()["source_pushdown"](spark, SMALL)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(o_orderpriority,1-URGENT)" in p and "Not(EqualTo(o_orderstatus,F))" in p


def test_floors_are_inclusive(spark):
    s = spark.createDataFrame([(1, k, v) for k, v in enumerate([0.0, 0.5, 0.7])], "query_id int, ord int, score double")
    assert [(r.ord, r.rank) for r in retrieval.ranked(s, 5, floor=0.5).orderBy("rank").collect()] == [(2, 0), (1, 1)]


# ---------------------------------------------------------------------- logs


def test_ranks(spark):
    keys = random.Random(2).sample(range(-500, 500), 200)
    got = {r.k: r.n for r in ranks.numbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k", "n", width=7).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys), 1)}


def test_decisions_stand_once(spark):
    state = spark.createDataFrame([("p1", "submitted"), ("p2", "approved"), ("p3", "submitted")], "proposal_id string, act string").withColumns({"issue_key": F.lit("K"), "action_type": F.lit("a")})
    d = spark.createDataFrame([("p1", 1, "approved", " "), ("p1", 2, "rejected", "x"), ("p1", 3, "approved", "x"), ("p2", 4, "rejected", "x"), ("p9", 5, "rejected", "x"), ("p3", 6, "approved", "y")], "proposal_id string, seq long, act string, actor string")
    events, conflicts = gates.decided(d, state)
    assert sorted(r.seq for r in events.collect()) == [2, 6]
    assert sorted((r.seq, r.conflict) for r in conflicts.collect()) == [(1, "no named actor"), (3, "already decided"), (4, "not pending"), (5, "not pending")]


def test_loads_and_snapshots(spark):
    spaces = spark.createDataFrame([("A",), ("B",)], "space_key string")
    none = spaces.where("false")
    assert gates.docs_load(spaces, spaces, none).first().state == "complete"
    assert gates.docs_load(spaces, spaces, spaces.limit(1)).first().state == "partial"
    assert gates.docs_load(spaces, none, none).first().state == "unavailable"
    runs = spark.createDataFrame([(1, 10), (2, 20)], "run_id int, finished_at int")
    assert gates.latest_complete(runs, runs.where("run_id = 2")).first() == Row(run_id=1, finished_at=10)
    assert gates.latest_complete(runs, runs).count() == 0


def test_wording(spark):
    assert one(spark, wording.age(F.lit(3599))) == "1 hr ago" and one(spark, wording.age(F.lit(89))) == "just now"
    asked = spark.createDataFrame([("K-1", "issue"), ("K-2", "issue")], "scope string, kind string").withColumn("at", F.lit(None).cast("timestamp"))
    said = wording.answers_about(asked, None, None, complete=False, message="A reason.").collect()
    assert all(r.is_error and "A reason." in r.content for r in said)
    assert one(spark, wording.rich_document(F.lit(None).cast("string"))) == '{"type":"doc","version":1,"content":[]}'
    assert one(spark, rollup.leaked(F.lit("Signed OFF"), F.array(F.lit("signed off"), F.lit("x")))) == ["signed off"]
