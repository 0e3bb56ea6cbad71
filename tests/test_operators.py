"""Boundaries of rules, text functions, grounding, chunking, ingest and gates on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import chunking, evaluation, grounding, report, retrieval, rules, trace
from ledgerloom.plans import gates
from ledgerloom.schemas import ISSUE, LINK, SPAN
from ledgerloom.sources import ingest


def clock():
    return F.lit("2026-09-15 00:00:00").cast("timestamp")


def issue(spark, **values):
    row = {"key": "'A-1'", "project_key": "'A'", "summary": "'s'", "status_name": "'In Progress'", "status_category": "'in_progress'", "created_at": "timestamp '2026-07-17 00:00:00'", "target_release": "'Q4'", "comments": "array()", "changelog": "array()", "links": "array()"} | values
    fields = ISSUE.split(", ")
    names = [f.name for f in spark.createDataFrame([], ISSUE).schema]
    kinds = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], ISSUE).schema}
    assert fields
    return spark.range(1).select(*[F.expr(f"cast({row.get(n, 'null')} as {kinds[n]})").alias(n) for n in names])


def found(df):
    return {(r.rule_id, r.level): r.detail for r in rules.evaluate(df, now=clock()).collect()}


@pytest.mark.parametrize("days,level", [(6, None), (7, "medium"), (13, "medium"), (14, "high")])
def test_stale_boundaries(spark, days, level):
    got = found(issue(spark, changelog=f"array(named_struct('field','status','from_value','a','to_value','b','at',timestamp '2026-09-15 00:00:00' - interval {days} days,'author_id','u'))"))
    assert set(got) == ({("stale_in_progress", level)} if level else set())


def test_due_day_and_release(spark):
    fresh = {"created_at": "timestamp '2026-09-14 00:00:00'"}
    assert ("overdue", "high") not in found(issue(spark, due_date="timestamp '2026-09-15 00:00:00'", **fresh))
    assert "by 0 days" in found(issue(spark, due_date="timestamp '2026-09-14 23:59:59'", **fresh))["overdue", "high"]
    assert ("missing_target_release", "medium") in found(issue(spark, target_release="''", **fresh))
    assert not found(issue(spark, status_category="'done'", target_release="null", due_date="timestamp '2020-01-01 00:00:00'"))


def links(*rows):
    return "array(" + ",".join(f"named_struct('target_key','{k}','target_summary',null,'target_status_category',{c},'link_type','{t}','target_blocks_this',{b})" for k, c, t, b in rows) + ")"


def test_blocked(spark):
    fresh = {"created_at": "timestamp '2026-09-14 00:00:00'"}
    many = links(*[(f"B-{k:02}", "null" if k else "'todo'", "blocks", "true") for k in range(12)], ("C-1", "'todo'", "depends_on", "false"))
    detail = found(issue(spark, links=many, **fresh))["blocked_dependency", "high"]
    assert detail.startswith("Blocked by 12") and detail.endswith(", +7 more.") and "B-00 (todo), B-01 (status unknown)" in detail
    blocked = {"status_name": "' ON  hold '"} | fresh
    assert ("blocked_status", "medium") in found(issue(spark, **blocked))
    assert ("blocked_status", "medium") not in found(issue(spark, links=links(("B-1", "'todo'", "blocks", "true")), **blocked))
    assert ("blocked_status", "medium") in found(issue(spark, links=links(("B-1", "'done'", "blocks", "true")), **blocked))
    assert ("blocked_dependency", "medium") in found(issue(spark, links=links(("B-1", "'todo'", "depends_on", "false")), **fresh))


def test_every_finding_is_cited(spark):
    rows = rules.evaluate(issue(spark, target_release="null", links=links(("B-1", "null", "blocks", "true"))), now=clock())
    assert rows.where(F.size("citations") == 0).count() == 0
    assert report.worst(rows).first().level == "high"


def col(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_text(spark):
    assert col(spark, T.tokens, "The INS-101 gateway. of v1.2.3") == ["ins-101", "gateway.", "v1.2.3"]
    assert col(spark, T.citations, "a [1] b [12] [x]") == [1, 12]
    quote = lambda q, s: spark.createDataFrame([(q, s)], "q string, s string").select(T.quote_present(F.col("q"), F.col("s")).alias("y")).first().y
    assert quote("first part... second", "The FIRST  part | and\nsecond.") and not quote("second ... first", "first second") and not quote("...", "x")
    assert col(spark, T.write_intent, "Can you flag A-1?") and not col(spark, T.write_intent, "Why was it flagged?") and not col(spark, T.write_intent, "")
    assert col(spark, T.declines, "There is no evidence of that.") and not col(spark, T.declines, "There is no doubt that it shipped.")
    assert col(spark, lambda x: T.lenient_json(x).cast("string"), 'Sure: ```json\n{"a": 1}\n```') == '{"a":1}'
    assert col(spark, lambda x: T.lenient_json(x).cast("string"), "[1]") is None
    assert col(spark, lambda x: retrieval.subqueries(x), "Who owns Acme Corp and what are the open risks?") == ["Who owns Acme Corp", "what are the open risks Acme Corp"]


def test_grounding(spark):
    texts = ["All is well here and nothing at all is wrong today.", "Short lead in.\n\nThe vendor signed on Monday. [1]", "The vendor signed on Monday. [9]", "# Heading\n\n| a | b |", "Here are the open items that remain today:"]
    a = spark.createDataFrame([(str(k), t, 2) for k, t in enumerate(texts)], "answer_id string, text string, passages int")
    assert [r.grounded for r in grounding.check(a).orderBy("answer_id").collect()] == [False, True, False, True, True]
    c = grounding.claims(a).collect()
    assert [(x.claim, x.indices) for x in c if x.answer_id == "1"] == [("The vendor signed on Monday.", [1])]  # its own paragraph's citation
    strict = grounding.check(a.where("answer_id = '1'"), per_sentence=True).first()
    assert strict.grounded


def test_judging(spark):
    rows = [("1", '{"verdict": "supported", "evidence": "on monday"}', "signed on Monday", True), ("2", '{"verdict": "supported", "evidence": "friday"}', "signed on Monday", True), ("3", "nonsense", "x", True), ("4", "{}", "x", False)]
    got = grounding.judged(spark.createDataFrame(rows, "claim_id string, reply string, source string, in_range boolean")).orderBy("claim_id").collect()
    assert [r.verdict for r in got] == ["supported", "unjudged", "unjudged", "unsupported"]
    b = grounding.blocker_class(spark.createDataFrame([("k", '{"category":"vendor","evidence":"late"}', "is late"), ("l", '{"category":"x","evidence":"late"}', "is late")], "issue_key string, reply string, source string"), ("vendor",))
    assert [r.category for r in b.orderBy("issue_key").collect()] == ["vendor", "unknown"]


def test_thresholds(spark):
    t = evaluation.default_thresholds(spark)
    seen = spark.createDataFrame([("groundedness_supported", 0.81, 1), ("recall_at_5", 0.6, 1), ("cost_per_answer", 0.001, 1), ("what", 1.0, 1)], "key string, value double, runs int")
    got = {r.key: r.status for r in evaluation.check(seen, t).collect()}
    assert got == {"groundedness_supported": "pass", "recall_at_5": "regressed", "cost_per_answer": "improved", "what": "skipped"}


def test_occupancy_touching_and_open(spark):
    at = lambda s: f"timestamp '2026-01-01 00:00:{s:02}'"
    rows = " union all ".join(f"select 't', '{k}', null, 'n', 'llm', {at(a)}, {'null' if b is None else at(b)}, 1L, 1L, null, ''" for k, (a, b) in enumerate([(0, 2), (2, 4), (3, 5), (8, None)]))
    spans = spark.sql(rows).toDF(*[x.split()[0] for x in SPAN.split(", ")])
    assert trace.occupancy(spans, ["trace_id"]).first().occupancy_ms == 5000.0
    assert trace.by_kind(spans).first().total_ms == 6000.0


def test_chunks_keep_sentences():
    text = " ".join(f"Sentence number {k} is here." for k in range(100))
    parts = chunking.split_oversized(text, 200)
    assert all(p.endswith(".") and len(p) <= 200 for p in parts) and " ".join(" ".join(parts).split()) == text
    rows = [{"heading": "A", "level": 1, "text": "tiny"}, {"heading": "B", "level": 2, "text": "x" * 300}, {"heading": "C", "level": 1, "text": "last"}]
    got = list(chunking.chunks_of(rows))
    assert got == [(["A"], "tiny\n\n" + "x" * 300, "B"), (["C"], "last", None)]


def test_ingest(spark):
    payload = {"key": "K-1", "fields": {"summary": "s", "project": {"key": "P"}, "status": {"name": "Doing", "statusCategory": {"key": "indeterminate"}}, "created": "2026-07-01T09:00:00.000+0000", "duedate": "2026-07-05", "cf": [{"value": " Q4 "}], "issuelinks": [{"type": {"name": "Blocks", "inward": "is blocked by", "outward": "blocks"}, "inwardIssue": {"key": "K-2"}}, {"type": {"name": "Relates"}}]}, "changelog": {"histories": [{"created": "2026-07-02T00:00:00.000+0000", "items": [{"field": "Sprint", "toString": "S1"}, {"field": "x"}]}]}}
    raw = spark.createDataFrame([(json.dumps(payload),), ("{}",), ("not json",)], "payload string")
    issues, gaps = ingest.map_issues(raw, "cf")
    r = issues.first()
    assert (r.key, r.status_category, r.target_release, r.sprint_name, len(r.changelog)) == ("K-1", "in_progress", "Q4", "S1", 2)
    assert r.links[0].target_blocks_this and r.links[0].link_type == "blocks" and len(r.links) == 1 and str(r.due_date) == "2026-07-05 23:59:59"
    assert gaps.count() == 2
    assert ingest.rich_text({"type": "doc", "content": [{"type": "text", "text": "a"}, {"content": [{"type": "text", "text": "b"}]}]}) == "a b"
    s = ingest.sections_of('<p>intro</p><h2>T</h2><ac:structured-macro ac:name="toc"><p>no</p></ac:structured-macro><ac:structured-macro ac:name="info"><p>yes</p></ac:structured-macro><table><tr><td>a</td><td>b</td></tr></table>')
    assert s[0]["text"] == "intro" and s[1]["heading"] == "T" and "yes" in s[1]["text"] and "no" not in s[1]["text"] and "| a | b" in s[1]["text"]


def test_gates(spark):
    none, some = spark.createDataFrame([], "reason string"), spark.createDataFrame([("timeout",)], "reason string")
    findings = spark.createDataFrame([("A", 0, "r", "high")], "issue_key string, rule_ordinal int, rule_id string, level string")
    assert gates.build_report(gates.seal(findings, none, 1))["rules"].count() == 1
    with pytest.raises(gates.Incomplete):
        gates.build_report(gates.seal(findings, some, 1))
    with pytest.raises(TypeError):
        gates.CompleteRun(findings, 1)
    with pytest.raises(ValueError):
        gates.submit({})
    pending = gates.submit({"proposal_id": "p", "citations": [1]})
    with pytest.raises(ValueError):
        gates.decide(pending, " ", "approved")
    with pytest.raises(KeyError):
        gates.decide(None, "me", "approved")


def test_stream_equals_batch(spark, tmp_path):
    from ledgerloom.streaming.findings import stream_findings

    df = issue(spark, target_release="null")
    df.write.parquet(str(tmp_path / "in"))
    stream_findings(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), clock())
    assert spark.read.parquet(str(tmp_path / "out")).count() == rules.evaluate(df, now=clock()).count() > 0
    assert LINK


def test_vector_search_goes_on_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 7)
    vectors = spark.range(12).selectExpr("id AS ord", "array(1.0D, cast(id AS double)) AS vector")
    rows = retrieval.vector_scores(vectors, vectors.withColumnRenamed("ord", "query_id")).collect()
    assert sorted((r.query_id, r.ord) for r in rows) == [(q, o) for q in range(12) for o in range(12)]
    assert all(r.score == pytest.approx((1 + r.query_id * r.ord) / ((1 + r.query_id**2) * (1 + r.ord**2)) ** 0.5) for r in rows)
