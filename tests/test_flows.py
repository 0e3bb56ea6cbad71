"""Streams that fail and are run again, snapshots that stay, traces in parts."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom import catalogue_flows
from ledgerloom.operators import rules, trace
from ledgerloom.plans import gates, snapshots
from ledgerloom.plans.snapshots import NotPublished, Snapshots
from ledgerloom.streaming import findings as stream

from test_operators import clock, issue
from test_ranges import spans_of


def rows_of(spark, *keys, error=None):
    out = None
    for k in keys:
        one = issue(spark, key=f"'{k}'" if k else "null", target_release="null").withColumn("error", F.lit(error).cast("string"))
        out = one if out is None else out.union(one)
    return out


def read(recorder):
    return {t: sorted(map(str, recorder.table(t).collect())) for t in stream.TABLES}


def test_a_batch_run_again_adds_nothing(spark, tmp_path):
    recorder = stream.Recorder(spark, f"file://{tmp_path}/out", clock())
    rows = rows_of(spark, "A-1", "A-2", None).union(rows_of(spark, "A-3", error="timed out"))
    recorder.record(rows, 0)
    recorder.record(rows_of(spark, "A-4"), 1)
    before = read(recorder)
    recorder.record(rows, 0)
    recorder.record(rows_of(spark, "A-4"), 1)
    assert read(recorder) == before
    assert [(r.batch, r.seen, r.gaps, r.whole) for r in recorder.table("log").orderBy("batch").collect()] == [(0, 3, 2, True), (1, 1, 0, True)]
    assert sorted((r.reason, r.scope, r.detail) for r in recorder.table("gaps").collect()) == [("timeout", "A", "timed out"), ("unmappable_issue", "A", "an issue without a key")]
    assert {r.issue_key for r in recorder.table("findings").collect()} == {"A-1", "A-2", "A-4"}


def test_counts_equal_the_tables(spark, tmp_path):
    rows_of(spark, *[f"A-{k}" for k in range(5)], None).repartition(3).write.parquet(f"{tmp_path}/in")
    run = stream.record_findings(spark, f"{tmp_path}/in", f"file://{tmp_path}/out", f"{tmp_path}/check", clock(), files=1)
    recorder = stream.Recorder(spark, f"file://{tmp_path}/out", clock())
    log = recorder.table("log").agg(F.sum("seen").alias("seen"), F.sum("gaps").alias("gaps"), F.count(F.lit(1)).alias("n")).first()
    assert isinstance(run, gates.PartialRun) and run.issues_seen == log.seen == 6 and log.gaps == recorder.table("gaps").count() == 1 and log.n == 3
    with pytest.raises(gates.Incomplete):
        gates.build_report(run)


def test_a_failure_ends_the_stream_as_a_gap_and_a_later_run_replaces_it(spark, tmp_path):
    rows_of(spark, "A-1").coalesce(1).write.parquet(f"{tmp_path}/in")
    at = (f"{tmp_path}/in", f"file://{tmp_path}/out", f"{tmp_path}/check", clock())

    def broken(cfg, now):
        return F.when(F.raise_error(F.lit("429 rate limit")).isNull(), rules.ALL_RULES[0](cfg, now))

    run = stream.record_findings(spark, *at, rules=(broken,))
    assert isinstance(run, gates.PartialRun) and run.issues_seen == 0
    gap = run.gaps.first()
    assert (gap.reason, gap.scope) == ("rate_limited", "sync")
    again = stream.record_findings(spark, *at)
    assert isinstance(again, gates.CompleteRun) and again.issues_seen == 1
    assert again.findings.count() == rules.evaluate(rows_of(spark, "A-1").drop("error"), now=clock()).count() > 0
    assert gates.build_report(again)["rules"].count() > 0


def test_what_an_unfinished_batch_wrote_is_not_seen(spark, tmp_path):
    recorder = stream.Recorder(spark, f"file://{tmp_path}/out", clock())
    assert recorder.table("findings").collect() == [] and stream.outcome(recorder).issues_seen == 0
    recorder.record(rows_of(spark, "A-1"), 0)
    rules.evaluate(rows_of(spark, "A-9").drop("error"), now=clock()).write.parquet(f"{tmp_path}/out/findings/batch=7")
    assert {r.issue_key for r in recorder.table("findings").collect()} == {"A-1"}


@pytest.mark.parametrize("query", ["stream_findings", "stream_gaps", "stream_log"])
def test_a_query_raises_the_failure_of_its_stream(spark, monkeypatch, query):
    batches = []

    def third_fails(issues, *args, **more):
        batches.append(1)
        found = rules.evaluate(issues, *args, **more)
        return found.where(F.raise_error(F.lit("a disk is lost")).isNull()) if len(batches) == 3 else found

    monkeypatch.setattr(stream, "evaluate", third_fails)
    with pytest.raises(Exception, match="a disk is lost"):
        getattr(catalogue_flows, query)(spark, "/root/testdata/sf0.001").collect()
    assert len(batches) == 3


def test_a_query_raises_where_its_stream_was_stopped(spark, monkeypatch):
    record = stream.Recorder.record

    def stopped(recorder, rows, batch):
        record(recorder, rows, batch)
        if batch == 1:
            running = spark.streams.active
            for q in running:
                threading.Thread(target=q.stop).start()
            while any(q.isActive for q in running):
                time.sleep(0.05)

    monkeypatch.setattr(stream.Recorder, "record", stopped)
    with pytest.raises(RuntimeError, match="stopped before its last batch"):
        catalogue_flows.stream_findings(spark, "/root/testdata/sf0.001")


def test_a_failure_without_a_gap_is_raised_and_a_later_run_is_whole(spark, tmp_path, monkeypatch):
    rows_of(spark, "A-1", "A-2", "A-3").repartition(3).write.parquet(f"{tmp_path}/in")
    files = len(spark.read.parquet(f"{tmp_path}/in").inputFiles())
    assert files > 1
    at = (f"{tmp_path}/in", f"file://{tmp_path}/out", f"{tmp_path}/check", clock())
    put = stream.Recorder._put

    def full(recorder, df, table, batch):
        if batch == files - 1:
            raise OSError("no space left")
        put(recorder, df, table, batch)

    with monkeypatch.context() as m:
        m.setattr(stream.Recorder, "_put", full)
        with pytest.raises(Exception, match="no space left"):
            stream.record_findings(spark, *at, files=1)
    again = stream.record_findings(spark, *at, files=1)
    assert isinstance(again, gates.CompleteRun) and again.issues_seen == 3 and {r.issue_key for r in again.findings.collect()} == {"A-1", "A-2", "A-3"}


def test_a_log_that_cannot_be_written_is_a_gap(spark, tmp_path, monkeypatch):
    rows_of(spark, "A-1").coalesce(1).write.parquet(f"{tmp_path}/in")
    put, tried = stream.Recorder._put, []

    def once(recorder, df, table, batch):
        if table == "log" and not tried:
            tried.append(batch)
            raise OSError("429 of the store")
        put(recorder, df, table, batch)

    monkeypatch.setattr(stream.Recorder, "_put", once)
    run = stream.record_findings(spark, f"{tmp_path}/in", f"file://{tmp_path}/out", f"{tmp_path}/check", clock())
    assert tried == [0] and isinstance(run, gates.PartialRun) and [(g.reason, g.scope) for g in run.gaps.collect()] == [("rate_limited", "sync")]


def test_a_batch_that_breaks_when_run_again_is_not_whole(spark, tmp_path, monkeypatch):
    recorder = stream.Recorder(spark, f"file://{tmp_path}/out", clock())
    recorder.record(rows_of(spark, "A-1"), 0)
    recorder.record(rows_of(spark, "A-2"), 1)
    put = stream.Recorder._put

    def lost(recorder, df, table, batch):
        if table != "findings":
            raise OSError("the driver is lost")
        put(recorder, df.limit(0), table, batch)

    monkeypatch.setattr(stream.Recorder, "_put", lost)
    with pytest.raises(OSError):
        recorder.record(rows_of(spark, "A-2"), 1)
    assert [r.batch for r in recorder.table("log").collect()] == [0]
    assert {r.issue_key for r in recorder.table("findings").collect()} == {"A-1"}


# ----------------------------------------------------------------- snapshots


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_failing_refresh_leaves_the_old_rows(spark, tmp_path):
    kept = Snapshots(spark, f"file://{tmp_path}/s")
    assert kept.current() is None
    with pytest.raises(NotPublished):
        kept.rows()
    assert kept.publish(spark.range(3), "t1", source="first") == 1
    with pytest.raises(NotPublished):
        kept.publish(spark.range(9), "t2", gaps=spark.range(1))
    with pytest.raises(Exception, match="broken"):
        kept.publish(spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id")), "t3")
    assert ids(kept.rows()) == [0, 1, 2] and kept.current().items() >= {"run": 1, "published_at": "t1", "source": "first"}.items()
    assert kept.publish(spark.range(5), "t4") == 2 and ids(kept.rows()) == [0, 1, 2, 3, 4] and ids(kept.rows(1)) == [0, 1, 2]
    kept.drop_before(2)
    assert ids(kept.rows()) == [0, 1, 2, 3, 4]
    with pytest.raises(NotPublished):
        kept.rows(1)


def test_two_refreshes_cannot_both_be_next(spark, tmp_path, monkeypatch):
    one, two = Snapshots(spark, f"file://{tmp_path}/s"), Snapshots(spark, f"file://{tmp_path}/s")
    monkeypatch.setattr(two, "_pointers", lambda: [])  # it looked before the other one published
    one.publish(spark.range(4), "t1")
    with pytest.raises(NotPublished, match="another refresh"):
        two.publish(spark.range(1), "t2")
    assert ids(one.rows()) == [0, 1, 2, 3], "the slower one's rows are not read"
    assert one.current()["published_at"] == "t1" and snapshots.Snapshots(spark, f"file://{tmp_path}/s").current() == one.current()


# -------------------------------------------------------------------- traces


def test_objects_of_traces(spark):
    rows = [("t", "llm", 0, 1_005, 10), ("t", "tool", 5, None, None), ("u", "llm", 0, 1, 1)] + [("large", "llm", k, k + 1, 1) for k in range(25)]
    df = spans_of(spark, rows).withColumns({"parent_id": F.when(F.col("span_id") == "1", "0"), "model": F.lit("claude-opus-1"), "error": F.when(F.col("span_id") == "1", "failed")})
    out = trace.export_objects(df, most=10).collect()
    assert sorted((r.trace_id, r.part, r.parts) for r in out) == [("large", 0, 3), ("large", 1, 3), ("large", 2, 3), ("t", 0, 1), ("u", 0, 1)]
    t = json.loads(next(r.json for r in out if r.trace_id == "t"))
    assert (t["wall_ms"], t["cost_usd"], t["input_tokens"], t["output_tokens"]) == (1005.0, 0.00015, 10, 0)
    assert [(s["span_id"], s["duration_ms"], s["self_ms"], s["error"]) for s in t["spans"]] == [("0", 1005.0, 1005.0, ""), ("1", 0.0, 0.0, "failed")]
    large = [json.loads(r.json) for r in sorted((r for r in out if r.trace_id == "large"), key=lambda r: r.part)]
    assert [len(x["spans"]) for x in large] == [10, 10, 5] and {x["input_tokens"] for x in large} == {25}
    assert [s["span_id"] for x in large for s in x["spans"]] == [str(k) for k in range(3, 28)]


def test_the_collectors_form(spark):
    df = spans_of(spark, [("t", "llm", 2, 5, 10), ("t", "tool", 7, None, None)]).withColumn("error", F.when(F.col("span_id") == "1", "failed"))
    one, two = (json.loads(r.json) for r in trace.export_collector(df).orderBy("span_id").collect())
    assert one["attributes"] == {"gen_ai.operation.name": "llm", "gen_ai.usage.input_tokens": 10, "gen_ai.usage.output_tokens": 0} and one["status"] == {"code": 1, "message": ""}
    assert (one["startTimeUnixNano"], one["endTimeUnixNano"]) == (2_000_000, 5_000_000)
    assert two["startTimeUnixNano"] == two["endTimeUnixNano"] == 7_000_000 and two["status"] == {"code": 2, "message": "failed"}


def test_kinds_in_order_of_the_clock(spark):
    df = spans_of(spark, [("t", "judge", 0, 30, 1), ("t", "judge", 10, 40, 1), ("t", "llm", 0, 100, 1), ("t", "tool", 5, 5, 1)])
    got = [(r.kind, r.position, r.share) for r in trace.summary(df).orderBy("position").collect()]
    assert got == [("llm", 1, 100.0), ("judge", 2, 40.0), ("tool", 3, 0.0)]


def test_files_of_the_stream_grow_with_the_issues(spark, monkeypatch):
    monkeypatch.setattr(catalogue_flows, "ISSUES_A_FILE", 100)
    recorder = catalogue_flows._streamed(spark, "/root/testdata/sf0.001")
    n, files = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count(), len(spark.read.parquet(recorder.path.removesuffix("/out") + "/in").inputFiles())
    assert n / 100 <= files <= n / 100 + 3 and recorder.table("log").count() == 3
