"""Numbering, running sums and unions of intervals by ranges, against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ranks, trace
from ledgerloom.plans import gates
from ledgerloom.schemas import SPAN


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small ranges are not put together, so that these small tables have several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind,keys", [("long", [k * 10**12 for k in range(300)]), ("long", [None, *range(-40, 40), None, 7, 7, 7]), ("string", ["b", "", None, "a", "ab", "b"]), ("double", [5.0] * 500), ("long", [])], ids=["sparse", "nulls", "strings", "equal", "empty"])
def test_numbered(spark, kind, keys):
    df = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], f"k {kind}, n int").repartition(5)
    got = sorted(ranks.numbered(df, "k", "rank").collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(keys) + 1)) and sorted(r.n for r in got) == list(range(len(keys)))
    assert [r.k for r in got] == sorted((k for k in keys if k is not None)) + [None] * sum(k is None for k in keys)


def test_numbering_spreads_one_key_over_ranges(spark):
    rows = ranks.ranged(spark.range(20_000).select(F.lit(1).alias("k")).repartition(6), ["k"])
    sizes = [r.n for r in rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 15_000
    plan = plan_of(ranks.numbered(spark.range(100), "id", "rank"))
    assert "row_number" not in plan


def test_submitted_keeps_proposals_without_a_place(spark):
    rows = [(1, ["c"]), (None, ["c"]), (3, ["c"]), (2, [])]
    events, refused = gates.submitted(spark.createDataFrame(rows, "place long, citations array<string>"), "place")
    assert [(r.place, r.proposal_id) for r in events.orderBy("seq").collect()] == [(1, "prop_0001"), (3, "prop_0002"), (None, "prop_0003")]
    assert refused.count() == 1


def test_a_result_belongs_to_the_first_row_of_its_proposal(spark):
    audit = spark.createDataFrame([("p", 1, "approved"), ("p", 2, "rejected"), ("q", 5, "approved")], "proposal_id string, seq long, act string")
    results = spark.createDataFrame([("p", "", True)], "proposal_id string, error string, written boolean")
    got = {(r.proposal_id, r.seq): (r.applied, r.written) for r in gates.applied(audit, results).collect()}
    assert got == {("p", 1): (True, True), ("p", 2): (False, False), ("q", 5): (False, False)}
    failed = spark.createDataFrame([("p", "refused", True)], "proposal_id string, error string, written boolean")
    assert [(r.seq, r.applied, r.written, r.apply_error) for r in gates.applied(audit, failed).orderBy("proposal_id", "seq").collect()][:2] == [(1, False, False, "refused"), (2, False, False, None)]


def spans_of(spark, rows):
    """(trace, kind, start ms, end ms or None, tokens) to spans."""
    df = spark.createDataFrame([(str(n), *r) for n, r in enumerate(rows)], "span_id string, trace_id string, kind string, s long, e long, input_tokens long")
    moment = lambda c: F.timestamp_micros(F.col(c) * 1_000)
    have = df.withColumns({"started_at": moment("s"), "ended_at": moment("e"), "output_tokens": F.lit(None).cast("long")})
    missing = [f for f in spark.createDataFrame([], SPAN).schema if f.name not in have.columns]
    return have.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).drop("s", "e")


def union(intervals):
    total, until = 0, None
    for s, e in sorted(intervals):
        if until is None or s > until:
            total, until = total + e - s, e
        elif e > until:
            total, until = total + e - until, e
    return total


@pytest.mark.parametrize("seed", range(3))
def test_occupancy_of_a_trace_with_most_spans(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(2_000):
        t = "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])
        s = rng.randrange(200_000)
        rows.append((t, rng.choice(["llm", "tool"]), s, None if rng.random() < 0.05 else s + rng.choice([0, 1, 40, 300, 60_000 if rng.random() < 0.01 else 5]), 1))
    want = defaultdict(list)
    for t, kind, s, e, _ in rows:
        want[t, kind].append((s, s if e is None else e))
    df = spans_of(spark, rows).repartition(4)
    got = {(r.trace_id, r.kind): round(r.occupancy_ms) for r in trace.occupancy(df, ["trace_id", "kind"]).collect()}
    assert got == {k: union(v) for k, v in want.items()}
    parts = ranks.ranged(df, ["trace_id", "started_at"]).where("trace_id = 'hot'").select("__range").distinct().count()
    assert parts > 1, "the large trace is spread over ranges"


def test_running_tokens_of_a_large_trace(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.9 else "b", "llm", rng.randrange(5_000), None, rng.choice([None, 1, 20])) for _ in range(1_500)]
    got = {r.span_id: r.tokens for r in trace.running_tokens(spans_of(spark, rows).repartition(4)).collect()}
    sums, want = defaultdict(int), {}
    for n, (t, _, _, _, used) in sorted(enumerate(rows), key=lambda x: (x[1][2], x[0])):
        sums[t] += used or 0
        want[str(n)] = sums[t]
    assert got == want


def test_price_card(spark):
    df = spans_of(spark, [("t", "llm", 0, 10, 1_000_000)]).withColumn("model", F.explode(F.array(*[F.lit(m) for m in ("claude-opus-9", "claude-haiku-1", "unknown")], F.lit(None))))
    assert [r.cost_usd for r in trace.with_durations(df).orderBy(F.col("model").asc_nulls_last()).collect()] == [0.8, 15.0, 3.0, 3.0]
    own = trace.with_durations(df, (("un", 7.0, 0.0), ("", 1.0, 0.0)))
    assert [r.cost_usd for r in own.orderBy(F.col("model").asc_nulls_last()).collect()] == [1.0, 1.0, 7.0, 1.0]


def test_percentiles_read_their_input_once(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1_000).cast("double").alias("v"))
    got = {r.k: (r.n, r.p50, r.p95, r.max) for r in trace.index_percentiles(df, ["k"], "v").collect()}
    for k in range(3):
        v = sorted(float(i * 7 % 1_000) for i in range(10_000) if i % 3 == k)
        assert got[k] == (len(v), v[int(len(v) * 0.5)], v[int(len(v) * 0.95)], v[-1])
