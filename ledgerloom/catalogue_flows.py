"""Queries of streams, snapshots, trace objects, embedding batches, models, tools and Markdown, each with its oracle in DuckDB SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import steps
from .catalogue import CHUNKS, FINDINGS, SPANS, _findings, _spans, _tok
from .functions import markdown
from .functions import text as T
from .operators import embedding, models, rules, tools, trace
from .plans import snapshots, views
from .registry import query as _query
from .streaming import findings as stream

# ------------------------------------------------------------------- streams


#: About as many issues are written by a task, however many there are.
ISSUES_A_FILE = 100_000


def _streamed(spark, sf_dir):
    """All issues as files of a stream, read a third of the files a batch: every 13th has no time of creation, every 17th is a failure of its project.

    A stream that fails or is stopped is an error: the tables of the batches before it are no result.
    """
    n = F.substring("key", 5, 20).cast("long")
    rows = views.issues(spark, sf_dir)
    rows = rows.withColumns({"created_at": F.when(n % 13 != 0, F.col("created_at")), "error": F.when(n % 17 == 0, F.concat(F.lit("HTTP 429 for "), "project_key"))})
    at = steps.new_path(spark, "issue-stream")
    files = 3 * max(2, -(-views.read(spark, sf_dir, "orders").count() // (3 * ISSUES_A_FILE)))
    rows.repartition(files, "key").write.parquet(f"{at}/in")
    there = len(spark.read.parquet(f"{at}/in").inputFiles())
    a_batch = -(-there // 3)
    stream.record_findings(spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint", views.now(), rules.RiskConfig(), files=a_batch, strict=True)
    recorder = stream.Recorder(spark, f"{at}/out", views.now())
    if recorder.table("log").count() < -(-there // a_batch):  # a row a batch
        raise RuntimeError("the stream was stopped before its last batch")
    return recorder


_STREAM = FINDINGS + ", z AS (SELECT *, substr(key, 5)::BIGINT AS nr FROM i), w AS (SELECT nr % 17 = 0 AS failed, nr % 13 = 0 AS unmapped, key, project_key FROM z)"


@_query(_STREAM + " SELECT issue_key, rule_id, level FROM (SELECT f.key AS issue_key, rule_id, level FROM f JOIN w ON w.key = f.key WHERE NOT failed AND NOT unmapped)")
def stream_findings(spark, sf_dir):
    """Findings of all batches, as a batch would find them."""
    return _streamed(spark, sf_dir).table("findings").select("issue_key", "rule_id", "level")


@_query(_STREAM + " SELECT CASE WHEN failed THEN 'rate_limited' ELSE 'unmappable_issue' END AS reason, project_key AS scope, count(*) AS gaps FROM w WHERE failed OR unmapped GROUP BY 1, 2")
def stream_gaps(spark, sf_dir):
    return _streamed(spark, sf_dir).table("gaps").groupBy("reason", "scope").agg(F.count(F.lit(1)).alias("gaps"))


@_query(_STREAM + " SELECT count(*) FILTER (WHERE NOT failed)::BIGINT AS seen, count(*) FILTER (WHERE failed OR unmapped)::BIGINT AS gaps, true AS whole, 3::BIGINT AS batches FROM w")
def stream_log(spark, sf_dir):
    """What was observed while the batches were written, and equals their rows."""
    return _streamed(spark, sf_dir).table("log").agg(F.sum("seen").alias("seen"), F.sum("gaps").alias("gaps"), F.bool_and("whole").alias("whole"), F.count(F.lit(1)).alias("batches"))


# ----------------------------------------------------------------- snapshots


@_query("SELECT o_orderkey, o_orderstatus, 2::BIGINT AS run FROM orders WHERE o_orderstatus <> 'P'")
def snapshot_publish(spark, sf_dir):
    """Orders as published twice; a third refresh has gaps, and the second stays."""
    o = views.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    kept = snapshots.Snapshots(spark, steps.new_path(spark, "snapshots"))
    kept.publish(o.where("o_orderstatus = 'F'"), "2001-12-01T10:00:00Z")
    kept.publish(o.where("o_orderstatus <> 'P'"), "2001-12-01T11:00:00Z")
    try:
        kept.publish(o, "2001-12-01T12:00:00Z", gaps=o.where("o_orderstatus = 'P'"))
    except snapshots.NotPublished:
        pass
    return kept.rows().select("o_orderkey", "o_orderstatus", F.lit(kept.current()["run"]).cast("long").alias("run"))


# -------------------------------------------------------------------- traces

_OBJ = "a AS (SELECT trace_id, sum(cost) AS cost, sum(tin)::BIGINT AS tin, sum(tout)::BIGINT AS tout, coalesce(max(ms) FILTER (WHERE parent_id IS NULL), 0) AS wall, count(*) AS n FROM t GROUP BY 1)"


@_query(SPANS + ", " + _OBJ + ", b AS (SELECT trace_id, (row_number() OVER (PARTITION BY trace_id ORDER BY s, event_id) - 1) // 20 AS part, event_id, ms, self FROM t) SELECT trace_id, part, (n - 1) // 20 + 1 AS parts, count(*) AS spans, string_agg(event_id, ',' ORDER BY event_id) AS ids, round(any_value(wall), 0) AS wall_ms, round(any_value(cost), 6) AS cost_usd, any_value(tin) AS input_tokens, round(sum(ms), 0) AS ms, round(sum(self), 0) AS self_ms FROM b JOIN a USING (trace_id) GROUP BY 1, 2, 3")
def trace_objects(spark, sf_dir):
    """Traces as objects of 20 spans at most, parsed again."""
    o = trace.export_objects(_spans(spark, sf_dir), most=20)
    shape = "wall_ms double, cost_usd double, input_tokens long, spans array<struct<span_id: string, duration_ms: double, self_ms: double>>"
    o = o.withColumn("o", F.from_json("json", shape))
    total = lambda c: F.round(F.aggregate(f"o.spans.{c}", F.lit(0.0), lambda a, x: a + x), 0)
    ids = F.array_join(F.array_sort(F.transform("o.spans.span_id", lambda x: x.cast("long"))).cast("array<string>"), ",")
    return o.select("trace_id", "part", "parts", F.size("o.spans").cast("long").alias("spans"), ids.alias("ids"), F.round("o.wall_ms", 0).alias("wall_ms"), F.round("o.cost_usd", 6).alias("cost_usd"), "o.input_tokens", total("duration_ms").alias("ms"), total("self_ms").alias("self_ms"))


@_query(SPANS + " SELECT span_id, parent_id, kind, epoch_us(s) * 1000 AS starts, epoch_us(coalesce(e, s)) * 1000 AS ends, tin + tout AS tokens, CASE WHEN error <> '' THEN 2 ELSE 1 END::INT AS code FROM d")
def trace_collector(spark, sf_dir):
    c = trace.export_collector(_spans(spark, sf_dir)).withColumn("v", F.parse_json("json"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    tokens = get('$.attributes["gen_ai.usage.input_tokens"]', "long") + get('$.attributes["gen_ai.usage.output_tokens"]', "long")
    return c.select(get("$.spanId", "string").alias("span_id"), get("$.parentSpanId", "string").alias("parent_id"), get('$.attributes["gen_ai.operation.name"]', "string").alias("kind"), get("$.startTimeUnixNano", "long").alias("starts"), get("$.endTimeUnixNano", "long").alias("ends"), tokens.alias("tokens"), get("$.status.code", "int").alias("code"))


@_query(SPANS + ", x AS (SELECT trace_id, coalesce(max(ms) FILTER (WHERE parent_id IS NULL), 0) AS wall FROM d GROUP BY 1) SELECT trace_id, kind, row_number() OVER (PARTITION BY trace_id ORDER BY occ DESC, kind)::INT AS position, round(CASE WHEN wall > 0 THEN occ / wall * 100 ELSE 0 END, 3) AS share FROM o JOIN x USING (trace_id)")
def trace_summary(spark, sf_dir):
    """Kinds by the clock they owned."""
    return trace.summary(_spans(spark, sf_dir)).select("trace_id", "kind", "position", F.round("share", 3).alias("share"))


# ------------------------------------------------- embedders, models and tools

_TOKEN = re.compile(T.TOKEN)


class WordCounts:
    """An embedder for queries: unit vectors of the vocabulary's counts."""

    def __init__(self, vocabulary, stopwords):
        self.place, self.stop = {w: k for k, w in enumerate(vocabulary)}, set(stopwords)

    def __call__(self, texts, kind):
        out = []
        for text in texts:
            counts = [0.0] * len(self.place)
            for token in _TOKEN.findall(text):
                at = self.place.get(token.lower())
                if at is not None and token.lower() not in self.stop:
                    counts[at] += 1
            norm = sum(c * c for c in counts) ** 0.5
            out.append([c / norm for c in counts] if norm else counts)
        return out


def _word_counts():
    return WordCounts(views.VOCABULARY, T.STOPWORDS)


@_query(CHUNKS + f", e AS (SELECT DISTINCT text FROM ch WHERE ord % 2 = 0), t AS (SELECT chunk_id, e.text IS NOT NULL AS cached, {_tok('ch.text')} AS t FROM ch LEFT JOIN e ON e.text = ch.text), v AS (SELECT chunk_id, cached, list_transform([{', '.join(repr(v) for v in views.VOCABULARY)}], lambda v: len(list_filter(t, lambda x: x = v))) AS c FROM t) SELECT chunk_id, cached, round(coalesce(c[1] / nullif(sqrt(list_sum(list_transform(c, lambda x: x * x))), 0), 0), 6) AS first FROM v")
def embedding_cache(spark, sf_dir):
    """Every second line fills the cache; all lines are then embedded, and only what is not there is asked for."""
    lines, at = views.chunks(spark, sf_dir), steps.new_path(spark, "vectors")
    embedding.embedded(lines.where("ord % 2 = 0"), at, _word_counts, "word-counts")
    had = steps.written(embedding.read_cache(spark, at).select("cache_key"), "cached")
    rows = embedding.embedded(lines, at, _word_counts, "word-counts").withColumn("cache_key", embedding.cache_key("word-counts", "document", F.col("text")))
    rows = rows.join(had.withColumn("had", F.lit(True)), "cache_key", "left")
    return rows.select("chunk_id", F.coalesce("had", F.lit(False)).alias("cached"), F.round(F.get("vector", F.lit(0)), 6).alias("first"))


class Finder:
    """A model for queries: a claim is supported where the passage holds it; it fails on one that is empty."""

    def __call__(self, prompt):
        source, claim = prompt.removeprefix("PASSAGE:\n").split("\n\nCLAIM:\n")
        if not claim:
            raise ValueError("no claim")
        return json.dumps({"verdict": "supported" if claim in source else "unsupported", "evidence": claim if claim in source else ""})


_JUDGED = """
WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations), p AS (SELECT conv_id, list(text ORDER BY position) AS p FROM t WHERE position <= 3 GROUP BY 1),
c AS (SELECT conv_id, p, trim(regexp_replace(substr(p[(conv_id % 3) + 1], 1, 40), '(?s)[^A-Za-z ].*', '')) AS claim, CASE conv_id % 5 WHEN 0 THEN [1] WHEN 1 THEN [1, 2] WHEN 2 THEN [7] ELSE [2, 3] END AS cited FROM p),
s AS (SELECT *, array_to_string([p[i] FOR i IN cited IF i <= len(p)], chr(10) || chr(10)) AS shown, array_to_string(p, chr(10) || chr(10)) AS every FROM c WHERE claim IS NOT NULL)"""


@_query(_JUDGED + " SELECT conv_id, CASE WHEN shown = '' THEN CASE WHEN claim <> '' AND contains(every, claim) AND len(p) > len(cited) THEN 'miscited' ELSE 'unsupported' END WHEN claim = '' THEN 'unjudged' WHEN contains(shown, claim) THEN 'supported' WHEN contains(every, claim) AND len(p) > len(cited) THEN 'miscited' ELSE 'unsupported' END AS verdict FROM s")
def claims_judged_by_model(spark, sf_dir):
    """Each conversation's first turns as passages; claims are words of one of them and cite by rule."""
    c = views.read(spark, sf_dir, "conversations")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    passages = c.withColumn("position", place).where("position <= 3").select(F.col("conv_id").alias("answer_id"), "position", F.lit("turn").alias("label"), "text")
    lists = passages.groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x.text).alias("p"))
    claim = F.trim(F.regexp_replace(F.substring(F.get("p", (F.col("answer_id") % 3).cast("int")), 1, 40), r"(?s)[^A-Za-z ].*", ""))
    k = F.col("answer_id") % 5
    cited = F.when(k == 0, F.array(F.lit(1))).when(k == 1, F.array(F.lit(1), F.lit(2))).when(k == 2, F.array(F.lit(7))).otherwise(F.array(F.lit(2), F.lit(3)))
    claims = lists.select(F.col("answer_id").alias("claim_id"), "answer_id", claim.alias("claim"), cited.alias("indices")).where("claim is not null")
    return models.judge(claims, passages, Finder).select(F.col("claim_id").alias("conv_id"), "verdict")


def _registry(spark, sf_dir):
    orders = views.read(spark, sf_dir, "orders")

    def status(calls):
        met = calls.join(orders.select(F.col("o_orderkey").alias("order"), "o_orderstatus"), "order", "left")
        said = F.concat(F.lit("order "), F.col("order"), F.lit(" is "), F.when(F.coalesce("lower", F.lit(False)), F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")))
        return met.select("call_id", F.coalesce(said, F.lit("no such order")).alias("content"), F.col("o_orderstatus").isNull().alias("is_error"))

    def risks(calls):
        asked = steps.written(views.asked_orders(calls), "asked-orders")  # so that Spark knows how few they are
        found = _findings(spark, sf_dir, asked).groupBy("issue_key").agg(F.count(F.lit(1)).alias("n"))
        return calls.join(found, "issue_key").select("call_id", F.concat(F.col("n"), F.lit(" findings")).alias("content"))  # an issue without any is left out

    return tools.Registry((tools.Tool("order_status", status, {"order": "integer", "lower": "boolean"}, ("order",), label="Orders"), tools.Tool("risk_findings", risks, {"issue_key": "string"}, ("issue_key",), label="Findings"), tools.flag_tool()))


def _calls(spark, sf_dir):
    """A call an event, in eight forms: the tools' own, and what does not fit."""
    e = views.read(spark, sf_dir, "events")
    n, k = F.col("user_id"), F.col("event_id") % 8
    name = F.when(k.isin(0, 1, 2), "order_status").when(k.isin(3, 4), "risk_findings").when(k.isin(5, 6), "propose_flag_at_risk").otherwise("close_issue")
    key = F.concat(F.lit('{"issue_key": "ORD-'), n, F.lit('"'))
    text = F.when(k == 0, F.concat(F.lit('{"order": '), n, F.lit(', "lower": true}'))).when(k == 1, F.concat(F.lit('{"order": "'), n, F.lit('"}'))).when(k == 2, "{order").when(k == 3, F.concat(key, F.lit("}"))).when(k == 4, F.concat(key, F.lit(', "level": 1}')))
    text = text.when(k == 5, F.concat(key, F.lit(', "rationale": "r", "evidence_rule_ids": ["overdue"]}'))).when(k == 6, F.concat(key, F.lit(', "rationale": "r", "evidence_rule_ids": []}')))
    return e.select(F.col("event_id").alias("call_id"), name.alias("name"), text.alias("arguments"))


_CALLS = FINDINGS + """, g AS (SELECT key, count(*) AS n FROM f GROUP BY 1), c AS (SELECT event_id AS call_id, event_id % 8 AS k, user_id AS u, o_orderstatus AS st, g.n AS n FROM events LEFT JOIN orders ON o_orderkey = user_id LEFT JOIN g ON g.key = 'ORD-' || user_id),
r AS (SELECT call_id, k, CASE k WHEN 0 THEN coalesce('order ' || u || ' is ' || lower(st), 'no such order') WHEN 1 THEN 'Invalid arguments for order_status: argument ''order'' is no integer' WHEN 2 THEN 'Invalid arguments for order_status: not an object'
  WHEN 3 THEN coalesce(n || ' findings', 'Tool risk_findings failed: no result') WHEN 4 THEN 'Invalid arguments for risk_findings: unexpected argument ''level'''
  WHEN 5 THEN 'Proposed flagging ORD-' || u || ' as at-risk. AWAITING HUMAN APPROVAL — nothing has been written to Jira.' WHEN 6 THEN 'Rejected: a flag proposal requires at least one supporting rule id from get_risk_findings.'
  ELSE 'Unknown tool ''close_issue''. Available: order_status, propose_flag_at_risk, risk_findings' END AS content, CASE k WHEN 0 THEN st IS NULL WHEN 3 THEN n IS NULL WHEN 5 THEN false ELSE true END AS is_error, CASE WHEN k = 5 THEN 'ORD-' || u END AS proposed FROM c)"""


@_query(_CALLS + " SELECT call_id, content, is_error, proposed FROM r")
def tool_calls(spark, sf_dir):
    return _registry(spark, sf_dir).execute(_calls(spark, sf_dir)).select("call_id", "content", "is_error", F.col("proposal.issue_key").alias("proposed"))


@_query(_CALLS + " SELECT call_id, CASE WHEN k IN (5, 6) THEN 'Unknown tool ''propose_flag_at_risk''. Available: order_status, risk_findings' WHEN k = 7 THEN 'Unknown tool ''close_issue''. Available: order_status, risk_findings' ELSE content END AS content FROM r")
def tool_calls_read_only(spark, sf_dir):
    """Without the tools that propose changes."""
    return _registry(spark, sf_dir).read_only().execute(_calls(spark, sf_dir)).select("call_id", "content")


# ------------------------------------------------------------------ Markdown

_MD = "WITH c AS (SELECT conv_id, turn, len(string_split(text, chr(10))) AS n FROM conversations WHERE text IS NOT NULL)"


@_query(
    _MD
    + """, b AS (SELECT conv_id, turn, n, unnest([0, 1, 2, 3, 4, 5]) AS ordinal FROM c)
SELECT conv_id, turn, ordinal::INT AS ordinal, ['heading', 'list', 'rule', 'table', 'list', 'paragraph'][ordinal + 1] AS kind, CASE WHEN ordinal = 0 THEN conv_id % 6 + 1 ELSE 0 END::INT AS level,
  CASE ordinal WHEN 0 THEN 'Turn ' || turn WHEN 1 THEN 'true' WHEN 3 THEN conv_id || '/' || turn WHEN 4 THEN 'false' WHEN 5 THEN 'wrapped ' || turn || ' prose' END AS said, CASE ordinal WHEN 1 THEN n WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END::INT AS items FROM b"""
)
def markdown_blocks(spark, sf_dir):
    """Every turn, set as Markdown by rule, its lines as a loose list."""
    c = views.read(spark, sf_dir, "conversations").where("text is not null")
    n = F.col("turn").cast("string")
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("1. "), x)), "\n\n")
    md = F.concat(F.repeat(F.lit("#"), (F.col("conv_id") % 6 + 1).cast("int")), F.lit(" Turn "), n, F.lit("\n"), lines, F.lit("\n---\n| a | b |\n|---|:-:|\n| "), F.col("conv_id"), F.lit(" | "), n, F.lit(" |\n* x\n\n+ y\n  wrapped\n "), n, F.lit(" \r\nprose\n"))
    b = markdown.markdown_blocks(c.select("conv_id", "turn", md.alias("text")))
    said = F.when(F.col("kind") == "list", F.col("ordered").cast("string")).when(F.col("kind") == "table", F.array_join(F.get("body", F.lit(0)), "/")).otherwise(F.col("text"))
    items = F.when(F.col("kind") == "list", F.size("items")).when(F.col("kind") == "table", F.size("body")).otherwise(0)
    return b.select("conv_id", "turn", "ordinal", "kind", F.coalesce("level", F.lit(0)).alias("level"), said.alias("said"), items.alias("items"))
