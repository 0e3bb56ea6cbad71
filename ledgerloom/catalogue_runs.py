"""Queries of readers, logs, roll-ups and wording, each with its oracle in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import ANSWERS, FINDINGS, ISSUES, SPANS, _findings, _spans
from . import steps
from .functions import text as T
from .operators import evaluation, grounding, ranks, report, rollup, rules, trace, wording
from .plans import gates, views
from .registry import query as _query
from .sources import ingest, paged, readers

# ------------------------------------------------------------------- readers


def _search(spark, sf_dir):
    """All orders as the pages of an issue search, a project for each nation's customers, streams by status."""
    o, c = views.read(spark, sf_dir, "orders"), views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    issue = F.struct(
        F.concat(F.lit("O-"), F.col("o_orderkey")).alias("key"),
        F.struct(F.struct(F.concat(F.lit("N-"), F.col("c_nationkey")).alias("key")).alias("project"), F.struct(F.col("o_orderstatus").alias("name")).alias("status"), F.when(F.col("o_orderkey") % 7 != 0, "2001-01-02T03:04:05.000+0000").alias("created")).alias("fields"),
    )
    rows = o.join(c, "o_custkey").select(F.concat(F.lit("N-"), F.col("c_nationkey")).alias("scope"), F.col("o_orderstatus").alias("facet"), F.col("o_orderkey").alias("ord"), F.to_json(issue).alias("payload"))
    path = steps.new_path(spark, "search-pages")
    paged.publish(rows, path, "token")
    return path


_O = "SELECT 'N-' || c_nationkey AS project, 'O-' || o_orderkey AS issue_key, o_orderstatus AS status, row_number() OVER (PARTITION BY c_nationkey, o_orderstatus ORDER BY o_orderkey) - 1 AS place, o_orderkey % 7 AS seventh FROM orders JOIN customer ON c_custkey = o_custkey"


@_query(f"SELECT project, issue_key, status, (place // 50)::INT AS page FROM ({_O})")
def issue_search_pages(spark, sf_dir):
    """Cursors followed within each project and status, over all of them."""
    issues = paged.search_issues(spark, _search(spark, sf_dir))
    return issues.select("project", F.get_json_object("payload", "$.key").alias("issue_key"), "status", "page")


@_query(f"SELECT project, issue_key, status AS status_name FROM ({_O}) WHERE project IN ('N-3', 'N-7') AND status <> 'F' AND seventh <> 0")
def open_issues_of_projects(spark, sf_dir):
    """Two projects and the open statuses are asked for; what does not map is set aside."""
    rows = paged.search_issues(spark, _search(spark, sf_dir)).where("project in ('N-3', 'N-7') and status in ('O', 'P')")
    issues, _ = ingest.map_issues(rows.where("error is null"))
    return issues.select(F.col("project_key").alias("project"), F.col("key").alias("issue_key"), "status_name")


@_query(f"SELECT project, count(*) AS gaps FROM ({_O}) WHERE seventh = 0 GROUP BY 1")
def issue_search_gaps(spark, sf_dir):
    rows = paged.search_issues(spark, _search(spark, sf_dir))
    _, unmapped = ingest.map_issues(rows)
    return unmapped.unionByName(paged.gaps(rows, "project")).groupBy(F.col("scope").alias("project")).agg(F.count(F.lit(1)).alias("gaps"))


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'")
def source_pushdown(spark, sf_dir):
    """Project and open status as filters that reach the Parquet scan."""
    return views.read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus <> 'F'").select("o_orderkey", "o_orderstatus")


def _wiki(spark, sf_dir):
    p = views.read(spark, sf_dir, "pages").select("page_id", "url", "html")
    k = F.col("page_id")
    label = lambda n: F.struct(F.concat(F.lit("l"), n).alias("name"))
    page = F.struct(
        F.when(k % 10 != 3, k).alias("id"), F.concat(F.lit("Page "), k).alias("title"), F.struct(F.when(k % 2 == 0, k % 7).alias("number"), F.when(k % 10 != 4, "2001-01-02T03:04:05.000Z").alias("createdAt")).alias("version"),
        F.struct(F.struct(F.concat(F.lit("<h2>One</h2><p>a</p>"), F.lit("<p>b</p>")).alias("value")).alias("storage")).alias("body"), F.struct(F.array(label(k % 3), label(k % 5)).alias("results")).alias("labels"), F.struct(F.concat(F.lit("/x/"), k).alias("webui")).alias("_links"),
    )
    # All pages, streams by their first label; a second label is met by the filter after the parse.
    path = steps.new_path(spark, "wiki-pages")
    paged.publish(p.select(F.concat(F.lit("S"), k % 4).alias("scope"), F.concat(F.lit("l"), k % 3).alias("facet"), k.alias("ord"), F.to_json(page).alias("payload")), path, "link", field="results")
    rows = paged.wiki_pages(spark, path).where("error is null").select(F.col("space").alias("scope"), "payload")
    return readers.map_pages(rows, "https://w.example", ["l1", "l4"])


@_query("SELECT page_id::VARCHAR AS page_id, 'S' || page_id % 4 AS space_key, 'Page ' || page_id AS title, 'https://w.example/wiki/x/' || page_id AS url, CASE WHEN page_id % 2 = 0 THEN page_id % 7 ELSE 1 END::INT AS version, 978404645::BIGINT AS updated, 'l' || page_id % 3 || ',l' || page_id % 5 AS labels, 'One:2:a' || chr(10) || chr(10) || 'b' AS sections FROM pages WHERE page_id % 10 NOT IN (3, 4) AND (page_id % 3 = 1 OR page_id % 5 IN (1, 4))")
def wiki_pages(spark, sf_dir):
    pages = _wiki(spark, sf_dir)[0]
    said = F.array_join(F.transform("sections", lambda s: F.concat_ws(":", s["heading"], s["level"].cast("string"), s["text"])), "|")
    return pages.select("page_id", "space_key", "title", "url", "version", F.unix_seconds("updated_at").alias("updated"), F.array_join("labels", ",").alias("labels"), said.alias("sections"))


@_query("SELECT 'S' || page_id % 4 AS scope, page_id % 10 = 3 AS nameless, count(*) AS gaps FROM pages WHERE page_id % 10 IN (3, 4) GROUP BY 1, 2")
def wiki_gaps(spark, sf_dir):
    return _wiki(spark, sf_dir)[1].groupBy("scope", F.col("detail").startswith("{").alias("nameless")).agg(F.count(F.lit(1)).alias("gaps"))


@_query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN '/wiki/p' ELSE '/wiki/p?cursor=' || c_custkey || '&limit=2' END AS path FROM customer")
def relative_links(spark, sf_dir):
    k = F.col("c_custkey")
    link = F.when(k % 3 == 0, F.concat(F.lit("https://h.example:8443/wiki/p?cursor="), k, F.lit("&limit=2#top"))).when(k % 3 == 1, F.concat(F.lit("/wiki/p?cursor="), k, F.lit("&limit=2"))).otherwise("//h.example/wiki/p")
    return views.read(spark, sf_dir, "customer").select("c_custkey", readers.relative_path(link).alias("path"))


@_query("SELECT 'q' || n_nationkey AS question, CASE WHEN n_nationkey % 2 = 0 THEN 'p' || n_regionkey ELSE '' END AS relevant, CASE WHEN n_nationkey % 3 = 0 THEN 'temporal' ELSE 'general' END AS category, '' AS note FROM nation")
def eval_cases(spark, sf_dir):
    k = F.col("n_nationkey")
    case = F.struct(F.concat(F.lit("q"), k).alias("question"), F.when(k % 2 == 0, F.array(F.concat(F.lit("p"), F.col("n_regionkey")))).otherwise(F.array().cast("array<string>")).alias("relevant_page_ids"), F.when(k % 3 == 0, "temporal").alias("category"))
    files = views.read(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.collect_list(case).alias("cases"))).alias("json"))
    return readers.cases_of(files).select("question", F.array_join("relevant_page_ids", ",").alias("relevant"), "category", "note")


_FILE = "WITH f AS (SELECT n_nationkey AS k, 'extra_' || n_nationkey AS key, n_nationkey * 0.1::DOUBLE AS value FROM nation)"


@_query(_FILE + " SELECT key, round(value, 6) AS baseline, CASE WHEN k % 2 = 0 THEN 0.05::DOUBLE ELSE 0 END AS tolerance, 'higher_is_better' AS direction, CASE WHEN k % 5 = 1 THEN 3 ELSE 1 END AS baseline_runs FROM f")
def thresholds_file(spark, sf_dir):
    k = F.col("n_nationkey")
    entry = F.struct((k * 0.1).alias("value"), F.when(k % 2 == 0, 0.05).alias("tolerance"), F.when(k % 5 == 1, 3).alias("baseline_runs"))
    files = views.read(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("extra_"), k), entry))).alias("metrics"))).alias("json"))
    merged = evaluation.overlay(readers.thresholds_of(files), evaluation.default_thresholds(spark)).where("key like 'extra%'")
    return merged.select("key", F.round("baseline", 6).alias("baseline"), "tolerance", "direction", "baseline_runs")


@_query("SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'a')")
def field_catalogue(spark, sf_dir):
    return readers.field_catalogue(views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "A")


@_query("SELECT DISTINCT l_partkey + CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE 1000000000 END AS id, l_orderkey % 2 = 0 AS \"exists\" FROM lineitem")
def known_fields(spark, sf_dir):
    """Field ids that line items name, half of which no part has."""
    configured = views.read(spark, sf_dir, "lineitem").select((F.col("l_partkey") + F.when(F.col("l_orderkey") % 2 == 0, 0).otherwise(1_000_000_000)).alias("id")).distinct()
    return readers.known_fields(configured, views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))).select("id", "exists")


@_query(ISSUES + ", f AS (SELECT * FROM i ORDER BY key LIMIT 50) SELECT count(*) AS sampled, count(*) FILTER (WHERE release IS NOT NULL) AS with_release, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM l WHERE l.ok = f.ok AND (rf = 'R' OR (ln <= 2 AND moment >= f.created)))) AS with_changes FROM f")
def connection_sample(spark, sf_dir):
    return readers.connection_sample(views.issues(spark, sf_dir))


@_query("SELECT 'GEN-' || (i + 1) AS key, CASE i % 3 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'todo' ELSE 'done' END AS status_category, (i % 5)::INT AS moves FROM range((SELECT count(*) FROM customer)) t(i)")
def generated_issues(spark, sf_dir):
    """As many issues as there are customers."""
    return readers.generated_issues(spark, views.read(spark, sf_dir, "customer").count()).select("key", "status_category", "moves")


@_query("SELECT count(*) AS issues, count(*) FILTER (WHERE o_orderkey % 5 < 2) AS blank FROM orders JOIN customer ON o_custkey = c_custkey")
def blank_rate(spark, sf_dir):
    return readers.blank_rate(views.issues(spark, sf_dir))


@_query("SELECT doc_id AS prompt_id, CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) THEN length(text)::VARCHAR END AS reply FROM documents WHERE text IS NOT NULL")
def reply_replay(spark, sf_dir):
    d = views.read(spark, sf_dir, "documents").where("text is not null")
    recorded = d.where("doc_id % 2 = 0").select(F.sha2(F.concat_ws(":", F.lit("m"), F.col("text")), 256).alias("reply_key"), F.length("text").cast("string").alias("reply")).distinct()
    return readers.replayed(d.select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt")), recorded, "m").select("prompt_id", "reply")


@_query("SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN t || ' / ' || role || ': ' || t WHEN 1 THEN role || ': ' || t ELSE substr(t, 1, 200) END AS text FROM (SELECT *, coalesce(text, '') AS t FROM conversations)")
def error_texts(spark, sf_dir):
    """Turns as bodies of refused requests: messages and fields, fields alone, or no JSON at all."""
    k, t = F.col("conv_id") % 3, F.coalesce("text", F.lit(""))
    fields = F.create_map("role", t)
    body = F.when(k == 0, F.to_json(F.struct(F.array(t).alias("errorMessages"), fields.alias("errors")))).when(k == 1, F.to_json(F.struct(fields.alias("errors")))).otherwise(t)
    return views.read(spark, sf_dir, "conversations").select("conv_id", "turn", ingest.explain_errors(body).alias("text"))


# ---------------------------------------------------------------------- logs


def _proposals(spark, sf_dir):
    o = views.read(spark, sf_dir, "orders")
    cited = F.when(F.col("o_orderkey") % 9 != 0, F.array(F.struct(F.lit("issue").alias("source_type"), F.col("o_orderkey").cast("string").alias("source_id"))))
    return o.select(F.col("o_orderkey").alias("place"), F.concat(F.lit("K-"), F.col("o_orderkey")).alias("issue_key"), F.when(F.col("o_orderkey") % 2 == 0, "flag_at_risk").otherwise("add_comment").alias("action_type"), cited.alias("citations"))


_P = "WITH p AS (SELECT o_orderkey AS place, row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders WHERE o_orderkey % 9 <> 0), s AS (SELECT place, seq, CASE WHEN seq < 10000 THEN printf('prop_%04d', seq) ELSE 'prop_' || seq END AS proposal_id FROM p)"
_DEC = _P + """, d AS (SELECT proposal_id, place, 1000000 + 2 * seq + i AS nr, CASE WHEN (place + i) % 3 = 0 THEN 'rejected' ELSE 'approved' END AS act, CASE WHEN place % 5 = 0 AND i = 0 THEN ' ' ELSE 'lead' END AS actor FROM s, (SELECT unnest([0, 1]) AS i)),
v AS (SELECT *, act <> 'approved' OR trim(actor) <> '' AS valid FROM d), w AS (SELECT *, row_number() OVER (PARTITION BY proposal_id, valid ORDER BY nr) AS turn FROM v)"""


@_query(_P + " SELECT proposal_id, seq, 'K-' || place AS issue_key FROM s")
def proposal_ids(spark, sf_dir):
    return gates.submitted(_proposals(spark, sf_dir), "place")[0].select("proposal_id", "seq", "issue_key")


@_query("SELECT 'K-' || o_orderkey AS issue_key FROM orders WHERE o_orderkey % 9 = 0")
def proposals_refused(spark, sf_dir):
    return gates.submitted(_proposals(spark, sf_dir), "place")[1].select("issue_key")


def _decided(spark, sf_dir):
    events = gates.submitted(_proposals(spark, sf_dir), "place")[0]
    asked = events.select("proposal_id", "place", "seq", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    d = asked.select("proposal_id", (F.lit(1_000_000) + 2 * F.col("seq") + F.col("i")).alias("seq"), F.when((F.col("place") + F.col("i")) % 3 == 0, "rejected").otherwise("approved").alias("act"), F.when((F.col("place") % 5 == 0) & (F.col("i") == 0), " ").otherwise("lead").alias("actor"))
    return gates.decided(d, gates.latest_state(events))


@_query(_DEC + " SELECT proposal_id, nr AS seq, act, 'K-' || place AS issue_key FROM w WHERE valid AND turn = 1")
def approval_decisions(spark, sf_dir):
    return _decided(spark, sf_dir)[0].select("proposal_id", "seq", "act", "issue_key")


@_query(_DEC + " SELECT proposal_id, nr AS seq, CASE WHEN NOT valid THEN 'no named actor' ELSE 'already decided' END AS conflict FROM w WHERE NOT valid OR turn > 1")
def approval_conflicts(spark, sf_dir):
    return _decided(spark, sf_dir)[1].select("proposal_id", "seq", "conflict")


@_query(_DEC + """, r AS (SELECT proposal_id, nr, act, place, turn, CASE WHEN place % 8 = 0 THEN 'refused' ELSE '' END AS error, place % 16 = 4 AS written FROM w WHERE valid)
SELECT proposal_id, nr AS seq, CASE WHEN act = 'rejected' THEN '' WHEN turn > 1 THEN ', approved but not yet applied' WHEN error <> '' THEN ', not applied — refused' WHEN written THEN ', written to Jira' ELSE ', recorded — dry run, nothing written to Jira' END AS outcome FROM r""")
def audit_outcomes(spark, sf_dir):
    """The write's result is kept with the decision that stands, and told; later ones of the proposal are in the log as well."""
    stands, later = _decided(spark, sf_dir)
    audit = stands.unionByName(later.where("conflict = 'already decided'").drop("conflict"))
    place = F.substring("issue_key", 3, 20).cast("long")
    results = stands.where("act = 'approved'").select("proposal_id", F.when(place % 8 == 0, "refused").otherwise("").alias("error"), (place % 16 == 4).alias("written"))
    rows = gates.applied(audit, results)
    return rows.select("proposal_id", "seq", wording.audit_outcome(F.col("act"), F.col("applied"), F.col("apply_error"), F.col("written")).alias("outcome"))


_RUNS = "WITH g AS (SELECT DISTINCT o_custkey % 50 AS run_id FROM orders WHERE o_totalprice > 500000 OR o_custkey % 50 = 49), u AS (SELECT i AS run_id, 1000 + i * 10 AS finished_at FROM range(50) t(i)), l AS (SELECT max(run_id) AS run_id FROM u WHERE run_id NOT IN (SELECT run_id FROM g))"


def _run_log(spark, sf_dir):
    runs = spark.range(50).select(F.col("id").alias("run_id"), (F.col("id") * 10 + 1000).alias("finished_at"))
    o = views.read(spark, sf_dir, "orders").withColumn("run_id", F.col("o_custkey") % 50)
    return runs, o, o.where("o_totalprice > 500000 or run_id = 49").select("run_id")


@_query(_RUNS + " SELECT count(*) AS orders, any_value(run_id) AS run_id FROM orders JOIN l ON o_custkey % 50 = run_id")
def latest_complete_snapshot(spark, sf_dir):
    """The rows that are served: those of the newest run without a gap."""
    runs, o, gaps = _run_log(spark, sf_dir)
    return gates.snapshot(o, runs, gaps).agg(F.count(F.lit(1)).alias("orders"), F.first("run_id").alias("run_id"))


@_query("SELECT 'partial' AS state, (SELECT count(*) FROM pages WHERE page_id % 7 <> 6) AS pages, 5::BIGINT AS covered, 2::BIGINT AS incomplete")
def docs_load(spark, sf_dir):
    spaces = spark.range(7).select(F.concat(F.lit("S"), F.col("id")).alias("space_key"))
    pages = views.read(spark, sf_dir, "pages").where("page_id % 7 <> 6").select(F.concat(F.lit("S"), F.col("page_id") % 7).alias("space_key"))
    return gates.docs_load(spaces, pages, spaces.where("space_key in ('S5', 'S6')"))


@_query("SELECT c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN 'permission_denied' WHEN c_custkey % 3 = 1 THEN 'timeout' ELSE 'upstream_error' END AS reason, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'sync' END AS scope FROM customer WHERE c_acctbal < 0")
def gap_log(spark, sf_dir):
    c = views.read(spark, sf_dir, "customer").where("c_acctbal < 0")
    message = F.when(F.col("c_custkey") % 3 == 0, "403 Forbidden").when(F.col("c_custkey") % 3 == 1, "read timed out").otherwise("bad gateway")
    return gates.recorded_gaps(c.select(F.col("c_custkey").alias("seq"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("scope"), message.alias("message")), views.now()).select("seq", "reason", "scope")


# ------------------------------------------------------------------ roll-ups


@_query(ANSWERS + " SELECT count(*) AS probes, count(*) FILTER (WHERE split_part(answer_id, '-', 1)::BIGINT % 3 = 0 AND NOT contains(lower(text), 'zu') AND NOT contains(lower(text), 'the')) AS held FROM an")
def adversarial_held(spark, sf_dir):
    a = views.answers(spark, sf_dir)
    return rollup.held(a.select("text", (F.split("answer_id", "-")[0].cast("long") % 3 == 0).alias("refused"), F.array(F.lit("ZU"), F.lit("The")).alias("forbidden")))


_SUITE = SPANS + """, q AS (SELECT doc_id % 5 <> 0 AS answerable, doc_id % 3 = 0 AS declined, quality AS supported, toxic AS overreach, 1 - quality AS unsupported, 2 AS claims FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL),
a AS (SELECT count(*) FILTER (WHERE answerable) AS n, count(*) FILTER (WHERE NOT answerable) AS m, count(*) FILTER (WHERE NOT answerable AND declined) AS r, sum(supported) FILTER (WHERE answerable) AS s, sum(overreach) FILTER (WHERE answerable) AS o, sum(unsupported) FILTER (WHERE answerable) AS u, sum(claims) FILTER (WHERE answerable) AS c FROM q),
b AS (SELECT sum(cost) FILTER (WHERE kind IN ('click', 'view')) AS x, sum(cost) FILTER (WHERE kind NOT IN ('click', 'view')) AS y, count(*) FILTER (WHERE kind IN ('click', 'view')) AS k FROM d)
SELECT key, round(value, 6) AS value FROM (SELECT 'groundedness_supported' AS key, s / c AS value FROM a UNION ALL SELECT 'groundedness_overreach', o / c FROM a UNION ALL SELECT 'groundedness_unsupported', u / c FROM a UNION ALL SELECT 'refusal_rate', r / m FROM a UNION ALL SELECT 'cost_per_answer', x / nullif(k, 0) FROM b UNION ALL SELECT 'cost_per_eval', (coalesce(x, 0) + coalesce(y, 0)) / n FROM a, b) WHERE value IS NOT NULL"""


@_query(_SUITE)
def suite_rollup(spark, sf_dir):
    rows = views.read(spark, sf_dir, "labels").where("doc_id is not null and quality is not null and toxic is not null")
    outcomes = rows.select((F.col("doc_id") % 5 != 0).alias("answerable"), (F.col("doc_id") % 3 == 0).alias("declined"), F.col("quality").alias("supported"), F.col("toxic").alias("overreach"), (1 - F.col("quality")).alias("unsupported"), F.lit(2).alias("claims"))
    spans = trace.with_durations(_spans(spark, sf_dir)).withColumn("kind", F.when(F.col("kind").isin("click", "view"), "llm").otherwise("judge"))
    return rollup.suite(outcomes, spans).withColumn("value", F.round("value", 6))


@_query("SELECT n_nationkey AS case_id, len(coalesce(h, []))::INT AS hits FROM nation LEFT JOIN (SELECT c_nationkey + 1 AS n_nationkey, list(c_custkey) AS h FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1) USING (n_nationkey)")
def cases_with_hits(spark, sf_dir):
    """A nation's case with the customers found for it, every third of them a hit; the first nation has none."""
    cases = views.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("case_id"))
    found = views.read(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") + 1).alias("case_id")).agg(F.array_compact(F.collect_list(F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")))).alias("hits"))
    return rollup.paired(cases, found, "case_id").select("case_id", F.size("hits").alias("hits"))


def _checks(spark, sf_dir):
    """Observed: of all customers, the part whose key the length of the metric's name divides."""
    t = evaluation.default_thresholds(spark)
    hit = (F.col("c_custkey") % F.length("key") == 0).cast("int")
    seen = views.read(spark, sf_dir, "customer").crossJoin(F.broadcast(t.select("key"))).groupBy("key").agg(F.round(F.avg(hit), 6).alias("value"))  # a few metrics
    seen = seen.withColumn("runs", F.lit(1))
    return seen, evaluation.check(seen, t), t


_T = "WITH th(key, baseline, tolerance, direction, unit) AS (VALUES " + ", ".join(f"('{t[0]}', {t[2]}::DOUBLE, {t[3]}::DOUBLE, '{t[4]}', '{t[5]}')" for t in evaluation.THRESHOLDS) + "), t AS (SELECT th.*, (SELECT round(avg((c_custkey % length(key) = 0)::INT), 6) FROM customer) AS seen FROM th)"


@_query(_T + " SELECT key FROM t WHERE CASE WHEN direction = 'higher_is_better' THEN seen - baseline < -tolerance ELSE seen - baseline > tolerance END")
def failed_checks(spark, sf_dir):
    return rollup.failed(_checks(spark, sf_dir)[1]).select("key")


@_query(_T + " SELECT key, seen AS value, tolerance, direction, 3 AS baseline_runs FROM t")
def new_baseline(spark, sf_dir):
    seen, _, t = _checks(spark, sf_dir)
    return rollup.baseline_rows(seen, t, runs=3).select("key", "value", "tolerance", "direction", "baseline_runs")


@_query(_T + " SELECT key, 'now|a test|' AS head, seen AS value FROM t")
def baseline_file(spark, sf_dir):
    """The baseline's JSON, read again."""
    seen, _, t = _checks(spark, sf_dir)
    j = rollup.baseline_json(rollup.baseline_rows(seen, t), "now", "a test").select(F.from_json("json", "struct<recorded_at: string, reason: string, judge_model: string, metrics: map<string, struct<value: double>>>").alias("j"))
    return j.select(F.concat_ws("|", "j.recorded_at", "j.reason", "j.judge_model").alias("head"), F.explode("j.metrics").alias("key", "m")).select("key", "head", "m.value")


@_query("""WITH r AS (SELECT 'k' || c_nationkey % 3 AS category, (c_custkey % 2 = 0)::INT AS hit FROM customer) SELECT '{"k":5,"recall":' || round(avg(hit), 6) || ',"mrr":' || round(avg(hit), 6) || ',"by_category":{' || (SELECT string_agg('"' || category || '":' || v, ',' ORDER BY category) FROM (SELECT category, round(avg(hit), 6) AS v FROM r GROUP BY 1)) || '},"negatives_declined":0}' AS json FROM r""")
def eval_summary(spark, sf_dir):
    c = views.read(spark, sf_dir, "customer")
    ids = lambda cond: F.when(cond, F.array(F.lit("p"))).otherwise(F.array(F.lit("q")))
    cases = c.select(F.concat(F.lit("k"), F.col("c_nationkey") % 3).alias("category"), F.array(F.lit("p")).alias("relevant"), ids(F.col("c_custkey") % 2 == 0).alias("retrieved"), F.array().cast("array<string>").alias("forbidden"))
    return rollup.summary_json(evaluation.metrics(evaluation.case_results(cases)), 5)


@_query(FINDINGS + " SELECT level, count(*) AS findings, sum(n)::BIGINT AS citations FROM f GROUP BY ROLLUP (level)")
def findings_total(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return f.rollup("level").agg(F.count(F.lit(1)).alias("findings"), F.sum(F.size("citations")).alias("citations"))


@_query(SPANS + " SELECT span_id, (sum(tin + tout) OVER (PARTITION BY trace_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS tokens FROM p")
def running_tokens(spark, sf_dir):
    return trace.running_tokens(_spans(spark, sf_dir)).select("span_id", "tokens")


# ------------------------------------------------------------------- wording


@_query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '$' || printf('%.4f', o_totalprice::DOUBLE / 4096) WHEN 1 THEN printf('%.1f', o_totalprice::DOUBLE / 8) || 's' ELSE printf('%.1f', o_totalprice::DOUBLE / 32768 * 100) || '%' END AS shown FROM orders")
def format_by_unit(spark, sf_dir):
    """All orders' totals in three units, ties among them."""
    k, v = F.col("o_orderkey") % 3, F.col("o_totalprice").cast("double")
    unit = F.when(k == 0, "usd").when(k == 1, "seconds").otherwise("ratio")
    return views.read(spark, sf_dir, "orders").select("o_orderkey", wording.in_unit(F.when(k == 0, v / 4096).when(k == 1, v / 8).otherwise(v / 32768), unit).alias("shown"))


@_query("WITH a AS (SELECT event_id, event_id * 37 AS s FROM events), m AS (SELECT *, floor(s / 60 + 0.5)::BIGINT AS m FROM a), h AS (SELECT *, floor(m / 60 + 0.5)::BIGINT AS h FROM m) SELECT event_id, CASE WHEN s < 90 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN h < 24 THEN h || ' hr ago' ELSE floor(h / 24 + 0.5)::BIGINT || ' days ago' END AS age FROM h")
def human_age(spark, sf_dir):
    return views.read(spark, sf_dir, "events").select("event_id", wording.age(F.col("event_id") * 37).alias("age"))


@_query("SELECT event_id, ', as of ' || strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' AS said FROM events")
def as_of_text(spark, sf_dir):
    return views.read(spark, sf_dir, "events").select("event_id", wording.as_of(F.col("ts")).alias("said"))


@_query("""SELECT n_regionkey, 'Sync incomplete: ' || count(*) FILTER (WHERE n_nationkey % 2 = 0) || ' of ' || count(*) || ' projects were not fully read (' || coalesce(string_agg(n_name, ', ' ORDER BY n_nationkey) FILTER (WHERE n_nationkey % 2 = 0), '') || ').' ||
  CASE n_regionkey WHEN 0 THEN ' The service account lacks Browse Projects permission. This is fixable in Jira project settings.' WHEN 1 THEN ' Jira rate limits were exhausted. Retry with a smaller project set or a longer window.' ELSE '' END AS message FROM nation GROUP BY 1""")
def operator_messages(spark, sf_dir):
    n = views.read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))  # a region's nations
    name = lambda e: e["n_name"]
    reason = F.when(F.col("n_regionkey") == 0, "permission_denied").when(F.col("n_regionkey") == 1, "rate_limited").otherwise("timeout")
    return n.select("n_regionkey", wording.operator_message(F.transform("x", name), F.transform(F.filter("x", lambda e: e["n_nationkey"] % 2 == 0), name), reason).alias("message"))


@_query("WITH g AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation) SELECT n_regionkey, string_agg('timeout on N' || n_nationkey, '; ' ORDER BY r) FILTER (WHERE r <= 3) || CASE WHEN any_value(n) > 3 THEN '; +' || (any_value(n) - 3) || ' more' ELSE '' END AS summary FROM g GROUP BY 1")
def first_gaps(spark, sf_dir):
    gap = F.struct("n_nationkey", F.lit("timeout").alias("reason"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("scope"))
    g = views.read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(gap)).alias("g"))  # a region's nations
    return g.select("n_regionkey", wording.first_gaps(F.col("g"), 3).alias("summary"))


@_query("SELECT l_orderkey, string_agg('c' || l_linenumber, chr(10) || chr(10) ORDER BY l_shipdate DESC, l_linenumber) FILTER (WHERE l_linenumber % 3 <> 0) AS text FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_linenumber % 3 <> 0) > 0")
def blocker_text(spark, sf_dir):
    body = F.when(F.col("l_linenumber") % 3 == 0, "  ").otherwise(F.concat(F.lit(" c"), F.col("l_linenumber"), F.lit(" ")))
    c = views.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_shipdate").cast("timestamp").alias("created_at"), body.alias("body")))).alias("c"))
    return c.select("l_orderkey", wording.newest_first(F.col("c")).alias("text")).where("text <> ''")


@_query("""SELECT o_orderkey, '{"type":"doc","version":1,"content":[{"type":"paragraph","content":[{"type":"text","text":"order ' || o_orderkey || '"}]},{"type":"paragraph","content":[{"type":"text","text":"status ' || o_orderstatus || '"}]}]}' AS doc FROM orders""")
def rich_document(spark, sf_dir):
    return views.read(spark, sf_dir, "orders").select("o_orderkey", wording.rich_document(F.concat(F.lit("\n\norder "), F.col("o_orderkey"), F.lit(" \n \n status "), F.col("o_orderstatus"))).alias("doc"))


@_query(FINDINGS + ", x AS (SELECT key, string_agg('[' || upper(level) || '] ' || key || ' (' || rule_id || '): ' || detail, chr(10) ORDER BY o) AS text FROM f GROUP BY key) SELECT i.key AS scope, CASE WHEN x.text IS NOT NULL THEN md5(x.text) ELSE md5('The risk engine checked ' || i.key || ' and found no risk findings for it.' || '" + wording.NEGATIVE.replace("'", "''") + "' || ', as of 2001-12-01 12:00 UTC' || '" + wording.NEGATIVE_END.replace("'", "''") + "') END AS content, false AS is_error FROM i LEFT JOIN x USING (key)")
def risk_tool(spark, sf_dir):
    issues = views.issues(spark, sf_dir)
    asked = issues.select(F.col("key").alias("scope"), F.lit("issue").alias("kind"), views.now().alias("at"))
    found = _findings(spark, sf_dir)
    return wording.answers_about(asked, found, report.findings_text(found)).select("scope", F.md5("content").alias("content"), "is_error")


@_query(FINDINGS + " SELECT key || ' — ' || rule_id AS label, 'https://jira.example/browse/' || key AS url, detail AS text FROM f")
def narrative_passages(spark, sf_dir):
    found = rules.evaluate(views.issues(spark, sf_dir), rules.RiskConfig(base_url="https://jira.example"), views.now())
    return wording.narrative_passages(found).select("label", "url", "text")


@_query("SELECT c_mktsegment AS project, 'No risk findings were detected across ' || CASE WHEN c_mktsegment LIKE 'M%' THEN 'the synced projects' ELSE c_mktsegment || ', X' END || ' (' || count(*) || ' issues checked against every rule). This is a definitive result from a complete sync, not an empty report.' AS text FROM customer GROUP BY 1")
def empty_narrative(spark, sf_dir):
    c = views.read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("project")).agg(F.count(F.lit(1)).alias("n"))
    covered = F.when(F.col("project").startswith("M"), F.array().cast("array<string>")).otherwise(F.array(F.col("project"), F.lit("X")))
    return c.select("project", wording.empty_narrative(covered, F.col("n")).alias("text"))


@_query(FINDINGS + " SELECT row_number() OVER (ORDER BY level, key, o) AS place, level, key AS issue_key, rule_id FROM f")
def findings_in_order(spark, sf_dir):
    """Numbered by the level's name, then the issue."""
    return ranks.numbered(_findings(spark, sf_dir), ["level", "issue_key", "rule_ordinal"], "place").select("place", "level", "issue_key", "rule_id")


@_query(FINDINGS + " SELECT CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END::INT AS level_rank, row_number() OVER (PARTITION BY level ORDER BY key, o) AS position, key AS issue_key, rule_id FROM f")
def report_sections(spark, sf_dir):
    """The report's lists, as places in their level."""
    return report.sections(_findings(spark, sf_dir)).select("level_rank", F.col("position").cast("long").alias("position"), "issue_key", "rule_id")


@_query("SELECT event_id, CASE event_type WHEN 'click' THEN 'Search' WHEN 'view' THEN 'Findings' END AS label FROM events")
def tool_labels(spark, sf_dir):
    """Calls with their tool's label; an unknown tool has none."""
    tools = spark.createDataFrame([("click", "Search", False), ("view", "Findings", False), ("flag", "Flag", True)], "tool string, label string, writes boolean")
    return views.read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tool")).join(F.broadcast(tools.where("not writes")), "tool", "left").select("event_id", "label")


# ----------------------------------------------------------- judged and cited


@_query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'unsupported' WHEN doc_id % 4 = 1 THEN 'unjudged' WHEN doc_id % 3 = 0 THEN 'supported' WHEN doc_id % 3 = 1 THEN 'overreach' ELSE 'unjudged' END AS verdict FROM documents")
def judged_claims(spark, sf_dir):
    """All documents as sources: out of range, unreadable, and then quotes that are in the source or not, or need not be."""
    k = F.col("doc_id") % 3
    said = F.to_json(F.struct(F.when(k == 1, "overreach").otherwise(" Supported").alias("verdict"), F.when(k == 0, F.substring("text", 1, 30)).otherwise("zq zq zq not there").alias("evidence")))
    reply = F.when(F.col("doc_id") % 4 == 1, "no object here").otherwise(F.concat(F.lit("```json\n"), said, F.lit("\n```")))
    rows = views.read(spark, sf_dir, "documents").select("doc_id", reply.alias("reply"), F.col("text").alias("source"), (F.col("doc_id") % 4 != 0).alias("in_range"))
    return grounding.judged(rows).select("doc_id", "verdict")


@_query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND trim(coalesce(text, '')) <> '' THEN 'vendor' ELSE 'unknown' END AS category, CASE WHEN trim(coalesce(text, '')) = '' THEN 'no text' WHEN doc_id % 4 = 3 THEN 'unparseable reply' WHEN doc_id % 4 = 2 THEN 'unknown category' WHEN doc_id % 4 = 1 THEN 'quote not in text' ELSE '' END AS rejected_reason FROM documents")
def blocker_classes(spark, sf_dir):
    """All documents as sources; quotes are their first words, spaced otherwise, or none of theirs."""
    k = F.col("doc_id") % 4
    quote = F.when(k == 0, F.concat(F.lit(" "), F.replace(F.substring("text", 1, 40), F.lit(" "), F.lit("  ")))).otherwise("zq zq zq not there")
    said = F.to_json(F.struct(F.when(k == 2, "weather").otherwise("Vendor").alias("category"), quote.alias("evidence")))
    rows = views.read(spark, sf_dir, "documents").select("doc_id", F.when(k == 3, "none").otherwise(said).alias("reply"), F.col("text").alias("source"))
    return grounding.blocker_class(rows, ("vendor", "legal")).select("doc_id", "category", F.coalesce("rejected_reason", F.lit("")).alias("rejected_reason"))


@_query("SELECT o_custkey AS answer_id, string_agg('[' || r || '] ' || 'O' || o_orderkey || chr(10) || o_orderstatus, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS context FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 5 GROUP BY 1")
def context_blocks(spark, sf_dir):
    o = views.read(spark, sf_dir, "orders")
    few = o.groupBy("o_custkey").agg(F.slice(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), 1, 5).alias("x"))  # a customer's orders
    p = few.select(F.col("o_custkey").alias("answer_id"), F.posexplode("x").alias("i", "x")).select("answer_id", (F.col("i") + 1).alias("position"), F.concat(F.lit("O"), F.col("x.o_orderkey")).alias("label"), F.col("x.o_orderstatus").alias("text"))
    return grounding.context(p)


@_query(ANSWERS + r" SELECT c.answer_id, c.position, CASE WHEN c.position BETWEEN 1 AND 5 THEN 'P' || c.position END AS passage, count(*) AS times FROM (SELECT answer_id, unnest(regexp_extract_all(text, '\[(\d+)\]', 1))::INT AS position FROM an) c GROUP BY ALL")
def cited_passages(spark, sf_dir):
    a = views.answers(spark, sf_dir)
    asked = a.select("answer_id", T.citations(F.col("text")).alias("indices"))
    there = a.select("answer_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("position")).withColumn("text", F.concat(F.lit("P"), F.col("position")))
    return grounding.cited_passages(asked, there).groupBy("answer_id", "position", F.col("text").alias("passage")).agg(F.count(F.lit(1)).alias("times"))


@_query(FINDINGS + " SELECT key AS issue_key, rule_id, 'issue' AS source_type, 'https://jira.example/browse/' || key AS url FROM f")
def finding_citations(spark, sf_dir):
    """The citation of each finding's own issue."""
    found = rules.evaluate(views.issues(spark, sf_dir), rules.RiskConfig(base_url="https://jira.example"), views.now())
    own = F.filter("citations", lambda c: c["source_id"] == F.col("issue_key"))
    return found.select("issue_key", "rule_id", F.explode(F.slice(own, 1, 1)).alias("c")).select("issue_key", "rule_id", "c.source_type", "c.url")


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN -1e9 ELSE 1 END END NULLS LAST, o_orderkey) AS rank FROM orders")
def ranks_by_range(spark, sf_dir):
    """Orders by a sparse and signed key, null for every eleventh."""
    o = views.read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, -1e9).otherwise(1.0)).alias("k"))
    return ranks.numbered(o, ["k", "o_orderkey"], "rank").select("o_orderkey", "rank")


@_query("SELECT project, requested - covered AS missing FROM (SELECT c_mktsegment AS project, count(DISTINCT c_nationkey) AS requested, count(DISTINCT c_nationkey) FILTER (WHERE c_acctbal > 0) AS covered FROM customer GROUP BY 1)")
def requested_not_covered(spark, sf_dir):
    c = views.read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("project")).agg(F.collect_set("c_nationkey").alias("requested"), F.collect_set(F.when(F.col("c_acctbal") > 0, F.col("c_nationkey"))).alias("covered"))  # at most 25 nations
    return c.select("project", F.size(F.array_except("requested", "covered")).cast("long").alias("missing"))


@_query("SELECT row_number() OVER (ORDER BY turn, url) AS place, source, url FROM (SELECT 0 AS turn, 'tool' AS source, 'https://t/' || o_orderkey AS url FROM orders UNION ALL SELECT 1, 'hit', 'https://h/' || page_id FROM pages)")
def evidence_union(spark, sf_dir):
    """Evidence of tools first, then of searches, numbered."""
    tool = views.read(spark, sf_dir, "orders").select(F.lit(0).alias("turn"), F.lit("tool").alias("source"), F.concat(F.lit("https://t/"), F.col("o_orderkey")).alias("url"))
    hits = views.read(spark, sf_dir, "pages").select(F.lit(1).alias("turn"), F.lit("hit").alias("source"), F.concat(F.lit("https://h/"), F.col("page_id")).alias("url"))
    return ranks.numbered(tool.unionByName(hits), ["turn", "url"], "place").select("place", "source", "url")
