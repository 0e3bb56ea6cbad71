"""Calls are parsed once, and risks are found for the issues asked for alone."""

from pyspark.sql import functions as F

from ledgerloom import catalogue, catalogue_flows
from ledgerloom.operators import rules
from ledgerloom.plans import views

from test_models import registry

DIR = "/root/testdata/sf0.001"
NO_RESULT = "Tool risk_findings failed: no result"


def test_calls_are_read_once_however_many_tools(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(text):
        seen.add(1)
        return text

    rows = [(1, "shout", '{"text": "a"}'), (2, "shout", "{text"), (3, "sing", "{}"), (4, "propose_flag_at_risk", '{"issue_key": "a-1", "rationale": "r", "evidence_rule_ids": ["x"]}'), (5, None, None)]
    calls = spark.createDataFrame(rows, "call_id int, name string, arguments string").withColumn("arguments", F.udf(noted)("arguments"))
    got = {r.call_id: r.is_error for r in registry().execute(calls).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: True} and seen.value == len(rows)


def test_risks_are_found_for_asked_issues_alone(spark, monkeypatch):
    given, evaluate = [], rules.evaluate
    monkeypatch.setattr(rules, "evaluate", lambda issues, *rest: (given.append(issues), evaluate(issues, *rest))[1])
    said = catalogue_flows.tool_calls_read_only(spark, DIR).where("content like '% findings'").count()
    asked = {r.key for r in views.read(spark, DIR, "events").where("event_id % 8 = 3").select(F.concat(F.lit("ORD-"), "user_id").alias("key")).distinct().collect()}
    keys = [r.key for r in given[0].select("key").collect()]
    assert said > 0 and len(given) == 1 and 0 < len(keys) == len(set(keys)) <= len(asked) and set(keys) <= asked
    assert len(keys) < views.read(spark, DIR, "orders").count()


def test_only_an_issues_own_key_is_answered(spark):
    found = catalogue._findings(spark, DIR).groupBy("issue_key").count().orderBy("issue_key").first()
    n = found.issue_key.removeprefix("ORD-")
    keys = [found.issue_key, f"ORD-0{n}", f"ord-{n}", f"ORD- {n}", f"ORD-{n} ", f"ORD-{n}.0", "ORD-", "", "ORD-" + "9" * 30, "ORD--1"]
    calls = spark.createDataFrame([(k, "risk_findings", f'{{"issue_key": "{key}"}}') for k, key in enumerate(keys)], "call_id int, name string, arguments string")
    got = {r.call_id: r.content for r in catalogue_flows._registry(spark, DIR).execute(calls).collect()}
    assert got == {0: f"{found['count']} findings"} | {k: NO_RESULT for k in range(1, len(keys))}


def test_all_issues_asked_for_are_all_issues(spark):
    asked = views.asked_orders(views.read(spark, DIR, "orders").select(F.concat(F.lit("ORD-"), "o_orderkey").alias("issue_key")))
    one, all_ = catalogue._findings(spark, DIR, asked), catalogue._findings(spark, DIR)
    assert one.count() == all_.count() > 0 and one.exceptAll(all_).count() == 0
