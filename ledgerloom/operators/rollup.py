"""Roll-ups over evaluation runs, and their JSON forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leaked(text: Column, forbidden: Column) -> Column:
    """The forbidden phrases that a text holds, whatever their case."""
    return F.filter(forbidden, lambda p: F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(p)))


def held(probes: DataFrame) -> DataFrame:
    """One row of ``text, refused, forbidden``: probes, and how many were refused without a leak."""
    safe = F.col("refused") & (F.size(leaked(F.col("text"), F.col("forbidden"))) == 0)
    return probes.agg(F.count(F.lit(1)).alias("probes"), F.count_if(safe).alias("held"))


def paired(cases: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Cases with the hits found for them beforehand (``key, hits``); none where nothing was."""
    return cases.join(hits, key, "left").withColumn("hits", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)))


def suite(outcomes: DataFrame, spans: DataFrame) -> DataFrame:
    """``key, value`` of a suite's metrics.

    ``outcomes``: one row a question and run, ``answerable, declined`` and counts
    ``supported, overreach, unsupported, claims``; verdicts count for answerable
    questions alone.  ``spans``: ``kind, cost_usd``.  The cost of an evaluated
    question holds the answers to all questions, also to those not answerable.
    A metric without a denominator is left out.
    """
    judged = F.col("answerable")
    total = lambda c: F.sum(F.when(judged, F.col(c)).otherwise(0))
    sums = outcomes.agg(*[total(c).alias(c) for c in ("supported", "overreach", "unsupported", "claims")], F.count_if(judged).alias("evaluated"), F.count_if(~judged).alias("expected"), F.count_if(~judged & F.col("declined")).alias("refused"))
    cost = spans.agg(F.sum(F.when(F.col("kind") == "llm", F.col("cost_usd")).otherwise(0.0)).alias("answer_cost"), F.sum(F.when(F.col("kind") == "judge", F.col("cost_usd")).otherwise(0.0)).alias("judge_cost"), F.count_if(F.col("kind") == "llm").alias("answers"))
    both = sums.crossJoin(F.broadcast(cost))  # one row each
    rate = lambda key, a, b: F.struct(F.lit(key).alias("key"), F.try_divide(a, b).alias("value"))
    c = F.col
    found = F.array(
        rate("groundedness_supported", c("supported"), c("claims")), rate("groundedness_overreach", c("overreach"), c("claims")), rate("groundedness_unsupported", c("unsupported"), c("claims")),
        rate("refusal_rate", c("refused"), c("expected")), rate("cost_per_answer", c("answer_cost"), c("answers")), rate("cost_per_eval", c("answer_cost") + c("judge_cost"), c("evaluated")),
    )
    return both.select(F.explode(found).alias("x")).select("x.key", "x.value").where("value is not null")


def failed(checks: DataFrame) -> DataFrame:
    return checks.where("status = 'regressed'")


def baseline_rows(observed: DataFrame, thresholds: DataFrame, runs: int = 1) -> DataFrame:
    """New thresholds of observed values: value, tolerance and direction carried over, the rest by default."""
    kept = thresholds.select("key", "name", "tolerance", "direction", "note", "unit", "sampled")
    rows = observed.select("key", F.bround("value", 6).alias("value")).join(kept, "key", "left")
    empty = {"name": F.col("key"), "tolerance": F.lit(0.0), "direction": F.lit("higher_is_better"), "note": F.lit(""), "unit": F.lit("ratio"), "sampled": F.lit(False)}
    return rows.select("key", "value", *[F.coalesce(c, d).alias(c) for c, d in empty.items()], F.lit(runs).alias("baseline_runs"))


def baseline_json(rows: DataFrame, recorded_at: str, reason: str, judge_model: str = "") -> DataFrame:
    """One row ``json``: the file's object, a metric a key.  Metrics are the bounded few of a suite."""
    if not reason.strip():
        raise ValueError("a new baseline needs a reason")
    entry = F.struct(*[c for c in rows.columns if c != "key"])
    metrics = rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", entry.alias("entry"))))).alias("metrics"))
    return metrics.select(F.to_json(F.struct(F.lit(recorded_at).alias("recorded_at"), F.lit(reason).alias("reason"), F.lit(judge_model).alias("judge_model"), "metrics")).alias("json"))


def rebaseline(observed: DataFrame, checks: DataFrame, thresholds: DataFrame, path: str, recorded_at: str, reason: str, runs: int = 1, force: bool = False) -> None:
    """Write a new baseline; refused while a check fails, unless forced."""
    if not force and failed(checks).take(1):
        raise RuntimeError("no new baseline while a check fails")
    baseline_json(baseline_rows(observed, thresholds, runs), recorded_at, reason).coalesce(1).write.mode("overwrite").text(path)


def summary_json(metrics: DataFrame, k: int) -> DataFrame:
    """One row ``json`` of :func:`ledgerloom.operators.evaluation.metrics`: recall, mrr and recall by category."""
    whole = F.max(F.when(F.col("category").isNull(), F.struct("recall", "mrr", "declined"))).alias("w")
    by = F.array_sort(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("category", F.bround("recall", 6).alias("recall")))))
    rows = metrics.agg(whole, F.map_from_entries(by).alias("by_category"))
    return rows.select(F.to_json(F.struct(F.lit(k).alias("k"), F.bround("w.recall", 6).alias("recall"), F.bround("w.mrr", 6).alias("mrr"), "by_category", F.col("w.declined").alias("negatives_declined"))).alias("json"))
