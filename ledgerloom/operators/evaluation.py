"""Retrieval metrics, verdict rates, calibration, and threshold checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBLEMS = ("overreach", "miscited", "unsupported")
VERDICTS = ("supported", "overreach", "miscited", "unsupported", "unjudged")


def case_results(cases: DataFrame) -> DataFrame:
    """``cases`` (``relevant``, ``retrieved``, ``forbidden`` arrays of page ids) with hit, reciprocal_rank, contamination."""
    first = F.array_min(F.filter(F.transform("relevant", lambda r: F.array_position("retrieved", r)), lambda p: p > 0))
    return cases.withColumns(
        {
            "hit": first.isNotNull(),
            "reciprocal_rank": F.coalesce(F.lit(1.0) / first, F.lit(0.0)),
            "all_hit": (F.size("relevant") > 0) & F.forall("relevant", lambda r: F.array_contains("retrieved", r)),
            "contamination": F.filter("retrieved", lambda p: F.array_contains("forbidden", p)),
        }
    )


def metrics(results: DataFrame) -> DataFrame:
    """Overall (null category) and by category; 0 on no cases."""
    any_hit = F.avg(F.col("hit").cast("int"))
    kinds = results.groupingSets([[], ["category"]], "category")
    return kinds.agg(
        F.count(F.lit(1)).alias("cases"), F.coalesce(any_hit, F.lit(0.0)).alias("recall"), F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"),
        F.avg(F.when(F.size("relevant") > 0, F.col("hit").cast("int"))).alias("recall_answerable"),
        F.coalesce(F.avg(F.col("all_hit").cast("int")), F.lit(0.0)).alias("recall_all"), F.count_if(F.size("contamination") > 0).alias("contaminated"),
        F.count_if((F.size("relevant") == 0) & (F.size("retrieved") == 0)).alias("declined"),
    )


def verdict_rates(verdicts: DataFrame) -> DataFrame:
    """One row: counts and rates; traceable is supported or miscited."""
    n = F.count(F.lit(1))
    rate = lambda *v: F.coalesce(F.try_divide(F.count_if(F.col("verdict").isin(*v)), n), F.lit(0.0))
    return verdicts.agg(n.alias("claims"), *[rate(v).alias(f"{v}_rate") for v in VERDICTS], rate("supported", "miscited").alias("traceable_rate"))


def calibration(rows: DataFrame) -> DataFrame:
    """One row of ``expected, got``: exact agreement, and agreement on problem or not."""
    agree = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    return rows.agg(F.count(F.lit(1)).alias("cases"), agree(F.col("expected") == F.col("got")).alias("exact"), agree(F.col("expected").isin(*PROBLEMS) == F.col("got").isin(*PROBLEMS)).alias("detection"))


def calibration_by_label(rows: DataFrame) -> DataFrame:
    return rows.groupBy("expected").agg(F.count(F.lit(1)).alias("cases"), F.avg((F.col("expected") == F.col("got")).cast("int")).alias("agreement"))


def dangerous_misses(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("expected").isin(*PROBLEMS) & ~F.col("got").isin(*PROBLEMS))


def second_pass(first: DataFrame, second: DataFrame) -> DataFrame:
    """Unsupported claims that another passage supports become miscited.

    ``first``: ``claim_id, verdict, cited, passages``; ``second``: ``claim_id, verdict``
    over all passages.  Claims that cited every passage are not asked again.
    """
    asked = (F.col("verdict") == "unsupported") & (F.col("cited") < F.col("passages"))
    joined = first.join(second.select("claim_id", F.col("verdict").alias("again")), "claim_id", "left")
    return joined.withColumn("verdict", F.when(asked & (F.col("again") == "supported"), "miscited").otherwise(F.col("verdict"))).drop("again")


#: Key, name, baseline, tolerance, direction, unit, sampled; the note is left to whoever records a baseline.
THRESHOLDS = (
    ("recall_at_5", "recall@5", 0.625, 0.0, "higher_is_better", "ratio", False, ""),
    ("cross_source_recall", "cross-source recall", 1.0, 0.0, "higher_is_better", "ratio", False, ""),
    ("identifier_recall", "identifier recall", 1.0, 0.0, "higher_is_better", "ratio", False, ""),
    ("groundedness_supported", "supported claims", 0.89, 0.08, "higher_is_better", "ratio", True, ""),
    ("groundedness_overreach", "overreach", 0.07, 0.05, "lower_is_better", "ratio", True, ""),
    ("groundedness_unsupported", "unsupported", 0.02, 0.03, "lower_is_better", "ratio", True, ""),
    ("refusal_rate", "refusal on unanswerable", 1.0, 0.0, "higher_is_better", "ratio", False, ""),
    ("cost_per_answer", "cost per answer", 0.008, 0.004, "lower_is_better", "usd", True, ""),
    ("cost_per_eval", "cost per evaluated question", 0.030, 0.015, "lower_is_better", "usd", True, ""),
)
THRESHOLD_SCHEMA = "key string, name string, baseline double, tolerance double, direction string, unit string, sampled boolean, note string, baseline_runs int"


def default_thresholds(spark) -> DataFrame:
    return spark.createDataFrame([(*row, 1) for row in THRESHOLDS], THRESHOLD_SCHEMA)


def overlay(recorded: DataFrame, defaults: DataFrame) -> DataFrame:
    """Recorded thresholds over the defaults, field by field; either side may lack a key."""
    names = [c for c in defaults.columns if c != "key"]
    both = recorded.select("key", *[F.col(c).alias(f"r_{c}") for c in names]).join(defaults, "key", "full")
    empty = {"name": F.col("key"), "tolerance": F.lit(0.0), "direction": F.lit("higher_is_better"), "unit": F.lit("ratio"), "sampled": F.lit(False), "note": F.lit(""), "baseline_runs": F.lit(1), "baseline": F.lit(None)}
    return both.select("key", *[F.coalesce(f"r_{c}", c, empty[c]).alias(c) for c in names])


def effective_tolerance(runs):
    """Wider by ``sqrt(baseline_runs / runs)`` for sampled metrics checked with fewer runs."""
    fewer = F.col("sampled") & (runs >= 1) & (runs < F.col("baseline_runs"))
    return F.when(fewer, F.col("tolerance") * F.sqrt(F.col("baseline_runs") / runs)).otherwise(F.col("tolerance"))


def check(observed: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``key, value, runs`` against thresholds: ``status`` is pass, improved, regressed or skipped (no threshold)."""
    rows = observed.join(thresholds, "key", "left").withColumn("effective", effective_tolerance(F.col("runs"))).withColumn("delta", F.col("value") - F.col("baseline"))
    worse = F.when(F.col("direction") == "higher_is_better", F.col("delta") < -F.col("effective")).otherwise(F.col("delta") > F.col("effective"))
    status = F.when(F.col("name").isNull(), "skipped").when(worse, "regressed").when(F.abs("delta") > F.col("effective"), "improved").otherwise("pass")
    return rows.withColumn("status", status)


def spread(runs: DataFrame) -> DataFrame:
    """``key``: least, greatest and swing over runs of ``key, value``."""
    return runs.groupBy("key").agg(F.min("value").alias("least"), F.max("value").alias("greatest"), (F.max("value") - F.min("value")).alias("swing"))
