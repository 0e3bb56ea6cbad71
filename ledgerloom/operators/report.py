"""Report aggregates over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LEVELS
from .ranks import running_sum


def level_rank(level: Column) -> Column:
    out = F.lit(len(LEVELS))
    for k, name in reversed(list(enumerate(LEVELS))):
        out = F.when(level == name, k).otherwise(out)
    return out


def by_level(findings: DataFrame) -> DataFrame:
    """Findings and issues of each level that has any, in order of level."""
    n = findings.groupBy("level").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("issue_key").alias("issues"))
    return n.withColumn("level_rank", level_rank(F.col("level"))).orderBy("level_rank")


def sections(findings: DataFrame) -> DataFrame:
    """A report's lists: every finding with its level's rank and its ``position`` in it, by issue and rule; levels without any are left out.

    Positions are counted by ranges, so a level that has most findings is neither one array nor one task.
    """
    rows = running_sum(findings.withColumn("level_rank", level_rank(F.col("level"))), ["level_rank"], ["issue_key", "rule_ordinal"], F.lit(1), "position")
    return rows.select("level_rank", "level", "position", "issue_key", "project_key", "rule_id", "detail", "citations")


def rule_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))


def level_counts(findings: DataFrame) -> DataFrame:
    """Every level, with zero where there is none."""
    levels = findings.sparkSession.createDataFrame([(x,) for x in LEVELS], "level string")
    n = findings.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(levels).join(n, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("findings"))


def worst(findings: DataFrame) -> DataFrame:
    """The first finding of the highest level, by issue and rule order: one row."""
    order = F.struct(level_rank(F.col("level")).alias("r"), F.col("issue_key"), F.col("rule_ordinal"))
    return findings.agg(F.min_by(F.struct("issue_key", "rule_id", "level"), order).alias("x")).select("x.*")


def without_findings(issues: DataFrame, findings: DataFrame) -> DataFrame:
    return issues.join(findings.select(F.col("issue_key").alias("key")), "key", "left_anti")


def select_findings(findings: DataFrame, key: str | None = None, level: str | None = None) -> DataFrame:
    """Findings of an issue (upper-cased) and of a level (lower-cased), where given."""
    if key:
        findings = findings.where(F.col("issue_key") == key.strip().upper())
    if level:
        findings = findings.where(F.col("level") == level.strip().lower())
    return findings


def coverage(findings: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues and findings of each project, projects without findings too."""
    seen = issues.groupBy("project_key").agg(F.count(F.lit(1)).alias("issues"))
    n = findings.groupBy("project_key").agg(F.count(F.lit(1)).alias("findings"))
    return seen.join(n, "project_key", "left").select("project_key", "issues", F.coalesce("findings", F.lit(0)).alias("findings"))


def findings_text(findings: DataFrame) -> DataFrame:
    """``issue_key, text``: one line a finding, ``[LEVEL] KEY (rule): detail``."""
    line = F.concat(F.lit("["), F.upper("level"), F.lit("] "), F.col("issue_key"), F.lit(" ("), F.col("rule_id"), F.lit("): "), F.col("detail"))
    lines = findings.groupBy("issue_key").agg(F.array_sort(F.collect_list(F.struct("rule_ordinal", line.alias("t")))).alias("x"))  # at most one a rule
    return lines.select("issue_key", F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("text"))
