"""Risk rules as column expressions over nested issue records.

A rule is a function ``(RiskConfig, now) -> Column`` that gives a finding struct or
NULL.  All rules of a row are evaluated in one pass: no join, no shuffle, no UDF,
so a table of any size costs one scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CITATION

Rule = Callable[["RiskConfig", Column], Column]


@dataclass(frozen=True)
class RiskConfig:
    """Thresholds of the rules. The defaults are fixed values."""

    stale_days_medium: int = 7
    stale_days_high: int = 14
    sprint_carryover_high: int = 2
    listed_links: int = 5
    base_url: str = "https://issues.example.com"
    reported_link_types: tuple[str, ...] = ("blocks", "depends_on")
    blocked_status_names: tuple[str, ...] = ("blocked", "on hold", "impediment", "impeded", "waiting", "waiting for customer", "waiting for support", "waiting for approval", "pending")


def elapsed_days(since: Column, until: Column) -> Column:
    """Whole periods of 24 hours, rounded down."""
    return F.floor((F.unix_micros(until) - F.unix_micros(since)) / F.lit(86_400_000_000)).cast("long")


def last_activity() -> Column:
    """Latest of creation, comments and changes; the ``updated_at`` field is ignored on purpose."""
    return F.greatest("created_at", F.array_max(F.transform("comments", lambda c: c["created_at"])), F.array_max(F.transform("changelog", lambda c: c["at"])))


def sprint_moves() -> Column:
    return F.filter("changelog", lambda c: F.lower(c["field"]).isin("sprint", "sprints"))


def current_sprint() -> Column:
    """Target of the latest sprint move; the first of equal times, blank as null."""
    latest = F.array_max(F.transform(sprint_moves(), lambda c, i: F.struct(c["at"].alias("at"), (-i).alias("back"), F.trim(c["to_value"]).alias("to"))))
    return F.when(latest["to"] != "", latest["to"])


def normal_status(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")))


def quoted(text: Column) -> Column:
    """Single quotes, or double ones around a text that holds single ones only."""
    double = text.contains("'") & ~text.contains('"')
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _cite(cfg: RiskConfig, key: Column, excerpt: Column) -> Column:
    return F.struct(F.lit("issue").alias("source_type"), key.alias("source_id"), F.concat(F.lit(f"{cfg.base_url}/browse/"), key).alias("url"), excerpt.cast("string").alias("excerpt"))


def _finding(rule_id: str, level: Column, detail: Column, citations: Column) -> Column:
    return F.struct(F.lit(rule_id).alias("rule_id"), level.alias("level"), detail.alias("detail"), citations.cast(f"array<{CITATION}>").alias("citations"))


def _self(cfg: RiskConfig, summary: bool = False) -> Column:
    return F.array(_cite(cfg, F.col("key"), F.col("summary") if summary else F.lit(None)))


def _open() -> Column:
    return ~F.col("status_category").eqNullSafe("done")


def _unresolved(cfg: RiskConfig, link: Column) -> Column:
    return link["link_type"].isin(*cfg.reported_link_types) & ~link["target_status_category"].eqNullSafe("done")


def stale_in_progress(cfg: RiskConfig, now: Column) -> Column:
    idle = elapsed_days(last_activity(), now)
    level = F.when(idle >= cfg.stale_days_high, "high").when(idle >= cfg.stale_days_medium, "medium")
    who = F.coalesce(F.when(F.col("assignee_id") != "", F.col("assignee_id")), F.lit("unassigned"))
    detail = F.concat(F.col("status_name"), F.lit(" with no comments, transitions, or updates for "), idle.cast("string"), F.lit(" days (assignee: "), who, F.lit(")."))
    return F.when((F.col("status_category") == "in_progress") & level.isNotNull(), _finding("stale_in_progress", level, detail, _self(cfg, True)))


def missing_target_release(cfg: RiskConfig, now: Column) -> Column:
    detail = F.lit("No Target Release set — this issue is excluded from delivery-date reporting and its slip risk cannot be assessed.")
    return F.when(_open() & (F.coalesce("target_release", F.lit("")) == ""), _finding("missing_target_release", F.lit("medium"), detail, _self(cfg)))


def sprint_carryover(cfg: RiskConfig, now: Column) -> Column:
    moves = F.size(sprint_moves())
    sprint = F.coalesce(F.when(F.col("sprint_name") != "", F.col("sprint_name")), F.lit("no sprint"))
    detail = F.concat(F.lit("Carried over "), moves.cast("string"), F.lit(" times between sprints (currently: "), sprint, F.lit(")."))
    return F.when(moves >= cfg.sprint_carryover_high, _finding("sprint_carryover", F.lit("high"), detail, _self(cfg)))


def overdue(cfg: RiskConfig, now: Column) -> Column:
    detail = F.concat(F.lit("Past due date by "), elapsed_days(F.col("due_date"), now).cast("string"), F.lit(" days."))
    return F.when(_open() & (F.col("due_date") < now), _finding("overdue", F.lit("high"), detail, _self(cfg)))


def blocked_dependency(cfg: RiskConfig, now: Column) -> Column:
    unresolved = F.filter("links", lambda x: _unresolved(cfg, x))
    blocking = F.filter(unresolved, lambda x: x["target_blocks_this"])
    any_blocking = F.size(blocking) > 0
    reported = F.array_sort(F.transform(F.when(any_blocking, blocking).otherwise(unresolved), lambda x: F.struct(x["target_key"].alias("k"), x["target_status_category"].alias("c"), x["target_summary"].alias("s"))))
    n = F.size(reported)
    names = F.transform(F.slice(reported, 1, cfg.listed_links), lambda x: F.concat(x["k"], F.lit(" ("), F.coalesce(x["c"], F.lit("status unknown")), F.lit(")")))
    more = F.when(n > cfg.listed_links, F.concat(F.lit(", +"), (n - cfg.listed_links).cast("string"), F.lit(" more"))).otherwise("")
    what = F.concat(n.cast("string"), F.when(n == 1, " unresolved issue: ").otherwise(" unresolved issues: "), F.array_join(names, ", "), more, F.lit("."))
    detail = F.concat(F.when(any_blocking, "Blocked by ").otherwise("Linked to "), what)
    links = F.transform(reported, lambda x: _cite(cfg, x["k"], x["s"]))
    return F.when(_open() & (n > 0), _finding("blocked_dependency", F.when(any_blocking, "high").otherwise("medium"), detail, F.concat(_self(cfg, True).cast(f"array<{CITATION}>"), links.cast(f"array<{CITATION}>"))))


def blocked_status(cfg: RiskConfig, now: Column) -> Column:
    covered = F.exists("links", lambda x: x["target_blocks_this"] & _unresolved(cfg, x))
    detail = F.concat(F.lit("Status is "), quoted(F.col("status_name")), F.lit(", but no blocking issue is linked — so what it is waiting on is not recorded anywhere, and the dependency cannot be chased or dated."))
    return F.when(_open() & normal_status(F.col("status_name")).isin(*cfg.blocked_status_names) & ~F.coalesce(covered, F.lit(False)), _finding("blocked_status", F.lit("medium"), detail, _self(cfg, True)))


ALL_RULES: tuple[Rule, ...] = (stale_in_progress, missing_target_release, sprint_carryover, overdue, blocked_dependency, blocked_status)


def evaluate(issues: DataFrame, cfg: RiskConfig | None = None, now: Column | None = None, rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
    """``issue_key, project_key, rule_ordinal, rule_id, level, detail, citations``: one row per finding.

    Further rules are further callables in ``rules``; their order is the order of findings.
    """
    cfg, now = cfg or RiskConfig(), F.current_timestamp() if now is None else now
    # The array is a column of its own, so that generated code evaluates what rules share once a row.
    found = F.array(*[F.struct(F.lit(k).alias("rule_ordinal"), rule(cfg, now).alias("f")) for k, rule in enumerate(rules)])
    rows = issues.select("key", "project_key", found.alias("found"))
    one = rows.select("key", "project_key", F.explode(F.filter("found", lambda x: x["f"].isNotNull())).alias("x"))
    return one.select(F.col("key").alias("issue_key"), "project_key", "x.rule_ordinal", "x.f.rule_id", "x.f.level", "x.f.detail", "x.f.citations")
