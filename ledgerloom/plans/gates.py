"""Completeness as a type, and approvals as an append-only log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import report
from ..operators.ranks import numbered
from ..sources.ingest import failure_reason

_TOKEN = object()


class Incomplete(RuntimeError):
    """A report was asked of data with gaps."""


@dataclass(frozen=True)
class CompleteRun:
    """Findings of a run without gaps; only :func:`seal` makes one."""

    findings: DataFrame
    issues_seen: int
    token: object = None

    def __post_init__(self):
        if self.token is not _TOKEN:
            raise TypeError("a CompleteRun comes from seal() alone")


@dataclass(frozen=True)
class PartialRun:
    """What is known of a run with gaps; it has no findings to report from."""

    gaps: DataFrame
    issues_seen: int


def seal(findings: DataFrame, gaps: DataFrame, issues_seen: int) -> CompleteRun | PartialRun:
    """Settle a run: the gaps table is read now, since what is lazy cannot be known complete."""
    return PartialRun(gaps, issues_seen) if gaps.take(1) else CompleteRun(findings, issues_seen, _TOKEN)


def build_report(run: CompleteRun) -> dict[str, DataFrame]:
    if not isinstance(run, CompleteRun):
        raise Incomplete("a report needs a complete run")
    return {"sections": report.by_level(run.findings), "rules": report.rule_counts(run.findings), "worst": report.worst(run.findings)}


def project_status(requested: DataFrame, covered: DataFrame, gaps: DataFrame) -> DataFrame:
    """``project_key, status, reason``: complete, or partial with the first gap's reason."""
    first = gaps.groupBy(F.col("scope").alias("project_key")).agg(F.min_by("reason", "seq").alias("reason"))
    rows = requested.join(covered.withColumn("__c", F.lit(True)), "project_key", "left").join(first, "project_key", "left")
    partial = F.col("__c").isNull() | F.col("reason").isNotNull()
    return rows.select("project_key", F.when(partial, "partial").otherwise("complete").alias("status"), F.when(partial, F.coalesce("reason", F.lit("aborted"))).alias("reason"))


def submit(payload: dict) -> dict:
    """A proposal needs a citation."""
    if not payload.get("citations"):
        raise ValueError("a proposal needs at least one citation")
    return payload | {"act": "submitted"}


def decide(latest: dict | None, actor: str, act: str) -> dict:
    """An event for a pending proposal; approving needs a named actor."""
    if act not in ("approved", "rejected"):
        raise ValueError(f"unknown decision {act!r}")
    if latest is None or latest.get("act") != "submitted":
        raise KeyError("no pending proposal of that id")
    if act == "approved" and not (actor or "").strip():
        raise ValueError("an approval needs an actor")
    return {"proposal_id": latest["proposal_id"], "act": act, "actor": actor}


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each proposal, by ``seq``."""
    w = Window.partitionBy("proposal_id").orderBy(F.desc("seq"))
    return events.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def recent(events: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` events, oldest first."""
    return events.orderBy(F.desc("seq")).limit(n).orderBy("seq")


def outbox(state: DataFrame, dry_run: bool = True) -> DataFrame:
    """Approved actions to be written outside, once each; a dry run writes none."""
    return state.where("act = 'approved'").select("proposal_id", "issue_key", "action_type", F.lit(not dry_run).alias("written"))


def submitted(proposals: DataFrame, order: str, first: int = 1) -> tuple[DataFrame, DataFrame]:
    """(events, refused): proposals with ids in order of ``order``, nulls last; those without a citation are refused."""
    cited = F.coalesce(F.size("citations"), F.lit(0)) > 0
    good = numbered(proposals.where(cited), order, "seq").withColumn("seq", F.col("seq") + (first - 1))
    return good.withColumn("proposal_id", F.format_string("prop_%04d", "seq")).withColumn("act", F.lit("submitted")), proposals.where(~cited)


def decided(decisions: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, conflicts): decisions (``proposal_id, seq, act, actor``) met with the proposals' latest state.

    The first decision of a pending proposal stands, an approval only with a named
    actor; all others are conflicts, with a reason.
    """
    pending = state.select("proposal_id", F.col("act").alias("was"), "issue_key", "action_type")
    named = (F.col("act") != "approved") | (F.trim(F.coalesce("actor", F.lit(""))) != "")
    rows = decisions.withColumn("valid", named & F.col("act").isin("approved", "rejected"))
    turn = F.row_number().over(Window.partitionBy("proposal_id", "valid").orderBy("seq"))
    met = rows.withColumn("turn", turn).join(pending, "proposal_id", "left")
    why = F.when(~F.col("valid"), "no named actor").when(F.coalesce("was", F.lit("")) != "submitted", "not pending").when(F.col("turn") > 1, "already decided")
    met = met.withColumn("conflict", why).drop("valid", "turn", "was")
    return met.where("conflict is null").drop("conflict"), met.where("conflict is not null")


def applied(audit: DataFrame, results: DataFrame) -> DataFrame:
    """Audit rows with what their write came to (``proposal_id, error, written``): it belongs to the proposal's first row, the others stay.

    A result with an error has neither been applied nor written.
    """
    first = F.min("seq").over(Window.partitionBy("proposal_id")) == F.col("seq")
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    met = audit.withColumn("first", first).join(results.withColumn("done", F.lit(True)), "proposal_id", "left")
    own = F.col("first") & F.coalesce("done", F.lit(False))
    return met.select(*audit.columns, (own & ~failed).alias("applied"), F.when(own, F.col("error")).alias("apply_error"), (own & ~failed & F.coalesce("written", F.lit(False))).alias("written"))


def latest_complete(runs: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: the newest run (``run_id, finished_at``) without a gap; older snapshots stay until a complete one replaces them."""
    whole = runs.join(gaps.select("run_id").distinct(), "run_id", "left_anti")
    return whole.agg(F.max_by(F.struct("run_id", "finished_at"), F.struct("finished_at", "run_id")).alias("x")).where("x is not null").select("x.*")


def snapshot(rows: DataFrame, runs: DataFrame, gaps: DataFrame) -> DataFrame:
    """Rows of the latest complete run."""
    return rows.join(F.broadcast(latest_complete(runs, gaps).select("run_id")), "run_id", "left_semi")


def docs_load(requested: DataFrame, pages: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: ``state`` of a load of spaces: complete, partial (some space failed), or unavailable where no page came at all.

    Pages that a space gave before it failed stay.
    """
    n = pages.agg(F.count(F.lit(1)).alias("pages"))
    spaces = requested.join(failed.select("space_key").distinct().withColumn("bad", F.lit(True)), "space_key", "left").agg(F.count_if(F.col("bad").isNull()).alias("covered"), F.count_if("bad").alias("incomplete"))
    state = F.when(F.col("pages") == 0, "unavailable").when(F.col("incomplete") > 0, "partial").otherwise("complete")
    return n.crossJoin(F.broadcast(spaces)).select(state.alias("state"), "pages", "covered", "incomplete")


def recorded_gaps(failures: DataFrame, at) -> DataFrame:
    """Failures (``scope, message, seq``) as rows of the gap log, their reason read from the message."""
    return failures.select("seq", failure_reason(F.col("message")).alias("reason"), F.coalesce("scope", F.lit("sync")).alias("scope"), F.col("message").alias("detail"), at.alias("at"))
