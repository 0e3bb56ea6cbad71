"""Texts and formats that reports, logs and tools show, as column expressions.

The sentences that are shown to people and models are fixed values: their words are
the results of these operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hints that name the remedy of an incomplete run.
HINTS = {
    "permission_denied": " The service account lacks Browse Projects permission. This is fixable in Jira project settings.",
    "rate_limited": " Jira rate limits were exhausted. Retry with a smaller project set or a longer window.",
}
#: Parts of the statement that no rule matched.
NEGATIVE = (
    " None of the rules matched: it is not stale, not blocked (no blocking issue is linked to it and its status is not a blocked one), not carried over between sprints, not overdue, and not missing a delivery date."
    "\n\n\n\nThis is a definitive negative result from deterministic rules that ran successfully over a complete sync"
)
NEGATIVE_END = (
    " — not missing data. Answer with that rather than declining."
    "\n\nState the negative only for the things listed above. The rules cover delivery risk signals in Jira; they are not a judgement that the work is healthy in every other respect."
)


def _decimals(value: Column, places: int) -> Column:
    """A number's text, rounded half to even from its exact binary value."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * places))


def in_unit(value: Column, unit: Column) -> Column:
    """A metric in its own unit: dollars, seconds, or else percent."""
    percent = F.concat(_decimals(value * 100, 1), F.lit("%"))
    return F.when(unit == "usd", F.concat(F.lit("$"), _decimals(value, 4))).when(unit == "seconds", F.concat(_decimals(value, 1), F.lit("s"))).otherwise(percent)


def age(seconds: Column) -> Column:
    """How long ago, rounded half up at each step."""
    minutes = F.floor(seconds / 60 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(seconds < 90, "just now").when(minutes < 60, said(minutes, " min ago")).when(hours < 24, said(hours, " hr ago")).otherwise(said(days, " days ago"))


def as_of(at: Column) -> Column:
    return F.concat(F.lit(", as of "), F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def audit_outcome(decision: Column, applied: Column, error: Column, written: Column) -> Column:
    """What became of a decision; nothing is said of a rejected one."""
    failed = F.coalesce(error, F.lit("")) != ""
    out = F.when(decision == "rejected", "").when(failed, F.concat(F.lit(", not applied — "), error))
    out = out.when(F.coalesce(written, F.lit(False)), ", written to Jira").when(F.coalesce(applied, F.lit(False)), ", recorded — dry run, nothing written to Jira")
    return out.otherwise(", approved but not yet applied")


def operator_message(requested: Column, incomplete: Column, reason: Column) -> Column:
    """Counts, the projects that were not read in full, and a hint where there is a remedy."""
    hint = F.lit("")
    for name, text in HINTS.items():
        hint = F.when(reason == name, text).otherwise(hint)
    return F.concat(F.lit("Sync incomplete: "), F.size(incomplete).cast("string"), F.lit(" of "), F.size(requested).cast("string"), F.lit(" projects were not fully read ("), F.array_join(incomplete, ", "), F.lit(")."), hint)


def first_gaps(gaps: Column, most: int = 5) -> Column:
    """``reason on scope`` of the first gaps, and how many more there are."""
    said = F.array_join(F.transform(F.slice(gaps, 1, most), lambda g: F.concat(g["reason"], F.lit(" on "), g["scope"])), "; ")
    more = F.when(F.size(gaps) > most, F.concat(F.lit("; +"), (F.size(gaps) - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(said, more)


def newest_first(comments: Column) -> Column:
    """Bodies of comments, newest first (the first of equal times first), blank ones left out, a blank line between."""
    keyed = F.transform(comments, lambda c, i: F.struct((-F.unix_micros(c["created_at"])).alias("back"), i.alias("i"), F.trim(c["body"]).alias("body")))
    return F.array_join(F.transform(F.filter(F.array_sort(keyed), lambda c: c["body"] != ""), lambda c: c["body"]), "\n\n")


def rich_document(text: Column) -> Column:
    """Plain text as a rich-text document (JSON): a paragraph for each block between blank lines."""
    blocks = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda x: F.trim(x)), lambda p: p != "")
    paragraph = lambda p: F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), p.alias("text"))).alias("content"))
    return F.to_json(F.struct(F.lit("doc").alias("type"), F.lit(1).alias("version"), F.transform(blocks, paragraph).alias("content")))


def no_findings(scope: Column, kind: Column, at: Column) -> Column:
    """The definite answer where no rule matched: for an issue, for a level, or at all; ``at`` is when the data was read."""
    opening = F.when(kind == "issue", F.concat(F.lit("The risk engine checked "), F.upper(scope), F.lit(" and found no risk findings for it.")))
    opening = opening.when(kind == "level", F.concat(F.lit("The risk engine found no risk findings at "), F.lower(scope), F.lit(" severity."))).otherwise("The risk engine found no risk findings in the current sync.")
    return F.concat(opening, F.lit(NEGATIVE), F.coalesce(as_of(at), F.lit("")), F.lit(NEGATIVE_END))


def answers_about(asked: DataFrame, findings: DataFrame, lines: DataFrame, complete: bool = True, message: str = "") -> DataFrame:
    """``asked`` (``scope``, ``kind`` issue, ``at``) with ``content`` and ``is_error``: findings, a definite no, or that there is no answer.

    ``lines`` is one text an issue (``issue_key, text``); of an incomplete run no finding is shown.
    """
    if not complete:
        text = f"Risk findings are unavailable for this sync, so none are reported. {message} Until the sync completes, treat the risk engine as having no answer rather than as reporting nothing wrong."
        return asked.withColumn("content", F.lit(text)).withColumn("is_error", F.lit(True))
    met = asked.join(lines.withColumnRenamed("issue_key", "scope"), "scope", "left")
    return met.withColumn("content", F.coalesce("text", no_findings(F.col("scope"), F.col("kind"), F.col("at")))).drop("text").withColumn("is_error", F.lit(False))


def narrative_passages(findings: DataFrame) -> DataFrame:
    """One passage a finding, as a narrative cites it: ``label, url, text, found_by``."""
    url = F.coalesce(F.get("citations", F.lit(0))["url"], F.lit(""))
    return findings.select("issue_key", "rule_ordinal", F.concat_ws(" — ", "issue_key", "rule_id").alias("label"), url.alias("url"), F.col("detail").alias("text"), F.lit("risk_rule").alias("found_by"))


def empty_narrative(covered: Column, issues_seen: Column) -> Column:
    """What is said of a complete run without findings; no model is asked."""
    scope = F.when(F.size(covered) > 0, F.array_join(covered, ", ")).otherwise("the synced projects")
    return F.concat(F.lit("No risk findings were detected across "), scope, F.lit(" ("), issues_seen.cast("string"), F.lit(" issues checked against every rule). This is a definitive result from a complete sync, not an empty report."))
