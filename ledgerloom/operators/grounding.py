"""Whether statements in generated text trace to cited passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citations, declines, lenient_json, paragraphs, quote_present, sentences, words

LEAD_IN_WORDS, EXEMPT_WORDS, CLAIM_WORDS = 25, 6, 4
#: Fixed value: what a model says when it declines.
MARKER = "INSUFFICIENT_EVIDENCE"
#: Markdown that is structure, not a claim.
STRUCTURE = r"^(?:#{1,6}\s|\|.*\||-{3,}$|\*{2,}$|\d+\.$|[-*+]$|\*\*[^*]+:\*\*$)"


def _claim_text(unit):
    lines = F.filter(F.transform(F.split(unit, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(STRUCTURE))
    return F.array_join(lines, " ")


def sentence_units(text):
    """Sentences, with citations that open one given back to the one before."""
    lead = r"^((?:\[\d+\]\s*)+)"
    empty = F.array().cast("array<string>")

    def step(done, part):
        head, rest = F.trim(F.regexp_extract(part, lead, 1)), F.trim(F.regexp_replace(part, lead, ""))
        back = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(" "), head)))
        back = F.when(rest != "", F.concat(back, F.array(rest))).otherwise(back)
        return F.when((head != "") & (F.size(done) > 0), back).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(sentences(text), empty, step)


def units(answers: DataFrame, per_sentence: bool = False) -> DataFrame:
    """``answer_id, pos, unit, cited, uncited``: paragraphs (or sentences) and whether each lacks a citation it needs."""
    parts = sentence_units(F.coalesce(F.col("text"), F.lit(""))) if per_sentence else paragraphs(F.col("text"))
    rows = answers.select("answer_id", "passages", F.posexplode(parts).alias("pos", "unit")).withColumn("cited", F.size(citations(F.col("unit"))) > 0)
    after = Window.partitionBy("answer_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    later = F.coalesce(F.max(F.col("cited").cast("int")).over(after), F.lit(0)) == 1
    prose = _claim_text(F.col("unit"))
    lead_in = F.lit(not per_sentence) & (words(F.col("unit")) <= LEAD_IN_WORDS) & later
    exempt = F.col("cited") | lead_in | (words(prose) <= EXEMPT_WORDS) | F.rtrim(prose).endswith(":")
    return rows.withColumn("uncited", ~exempt)


def check(answers: DataFrame, per_sentence: bool = False) -> DataFrame:
    """``answers`` (``answer_id, text, passages``) with cited indices, those out of range, uncited units and ``grounded``."""
    bad = units(answers, per_sentence).groupBy("answer_id").agg(F.count_if("uncited").alias("uncited_units"))
    cited = F.array_sort(F.array_distinct(citations(F.col("text"))))
    out = answers.join(bad, "answer_id", "left").withColumn("cited", cited).withColumn("uncited_units", F.coalesce("uncited_units", F.lit(0)))
    out = out.withColumn("out_of_range", F.filter("cited", lambda k: (k < 1) | (k > F.col("passages"))))
    return out.withColumn("grounded", (F.size("out_of_range") == 0) & (F.col("uncited_units") == 0))


def outcome(checked: DataFrame) -> DataFrame:
    """Adds ``outcome``: an answer, or why there is none; the text of a failed answer is withheld."""
    kind = F.when(F.col("passages") == 0, "no_context_retrieved").when(F.col("text").contains(MARKER), "model_declined")
    kind = kind.when(~F.col("grounded") & declines(F.col("text")), "model_declined_without_marker").when(~F.col("grounded"), "failed_grounding_check").otherwise("answered")
    return checked.withColumn("outcome", kind).withColumn("shown", F.when(F.col("outcome") == "answered", F.col("text")))


def claims(answers: DataFrame) -> DataFrame:
    """``answer_id, par, pos, claim, indices``: cited sentences; one without a citation takes its paragraph's."""
    pars = answers.select("answer_id", F.posexplode(paragraphs(F.col("text"))).alias("par", "p"))
    rows = pars.select("answer_id", "par", citations(F.col("p")).alias("of_par"), F.posexplode(sentences(F.col("p"))).alias("pos", "s"))
    own = citations(F.col("s"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col("s"), r"\[\d+\]", ""), r"^[ \-*|]+|[ \-*|]+$", ""))
    rows = rows.select("answer_id", "par", "pos", text.alias("claim"), F.array_sort(F.array_distinct(F.when(F.size(own) > 0, own).otherwise(F.col("of_par")))).alias("indices"))
    return rows.where((words(F.col("claim")) >= CLAIM_WORDS) & (F.size("indices") > 0))


def cited_passages(claim_rows: DataFrame, passages: DataFrame) -> DataFrame:
    """Each claim with the passages (``answer_id, position, text``) that it cites; a missing one has a null text."""
    each = claim_rows.withColumn("position", F.explode("indices"))
    return each.join(passages, ["answer_id", "position"], "left")


def judged(replies: DataFrame) -> DataFrame:
    """``claim_id, reply, source, in_range`` -> verdict: replies out of range, unreadable, or with a quote that the source lacks do not stand."""
    said = lenient_json(F.col("reply"))
    verdict, quote = F.lower(F.trim(F.try_variant_get(said, "$.verdict", "string"))), F.trim(F.coalesce(F.try_variant_get(said, "$.evidence", "string"), F.lit("")))
    known = verdict.isin("supported", "overreach", "miscited", "unsupported", "unjudged")
    stands = F.when(~F.col("in_range"), "unsupported").when(said.isNull() | ~F.coalesce(known, F.lit(False)), "unjudged")
    stands = stands.when((verdict == "supported") & (quote != "") & ~F.coalesce(quote_present(quote, F.col("source")), F.lit(False)), "unjudged").otherwise(verdict)
    return replies.withColumn("verdict", stands).withColumn("evidence", quote)


def blocker_class(replies: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """``issue_key, reply, source`` -> category; without a verbatim quote of a known category it is unknown, with a reason."""
    said = lenient_json(F.col("reply"))
    kind, quote = F.lower(F.try_variant_get(said, "$.category", "string")), F.try_variant_get(said, "$.evidence", "string")
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    why = F.when(F.trim(F.coalesce("source", F.lit(""))) == "", "no text").when(said.isNull(), "unparseable reply").when(~F.coalesce(kind.isin(*categories), F.lit(False)), "unknown category")
    why = why.when(F.coalesce(F.trim(quote), F.lit("")) == "", "no quote").when(~plain(F.col("source")).contains(plain(quote)), "quote not in text")
    return replies.withColumn("rejected_reason", why).withColumn("category", F.when(why.isNull(), kind).otherwise("unknown"))


def context(passages: DataFrame) -> DataFrame:
    """``answer_id, context``: numbered passages of an answer, a bounded few."""
    lists = passages.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("position", "label", "text"))).alias("x"))
    block = lambda p: F.concat(F.lit("["), p["position"].cast("string"), F.lit("] "), p["label"], F.lit("\n"), p["text"])
    return lists.select("answer_id", F.array_join(F.transform("x", block), "\n\n---\n\n").alias("context"))
