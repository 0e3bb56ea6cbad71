"""Text as column expressions: tokens, vectors, citations, sentences, quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for retrieval.
STOPWORDS = (
    "a an and are as at be by for from has have in is it its of on or that the to was were will with "
    "what which who whom how why when where do does did our we you your this these those"
).split()
#: The words of the small deterministic embedding.
VOCABULARY = "tls vendor claims gateway compliance legal signoff callback pilot rollout migration policy auth partner architecture decision timeline quarter review dashboard".split()
TOKEN = r"[A-Za-z0-9][A-Za-z0-9._-]*"


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order, without stop words; identifiers such as ``INS-101`` stay whole."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1)), F.lower)
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero or missing."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def bag_vector(text: Column, vocabulary=VOCABULARY) -> Column:
    """Unit vector of the vocabulary's counts; zeros for a text that holds none of it."""
    words = F.array(*[F.lit(w) for w in vocabulary])
    zeros = F.array_repeat(F.lit(0.0), len(vocabulary))
    add = lambda counts, t: F.when(F.array_contains(words, t), F.zip_with(counts, words, lambda c, w: F.when(w == t, c + 1).otherwise(c))).otherwise(counts)
    # The length is the one element of an array, so that it is summed once a text and not once a word of the vocabulary.
    length = lambda counts: F.array(F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x)))
    unit = lambda counts: F.get(F.transform(length(counts), lambda n: F.transform(counts, lambda c: F.coalesce(F.try_divide(c, n), F.lit(0.0)))), F.lit(0))
    return F.aggregate(tokens(text), zeros, add, unit)


def citations(text: Column) -> Column:
    """All ``[n]`` as numbers, in order; one too large for an integer is the largest, so still out of range."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: F.coalesce(x.try_cast("int"), F.lit(2**31 - 1)))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def words(text: Column) -> Column:
    """Number of words; 0 for blank texts."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def normal_quote(text: Column) -> Column:
    """Layout aside: literal ``\\n`` and ``\\t``, pipes and runs of white space are one space; lower case."""
    plain = F.replace(F.replace(text, F.lit("\\n"), F.lit(" ")), F.lit("\\t"), F.lit(" "))
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(plain, r"\|+", " "), r"(?U)\s+", " ")))


def quote_present(quote: Column, source: Column) -> Column:
    """Every fragment between ellipses occurs in the source, each after the one before."""
    fragments = F.filter(F.split(quote, r"\s*(?:\[\.\.\.\]|\.\.\.|…)\s*"), lambda f: F.trim(f) != "")
    hay = normal_quote(source)
    found = lambda at, f: F.call_function("locate", normal_quote(f), hay, at + 1)
    step = lambda at, f: F.when(at < 0, at).when(found(at, f) > 0, found(at, f) - 1 + F.length(normal_quote(f))).otherwise(F.lit(-1))
    end = F.aggregate(fragments, F.lit(0), step)
    return (F.size(fragments) > 0) & (end >= 0)


def lenient_json(text: Column) -> Column:
    """The object in a reply, fences and prose around it aside; null if there is none."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    whole = F.try_parse_json(bare)
    inner = F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.when(is_object(whole), whole).when(is_object(inner), inner)


#: Phrasings that decline for want of evidence.
REFUSAL = (
    r"(?i)(?:presupposes|(?:context|passages?|sources?|documentation|material)\s+(?:do(?:es)?\s+not|provide[sd]?\s+no|contain[s]?\s+no)"
    r"|do(?:es)?\s+not\s+(?:support|contain|address|mention)\s+(?:this|that|the)|no\s+(?:evidence|record|mention|information)\s+(?:of|for|in|that)"
    r"|not\s+enough\s+information|cannot\s+(?:find|determine|answer)|no\s+such\s+(?:exception|record|item|approval)\s)"
)


def declines(text: Column) -> Column:
    return text.rlike(REFUSAL)


#: Questions about an action, and requests for one.
INTERROGATIVE = r"^(who|whom|whose|what|which|why|when|where|how)\b"
WRITES = (r"\bflag\b", r"\bescalate\b", r"\b(mark|label|tag|raise)\b.{0,40}\bat[-\s]?risk\b", r"\bcomment\s+on\b", r"\b(add|leave|post|write)\b.{0,25}\b(comment|note)\b")


def write_intent(text: Column) -> Column:
    """The text asks for a change that can be proposed."""
    said = F.lower(F.trim(text))
    wants = F.lit(False)
    for pattern in WRITES:
        wants = wants | said.rlike(pattern)
    return F.coalesce(~said.rlike(INTERROGATIVE) & wants, F.lit(False))
