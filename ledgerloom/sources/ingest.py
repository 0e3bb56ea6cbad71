"""Raw JSON payloads to typed tables; rows that do not map are set aside as gaps."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..operators.rules import current_sprint

_STATUS = "struct<name: string, statusCategory: struct<key: string>>"
_SIDE = f"struct<key: string, fields: struct<summary: string, status: {_STATUS}>>"
RAW_ISSUE = (
    f"struct<key: string, fields: struct<summary: string, project: struct<key: string>, status: {_STATUS}, assignee: struct<accountId: string>, created: string, updated: string, duedate: string, "
    "comment: struct<comments: array<struct<id: string, author: struct<accountId: string>, created: string, body: string>>>, "
    f"issuelinks: array<struct<type: struct<name: string, inward: string, outward: string>, inwardIssue: {_SIDE}, outwardIssue: {_SIDE}>>>, "
    "changelog: struct<histories: array<struct<created: string, author: struct<accountId: string>, items: array<struct<field: string, fromString: string, toString: string>>>>>>"
)
#: Categories, phrases that mean "the other issue blocks this one", and link aliases in order.
CATEGORIES = {"new": "todo", "indeterminate": "in_progress", "done": "done"}
BLOCKED_BY = ("is blocked by", "depends on", "is caused by", "is prevented by")
LINK_ALIASES = (("blocks", "blocks"), ("dependency", "depends_on"), ("depends", "depends_on"), ("relates", "relates_to"), ("duplicate", "duplicates"), ("cloners", "clones"))


def timestamp(text: Column) -> Column:
    """ISO timestamps with or without an offset, as UTC; null if unreadable."""
    return F.trim(text).try_cast("timestamp")


def due_date(text: Column) -> Column:
    """A plain day ends at its last second."""
    day = F.length(F.trim(text)) == 10
    return F.when(day, F.concat(F.trim(text), F.lit(" 23:59:59")).try_cast("timestamp")).otherwise(timestamp(text))


def category(key: Column, default: str | None = "todo") -> Column:
    out = F.lit(default)
    for k, v in CATEGORIES.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def link_type(name: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = F.when(low == "", "unknown").otherwise(F.replace(low, F.lit(" "), F.lit("_")))
    for part, kind in reversed(LINK_ALIASES):
        out = F.when(low.contains(part), kind).otherwise(out)
    return out


def links(raw: Column) -> Column:
    """An inward side has priority; entries without either side are dropped."""

    def one(x):
        inward = x["inwardIssue"].isNotNull()
        side = F.when(inward, x["inwardIssue"]).otherwise(x["outwardIssue"])
        phrase = F.lower(F.trim(F.when(inward, x["type"]["inward"]).otherwise(x["type"]["outward"])))
        return F.struct(side["key"].alias("target_key"), side["fields"]["summary"].alias("target_summary"), category(side["fields"]["status"]["statusCategory"]["key"], None).alias("target_status_category"), link_type(x["type"]["name"]).alias("link_type"), F.coalesce(phrase.isin(*BLOCKED_BY), F.lit(False)).alias("target_blocks_this"))

    return F.transform(F.filter(F.coalesce(raw, F.array()), lambda x: x["inwardIssue"].isNotNull() | x["outwardIssue"].isNotNull()), one)


def changes(histories: Column) -> Column:
    """Items of all histories, each with its history's time and author."""
    return F.flatten(F.transform(F.coalesce(histories, F.array()), lambda h: F.transform(F.coalesce(h["items"], F.array()), lambda i: F.struct(i["field"].alias("field"), i["fromString"].alias("from_value"), i["toString"].alias("to_value"), timestamp(h["created"]).alias("at"), h["author"]["accountId"].alias("author_id")))))


def release(raw: Column) -> Column:
    """A release field of any shape (JSON text): text, {value|name}, or a list of either; blank and others are null."""
    v = F.try_parse_json(raw)
    kind = lambda x: F.schema_of_variant(x)
    first = F.when(kind(v).startswith("ARRAY"), F.try_variant_get(v, "$[0]", "variant")).otherwise(v)
    text = F.when(kind(first) == "STRING", F.try_variant_get(first, "$", "string")).when(kind(first).startswith("OBJECT"), F.coalesce(_string(first, "$.value"), _string(first, "$.name")))
    text = F.trim(text)
    return F.when(text != "", text)


def _string(v: Column, path: str) -> Column:
    inner = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(v, path, "string"))


def rich_text(node) -> str:
    """Text nodes of a rich-text tree, depth first, joined by spaces; a plain string is itself."""
    if isinstance(node, str):
        return node
    found: list[str] = []

    def walk(x):
        if isinstance(x, dict):
            if x.get("type") == "text":
                found.append(str(x.get("text", "")))
            for child in x.get("content") or []:
                walk(child)

    walk(node)
    return " ".join(found).strip()


@F.pandas_udf(StringType())
def flatten_rich_text(raw):
    """JSON text of a rich-text body to plain text."""

    def one(x):
        if x is None:
            return ""
        try:
            return rich_text(json.loads(x))
        except ValueError:
            return x

    return raw.map(one)


def _body(x: str | None) -> str:
    """A comment's body: a tree, or a text that stays as it is."""
    if x is None or not x.lstrip().startswith("{"):
        return x or ""
    try:
        return rich_text(json.loads(x))
    except ValueError:
        return x


@F.pandas_udf(ArrayType(StringType()))
def _flat_bodies(raw: pd.Series) -> pd.Series:
    return raw.map(lambda xs: [_body(x) for x in xs])


def map_issues(raw: DataFrame, release_field: str = "release") -> tuple[DataFrame, DataFrame]:
    """(issues, gaps) from ``payload`` (JSON text of one issue, the tenant's release field named).

    A row without a key, project or creation time is a gap, not an issue.
    """
    parsed = raw.withColumn("r", F.from_json("payload", RAW_ISSUE, {"mode": "PERMISSIVE"}))
    parsed = parsed.withColumn("bodies", _flat_bodies(F.transform(F.coalesce("r.fields.comment.comments", F.array()), lambda c: c["body"])))
    f = F.col("r.fields")
    moves = changes(F.col("r.changelog.histories"))
    flat = parsed.select(
        "payload", F.col("r.key").alias("key"), f["project"]["key"].alias("project_key"), f["summary"].alias("summary"), f["status"]["name"].alias("status_name"),
        category(F.coalesce(f["status"]["statusCategory"]["key"], F.lit("new"))).alias("status_category"), f["assignee"]["accountId"].alias("assignee_id"), F.lit(None).cast("double").alias("story_points"),
        release(_raw_json(F.col("payload"), release_field)).alias("target_release"), timestamp(f["created"]).alias("created_at"), timestamp(f["updated"]).alias("updated_at"), due_date(f["duedate"]).alias("due_date"),
        F.transform(F.coalesce(f["comment"]["comments"], F.array()), lambda c, i: F.struct(c["id"].alias("id"), F.get("bodies", i).alias("body"), c["author"]["accountId"].alias("author_id"), timestamp(c["created"]).alias("created_at"))).alias("comments"),
        moves.alias("changelog"), links(f["issuelinks"]).alias("links"),
    )
    good = F.col("key").isNotNull() & F.col("project_key").isNotNull() & F.col("created_at").isNotNull()
    issues = flat.where(good).withColumn("sprint_name", current_sprint()).drop("payload")
    gaps = flat.where(~good).select(F.lit("unmappable_issue").alias("reason"), F.coalesce("project_key", F.lit("unknown")).alias("scope"), F.coalesce("key", F.substring("payload", 1, 80)).alias("detail"))
    return issues, gaps


def _raw_json(payload: Column, field: str) -> Column:
    """A field of the issue by its path, as JSON text."""
    return F.to_json(F.try_variant_get(F.try_parse_json(payload), f'$.fields["{field}"]', "variant"))


class _Storage(HTMLParser):
    """Wiki storage format (XHTML with macros) to sections ``[heading, level, text parts]``."""

    #: Macros whose body is kept (all others go), and tags that break a line.
    KEPT = {"info", "note", "warning", "tip", "panel", "expand", "excerpt", "code"}
    BLOCKS = {"p", "div", "li", "tr", "br", "blockquote", "table", "ul", "ol"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.sections: list[list] = [[None, 0, []]]
        self.macros: list[bool] = []
        self.silent = False
        self.title: list[str] | None = None

    @property
    def quiet(self) -> bool:
        return self.silent or any(self.macros)

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "ac:structured-macro":
            self.macros.append((named.get("ac:name") or "").lower() not in self.KEPT)
        elif tag == "ac:parameter":
            self.silent = True
        elif self.quiet:
            return
        elif re.fullmatch(r"h[1-6]", tag):
            self.sections.append([None, int(tag[1]), []])
            self.title = []
        elif tag == "ri:attachment" and named.get("ri:filename"):
            self.sections[-1][2].append(f"[attachment: {named['ri:filename']}]")
        elif tag in ("td", "th"):
            self.sections[-1][2].append(" | ")
        elif tag in self.BLOCKS:
            self.sections[-1][2].append("\n")

    def handle_endtag(self, tag):
        if tag == "ac:structured-macro":
            del self.macros[-1:]
        elif tag == "ac:parameter":
            self.silent = False
        elif any(self.macros):
            return
        elif re.fullmatch(r"h[1-6]", tag) and self.title is not None:
            self.sections[-1][0] = _tidy(self.title) or None
            self.title = None
        elif tag in self.BLOCKS:
            self.sections[-1][2].append("\n")

    def handle_data(self, data):
        if not self.quiet:
            (self.sections[-1][2] if self.title is None else self.title).append(data)

    def unknown_decl(self, data):
        if not self.quiet and data.startswith("CDATA["):
            self.sections[-1][2].append(f"\n{data[6:]}\n")


def _tidy(parts: list[str]) -> str:
    """Lines trimmed, blanks in a row as one, at most one empty line in a row."""
    lines = "\n".join(re.sub(r"[ \t]+", " ", line).strip() for line in "".join(parts).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


def sections_of(html: str | None) -> list[dict]:
    parser = _Storage()
    parser.feed(html or "")
    parser.close()
    tidy = [(heading, level, _tidy(parts)) for heading, level, parts in parser.sections]
    return [{"heading": heading, "level": level, "text": text} for heading, level, text in tidy if heading or text]


def _sections(batches):
    kind = pa.list_(pa.struct([("heading", pa.string()), ("level", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[3:], pa.array([sections_of(x) for x in batch.column(2).to_pylist()], kind)], [*batch.schema.names[:2], *batch.schema.names[3:], "sections"])


def page_sections(pages: DataFrame, id_col: str = "page_id", title_col: str = "url", html_col: str = "html", keep: str | None = None) -> DataFrame:
    """``page_id, title, sections`` of pages in storage format, and a column ``keep``; one row a page, no shuffle."""
    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(title_col).cast("string").alias("title"), F.col(html_col).cast("string").alias("html"), *([keep] if keep else []))
    kept = f"{keep} {pages.schema[keep].dataType.simpleString()}, " if keep else ""
    return rows.mapInArrow(_sections, f"page_id string, title string, {kept}sections array<struct<heading: string, level: int, text: string>>")


def read_issue_pages(spark: SparkSession, path: str) -> DataFrame:
    """``payload`` of every issue in search pages kept as JSON lines, one page a line."""
    pages = spark.read.text(path)
    issues = F.explode(F.from_json(F.get_json_object("value", "$.issues"), "array<variant>"))
    return pages.select(issues.alias("v")).select(F.to_json("v").alias("payload"))


def cache_misses(texts: DataFrame, cache: DataFrame, model: str, kind: str = "document") -> DataFrame:
    """Texts whose key (model, kind and text, hashed) is not in the cache."""
    keyed = texts.withColumn("cache_key", F.sha2(F.concat_ws(":", F.lit(model), F.lit(kind), F.col("text")), 256))
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def failure_reason(message: Column) -> Column:
    """Fixed order: permission, rate, timeout, upstream."""
    low = F.lower(message)
    return F.when(message.contains("403") | low.contains("permission"), "permission_denied").when(low.contains("rate") | message.contains("429"), "rate_limited").when(low.contains("timeout") | low.contains("timed out"), "timeout").otherwise("upstream_error")


def explain_errors(body: Column) -> Column:
    """``errorMessages`` then ``errors`` as ``key: value``, joined by `` / ``; other texts are cut at 200."""
    v = F.from_json(body, "struct<errorMessages: array<string>, errors: map<string, string>>")
    pairs = F.transform(F.map_entries(F.coalesce(v["errors"], F.create_map().cast("map<string,string>"))), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    parts = F.concat(F.coalesce(v["errorMessages"], F.array().cast("array<string>")), pairs)
    return F.when(F.size(parts) > 0, F.array_join(parts, " / ")).otherwise(F.substring(body, 1, 200))
