"""Paged services as a Spark data source: scopes are read side by side, pages of a scope by their cursor.

``spark.read.format("paged")`` gives a row for every item of every page: ``scope, facet,
page, payload`` (the item's JSON text) ``, error``.  A *stream* is what the service
answers for one scope and one value of the facet by which it filters (an issue's
status, a page's label).  Filters on ``scope`` and ``facet`` are pushed down
(``pushFilters``): the streams that they leave out are never asked for.  Streams are dealt
over partitions; within one, each page names the next.

Two kinds of cursor:

* ``token``: the page has ``nextPageToken``, and ``isLast`` where it is the last.  Either ends the
  stream: a last page may still name a token, and a page without one may not say it is the last.
* ``link``: the page has ``_links.next``, absolute or relative, with a query of its own.  It is
  asked as it stands, without the first request's parameters.

A page that cannot be read or parsed, or that names a page already seen, ends its stream with one row
whose ``error`` says why; :func:`gaps` are those.  Items come out whatever they hold: mapping them, and setting
aside those that do not map, is the next step's work.

What answers is a *transport*: ``first(scope, facet)`` and ``next(scope, facet, cursor)`` give
a page's bytes, ``streams()`` what there is.  :class:`Folder` answers from files in any
file system that Arrow opens; option ``transport`` names another class (``module:Class``), which is made with ``path``.
"""

from __future__ import annotations

import importlib
import json
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..operators.ranks import running_sum

SCHEMA = "scope string, facet string, page int, payload string, error string"


def _name(text: str) -> str:
    return urllib.parse.quote(text, safe="")


class Folder:
    """Pages as files ``<scope>/<facet>/<cursor>.json``, the first one's cursor being ``first``; names are percent-encoded."""

    def __init__(self, path: str):
        self.fs, self.root = pafs.FileSystem.from_uri(path)

    def streams(self) -> list[tuple[str, str]]:
        folders = self.fs.get_file_info(pafs.FileSelector(self.root, recursive=False))
        scopes = [f.base_name for f in folders if f.type == pafs.FileType.Directory]
        inside = {s: self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{s}")) for s in scopes}
        return sorted((urllib.parse.unquote(s), urllib.parse.unquote(f.base_name)) for s, found in inside.items() for f in found if f.type == pafs.FileType.Directory)

    def _read(self, scope: str, facet: str, cursor: str) -> bytes:
        with self.fs.open_input_stream(f"{self.root}/{_name(scope)}/{_name(facet)}/{_name(cursor)}.json") as f:
            return f.read()

    def first(self, scope: str, facet: str) -> bytes:
        return self._read(scope, facet, "first")

    def next(self, scope: str, facet: str, cursor: str) -> bytes:
        # A link carries its cursor in its own query; a token is the cursor.
        query = urllib.parse.parse_qs(urllib.parse.urlsplit(cursor).query)
        return self._read(scope, facet, query["cursor"][0] if "cursor" in query else cursor)


def relative(link: str) -> str:
    """Path and query of a link, whose host is not asked for."""
    parts = urllib.parse.urlsplit(link)
    return parts.path + ("?" + parts.query if parts.query else "")


def after(page: dict, kind: str) -> str | None:
    """The cursor that follows, or None after the last page."""
    if kind == "link":
        link = (page.get("_links") or {}).get("next")
        return relative(link) if link else None
    return None if page.get("isLast") else page.get("nextPageToken") or None


def followed(transport, scope: str, facet: str, kind: str, items: str) -> Iterator[tuple[int, list[str], str | None]]:
    """(page, its items as JSON texts, error) of one stream, page after page."""
    number, cursor, seen = 0, None, set()
    while True:
        try:
            page = json.loads(transport.first(scope, facet) if cursor is None else transport.next(scope, facet, cursor))
            entries = [json.dumps(x, ensure_ascii=False) for x in page.get(items) or []]
            cursor = after(page, kind)
        except Exception as e:  # whatever the service or its answer has: the stream ends here, and says so
            yield number, [], f"{type(e).__name__}: {e}"
            return
        yield number, entries, None
        if cursor is None:
            return
        if cursor in seen:
            yield number + 1, [], "the cursor repeats"
            return
        seen.add(cursor)
        number += 1


class _Streams(InputPartition):
    def __init__(self, streams: list[tuple[str, str]]):
        super().__init__(None)
        self.streams = streams


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.asked: dict[str, set | None] = {"scope": None, "facet": None}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in self.asked:
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.asked[column] = values if self.asked[column] is None else self.asked[column] & values
            else:
                yield f

    def _transport(self):
        module, _, name = self.options.get("transport", f"{__name__}:Folder").partition(":")
        return getattr(importlib.import_module(module), name)(self.options["path"])

    def partitions(self):
        # Asked from the service only where the filters do not name all streams themselves.
        scopes, facets = self.asked["scope"], self.asked["facet"]
        found = self._transport().streams()
        found = [s for s in found if (scopes is None or s[0] in scopes) and (facets is None or s[1] in facets)]
        most = max(1, int(self.options.get("partitions", "200")))
        # At least one, since a scan without partitions is an error.
        return [_Streams(found[k::most]) for k in range(min(most, len(found)))] or [_Streams([])]

    def read(self, partition):
        transport, kind, items = self._transport(), self.options.get("cursor", "token"), self.options.get("items", "issues")
        names = ["scope", "facet", "page", "payload", "error"]
        for scope, facet in partition.streams:
            for number, entries, error in followed(transport, scope, facet, kind, items):
                n = 1 if error else len(entries)
                yield pa.RecordBatch.from_arrays([pa.array([scope] * n), pa.array([facet] * n), pa.array([number] * n, pa.int32()), pa.array(entries if error is None else [None], pa.string()), pa.array([error] * n, pa.string())], names)


class PagedSource(DataSource):
    """Options: ``path``, ``cursor`` (token or link), ``items`` (the list's field), ``partitions`` (at most, 200), ``transport``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if self.options.get("cursor", "token") not in ("token", "link"):
            raise ValueError(f"unknown cursor {self.options['cursor']!r}")
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def search_issues(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``project, status, page, payload, error`` of an issue search's pages, by token; filters on ``project`` and ``status`` are pushed down."""
    register(spark)
    rows = spark.read.format("paged").options(path=path, cursor="token", items="issues", **options).load()
    return rows.withColumnsRenamed({"scope": "project", "facet": "status"})


def wiki_pages(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``space, label, page, payload, error`` of a wiki's pages, by link; filters on ``space`` and ``label`` are pushed down."""
    register(spark)
    rows = spark.read.format("paged").options(path=path, cursor="link", items="results", **options).load()
    return rows.withColumnsRenamed({"scope": "space", "facet": "label"})


def gaps(rows: DataFrame, scope: str) -> DataFrame:
    """``reason, scope, detail`` of streams that broke off."""
    detail = F.concat(F.lit("page "), F.col("page"), F.lit(": "), F.col("error"))
    return rows.where("error is not null").select(F.lit("fetch_failed").alias("reason"), F.col(scope).alias("scope"), detail.alias("detail"))


def _store(path: str):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                at = f"{root}/{_name(row['scope'])}/{_name(row['facet'])}"
                fs.create_dir(at, recursive=True)
                with fs.open_output_stream(f"{at}/{_name(row['cursor'])}.json") as f:
                    f.write(row["body"].encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["pages"])

    return run


def publish(items: DataFrame, path: str, kind: str, page_size: int = 50, field: str = "issues") -> int:
    """Write ``scope, facet, ord, payload`` as the page files that :class:`Folder` answers from; the number of pages.

    Pages are numbered by ranges, so a stream that holds most items is no single task; a task run again
    writes the same files.  Last pages are of either sort: without a cursor, or (tokens, every
    second stream by hash) the last by their own word with the first page's token.
    """
    rows = running_sum(items, ["scope", "facet"], ["ord"], F.lit(1), "n").withColumn("page", F.expr(f"(n - 1) div {page_size}"))
    counts = rows.groupBy("scope", "facet").agg(F.max("page").alias("last"))
    pages = rows.groupBy("scope", "facet", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "payload"))), lambda x: x.payload).alias("entries")).join(counts, ["scope", "facet"])
    last = F.col("page") == F.col("last")
    follows = F.concat(F.lit("c"), F.col("page") + 1)
    listed = F.concat(F.lit(f'{{"{field}":['), F.array_join("entries", ","), F.lit("],"))
    if kind == "token":
        stale = F.pmod(F.xxhash64("scope", "facet"), F.lit(2)) == 0
        rest = F.when(~last, F.concat(F.lit('"nextPageToken":"'), follows, F.lit('"}'))).when(stale, F.lit('"isLast":true,"nextPageToken":"first"}')).otherwise(F.lit('"isLast":true}'))
    else:
        link = F.concat(F.when(F.col("page") % 2 == 0, "https://wiki.example").otherwise(""), F.lit("/wiki/api/v2/pages?limit=9&cursor="), follows)
        rest = F.concat(F.lit('"_links":{'), F.when(~last, F.concat(F.lit('"next":"'), link, F.lit('"'))).otherwise(""), F.lit("}}"))
    body = pages.select("scope", "facet", F.when(F.col("page") == 0, "first").otherwise(F.concat(F.lit("c"), F.col("page"))).alias("cursor"), F.concat(listed, rest).alias("body"))
    return body.mapInArrow(_store(path), "pages long").agg(F.sum("pages")).first()[0] or 0
