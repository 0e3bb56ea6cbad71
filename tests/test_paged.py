"""The paged source: both cursors, both ends of a stream, filters that reach the service, streams that break off."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import ingest, paged


def put(root, scope, facet, **pages):
    at = root / scope / facet
    os.makedirs(at)
    for cursor, body in pages.items():
        (at / f"{cursor}.json").write_text(body if isinstance(body, str) else json.dumps(body))


def issue(key):
    return {"key": key, "fields": {"project": {"key": key.split("-")[0]}, "created": "2001-01-02T03:04:05.000+0000", "status": {"name": "Open"}}}


def keys(df):
    return sorted(r.k for r in df.where("error is null").select(F.get_json_object("payload", "$.key").alias("k")).collect())


@pytest.fixture
def store(tmp_path):
    put(tmp_path, "A", "open", first={"issues": [issue("A-1"), issue("A-2")], "nextPageToken": "t/1"}, **{"t%2F1": {"issues": [issue("A-3")], "isLast": True, "nextPageToken": "first"}})
    put(tmp_path, "A", "done", first={"issues": [issue("A-9")]})
    put(tmp_path, "B", "open", first={"issues": []}, unused="not opened: no page names it")
    put(tmp_path, "C", "open", first={"issues": [issue("C-1")], "nextPageToken": "gone"})
    put(tmp_path, "D", "open", first={"issues": [issue("D-1")], "nextPageToken": "x"}, x={"issues": [issue("D-2")], "nextPageToken": "x"})
    put(tmp_path, "E", "open", first="{ no JSON")
    put(tmp_path, "F", "open", first={"issues": [{"fields": {}}, issue("F-1"), {"key": "F-2"}]})
    return f"file://{tmp_path}"


def test_tokens_are_followed_and_both_ends_end(spark, store):
    rows = paged.search_issues(spark, store)
    assert keys(rows.where("project in ('A', 'B')")) == ["A-1", "A-2", "A-3", "A-9"]
    assert sorted((r.project, r.status, r.page) for r in rows.where("project = 'A'").collect()) == [("A", "done", 0), ("A", "open", 0), ("A", "open", 0), ("A", "open", 1)]


def test_a_stream_that_breaks_off_is_a_gap_and_keeps_what_came(spark, store):
    rows = paged.search_issues(spark, store)
    found = {r.scope: r.detail for r in paged.gaps(rows, "project").collect()}
    assert set(found) == {"C", "D", "E"} and found["D"] == "page 2: the cursor repeats" and found["C"].startswith("page 1: FileNotFoundError") and found["E"].startswith("page 0: JSONDecodeError")
    assert keys(rows.where("project in ('C', 'D')")) == ["C-1", "D-1", "D-2"]


def test_one_item_that_does_not_map_stops_nothing(spark, store):
    issues, unmapped = ingest.map_issues(paged.search_issues(spark, store).where("project = 'F' and error is null"))
    assert [r.key for r in issues.collect()] == ["F-1"] and unmapped.count() == 2


class Counted(paged.Folder):
    """Notes each request in a file beside the pages."""

    def _read(self, scope, facet, cursor):
        with open(f"{self.root}/requests", "a") as f:
            f.write(f"{scope} {facet} {cursor}\n")
        return super()._read(scope, facet, cursor)


def asked(store):
    at = f"{store.removeprefix('file://')}/requests"
    lines = sorted(open(at)) if os.path.exists(at) else []
    if lines:
        os.remove(at)
    return [x.strip() for x in lines]


def test_filters_reach_the_service(spark, store):
    rows = paged.search_issues(spark, store, transport="tests.test_paged:Counted")
    assert keys(rows.where("project = 'A' and status = 'open'")) == ["A-1", "A-2", "A-3"]
    assert asked(store) == ["A open first", "A open t/1"]
    assert keys(rows.where("status in ('done', 'closed')")) == ["A-9"] and asked(store) == ["A done first"]
    assert keys(rows.where("project = 'A' and project in ('B', 'C')")) == [] and asked(store) == []
    # What cannot be pushed is still a filter.
    assert keys(rows.where("project = 'A' and page > 0 and status like 'o%'")) == ["A-3"] and "A done first" in asked(store)
    plan = rows.where("project = 'A' and page = 0")._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(page" in plan or "(page" in plan


def test_links_are_asked_as_they_stand(spark, tmp_path):
    def page(k, link=None):
        return {"results": [{"id": k}], "_links": {"next": link} if link else {}}

    at = tmp_path / "S%201%2F%C3%A9" / "l1"
    os.makedirs(at)
    for cursor, body in {"first": page(1, "https://host.example/wiki/api/v2/pages?cursor=c%201&limit=3#top"), "c%201": page(2, "/wiki/api/v2/pages?limit=3&cursor=c2"), "c2": page(3)}.items():
        (at / f"{cursor}.json").write_text(json.dumps(body))
    rows = paged.wiki_pages(spark, f"file://{tmp_path}").where("space = 'S 1/é'")
    assert sorted((r.page, r.payload) for r in rows.collect()) == [(0, '{"id": 1}'), (1, '{"id": 2}'), (2, '{"id": 3}')]
    assert paged.after({"_links": {"next": "https://h/x?a=1#f"}}, "link") == "/x?a=1" and paged.after({"_links": None}, "link") is None


def test_streams_are_dealt_over_partitions(spark, store):
    assert paged.search_issues(spark, store, partitions="3").rdd.getNumPartitions() == 3
    assert paged.search_issues(spark, store).rdd.getNumPartitions() == 7
    assert paged.search_issues(spark, store).where("project = 'nobody'").collect() == []
    with pytest.raises(Exception, match="unknown cursor"):
        spark.read.format("paged").options(path=store, cursor="offset").load().collect()


@pytest.mark.parametrize("kind,field", [("token", "issues"), ("link", "results")])
def test_published_pages_read_back(spark, tmp_path, kind, field):
    items = spark.range(230).select(F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("scope"), F.lit("x y").alias("facet"), F.col("id").alias("ord"), F.to_json(F.struct(F.col("id").alias("key"))).alias("payload"))
    pages = paged.publish(items, f"file://{tmp_path}", kind, page_size=20, field=field)
    assert pages == 10 + 3
    read = paged.search_issues if kind == "token" else paged.wiki_pages
    rows = read(spark, f"file://{tmp_path}")
    assert sorted(int(k) for k in keys(rows)) == list(range(230)) and rows.where("error is not null").count() == 0
