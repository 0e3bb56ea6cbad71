"""The library's tables, derived from the provided ones by rule (dates are rebased on a fixed clock)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rules import current_sprint

NOW = "2001-12-01 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ago(days, hours):
    return now() - F.make_dt_interval(days.cast("int"), hours.cast("int"))


def _category(status):
    return F.when(status == "O", "in_progress").when(status == "P", "todo").when(status == "F", "done")


def asked_orders(keys: DataFrame) -> DataFrame:
    """``l_orderkey`` of the issues that ``issue_key`` names, each once; what is no issue's key is left out."""
    n = F.substring("issue_key", 5, 20).try_cast("long")
    return keys.where(F.concat(F.lit("ORD-"), n) == F.col("issue_key")).select(n.alias("l_orderkey")).distinct()


def lines(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """One row per order, or per order of ``asked``, with its changes, comments and links as arrays: one shuffle of its line items by order."""
    target = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("t"), _category(F.col("o_orderstatus")).alias("target_status_category"))
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    if asked is not None:
        items = items.join(asked, "l_orderkey", "left_semi")
    items = items.withColumn("t", F.col("l_partkey") * 10).join(target, "t", "left")
    items = items.repartition("l_orderkey")  # plain columns are moved; nested records are built only where they are gathered
    moment = _ago(F.col("l_partkey") % 60, F.col("l_suppkey") % 24)
    kind = F.when(F.col("l_returnflag") == "A", "blocks").when(F.col("l_returnflag") == "R", "depends_on").otherwise("relates_to")
    return items.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", moment.alias("moment"), "l_partkey", "l_suppkey", "l_returnflag",
            F.struct(F.concat(F.lit("ORD-"), F.col("t")).alias("target_key"), F.lit(None).cast("string").alias("target_summary"), "target_status_category", kind.alias("link_type"), (F.col("l_linestatus") == "O").alias("target_blocks_this")).alias("link")))).alias("items")
    )


def issues(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """All issues, or those whose ``l_orderkey`` is in ``asked``."""
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    if asked is not None:
        orders = orders.join(asked.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    created = _ago(key % 60, cust % 24)
    day = F.date_trunc("day", now() + F.make_dt_interval((key % 41 - 20).cast("int")))
    status = F.when(F.col("o_orderpriority").startswith("1"), "Blocked").when(F.col("o_orderpriority").startswith("2"), " On  Hold ").otherwise("In Progress")
    base = orders.join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").select(
        F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("ORD-"), key).alias("key"), F.col("c_mktsegment").alias("project_key"), F.concat(F.lit("Order "), key).alias("summary"), status.alias("status_name"),
        _category(F.col("o_orderstatus")).alias("status_category"), F.when(cust % 7 != 0, F.concat(F.lit("user-"), cust)).alias("assignee_id"), F.lit(None).cast("double").alias("story_points"),
        F.when(key % 5 >= 2, F.concat(F.lit("R"), key % 3)).alias("target_release"), created.alias("created_at"), now().alias("updated_at"),
        F.when(key % 4 != 0, day + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59), F.lit(59))).alias("due_date"),
    )
    rows = base.join(lines(spark, sf_dir, asked), "l_orderkey", "left").withColumn("items", F.coalesce("items", F.array()))
    late = lambda i: i["moment"] >= F.col("created_at")
    none = F.lit(None).cast("string")
    moved = F.transform(F.filter("items", lambda i: i["l_returnflag"] == "R"), lambda i: F.struct(F.lit("Sprint").alias("field"), none.alias("from_value"), F.concat(F.lit("Sprint "), i["l_linenumber"]).alias("to_value"), (F.col("created_at") + F.make_dt_interval(mins=i["l_linenumber"])).alias("at"), none.alias("author_id")))
    changed = F.transform(F.filter("items", lambda i: (i["l_linenumber"] <= 2) & late(i)), lambda i: F.struct(F.lit("status").alias("field"), none.alias("from_value"), none.alias("to_value"), i["moment"].alias("at"), none.alias("author_id")))
    said = F.transform(F.filter("items", lambda i: (i["l_linenumber"] == 3) & late(i)), lambda i: F.struct(F.concat(F.col("key"), F.lit("-3")).alias("id"), F.concat(F.lit("part "), i["l_partkey"]).alias("body"), F.concat(F.lit("user-"), i["l_suppkey"]).alias("author_id"), i["moment"].alias("created_at")))
    rows = rows.withColumns({"comments": said, "changelog": F.concat(moved, changed), "links": F.transform("items", lambda i: i["link"])})
    return rows.withColumn("sprint_name", current_sprint()).drop("items", "l_orderkey")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from events: one trace a user, each span's parent the event before, unless the id divides by 3."""
    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    model = F.element_at(F.array(*[F.lit(x) for x in ("claude-opus-1", "claude-sonnet-1", "claude-haiku-1", "other")]), (F.col("event_id") % 4 + 1).cast("int"))
    k = F.get_json_object("props", "$.k").cast("long")
    start = F.col("ts").cast("timestamp")
    return e.select(
        F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), F.when(F.col("event_id") % 3 != 0, F.lag("event_id").over(w).cast("string")).alias("parent_id"),
        F.concat(F.lit("op-"), F.col("event_id") % 5).alias("name"), F.col("event_type").alias("kind"), start.alias("started_at"),
        F.when(F.col("event_id") % 50 != 0, F.timestamp_micros(F.unix_micros(start) + F.floor(F.col("value") * 600).cast("long") * 1_000_000)).alias("ended_at"),
        k.alias("input_tokens"), (k * 2).alias("output_tokens"), model.alias("model"), F.when(F.col("event_id") % 97 == 0, "failed").otherwise("").alias("error"),
    )


#: Words of the test tables for vectors of counts, none of them a stop word.
VOCABULARY = "ci de en la der que le er ou die re ch und es des ai et tion ein zu".split()
MOST_LINES = 10_000_000


def chunks(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    """Lines of documents, with ``more`` columns of the document; ``ord`` orders them by document and position (of at most ``MOST_LINES`` lines)."""
    d = read(spark, sf_dir, "documents").where("doc_id is not null")
    rows = d.select("doc_id", *[c.alias(name) for name, c in more.items()], F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.length("text") > 0)
    return rows.select((F.col("doc_id") * MOST_LINES + F.col("pos")).alias("ord"), F.concat_ws("#", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("chunk_id"), F.col("doc_id").cast("string").alias("page_id"), "text", *more)


#: The document and the place in it that an ``ord`` of :func:`chunks` stands for.
PLACE = f"pmod(ord, {MOST_LINES})"
DOCUMENT = f"(ord - {PLACE}) div {MOST_LINES}"


def questions(spark: SparkSession, sf_dir: str, every: int = 1) -> DataFrame:
    """Benchmark items as a stated set of queries: those whose id ``every`` divides."""
    return read(spark, sf_dir, "benchmark").where(F.col("item_id") % every == 0).select(F.col("item_id").alias("query_id"), "text")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with citations added by rule: turn 1 mod 4 after the text, 3 mod 4 none, others in its first line."""
    c = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    n = F.concat(F.lit(" ["), (F.col("turn") % 7 + 1).cast("string"), F.lit("]"))
    cited = F.when(F.col("turn") % 4 == 3, F.col("text")).when(F.col("conv_id") % 3 == 0, F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n")), n)).otherwise(F.concat(F.replace("text", F.lit("\n"), F.concat(n, F.lit("\n\n")))))
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"), cited.alias("text"), F.lit(5).alias("passages"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected from labels, got from the length of the text."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    expected = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "supported").when(F.col("quality") == 1, "overreach").when(F.col("toxic") == 1, "unsupported").otherwise("miscited")
    got = F.element_at(F.array(*[F.lit(x) for x in ("supported", "overreach", "miscited", "unsupported", "unjudged")]), (F.col("n_chars") % 5 + 1).cast("int"))
    return rows.select("doc_id", expected.alias("expected"), got.alias("got"), got.alias("verdict"), "n_chars")
