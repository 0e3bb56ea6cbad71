"""Files of payloads, cases and thresholds; each row that does not map is set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ingest import page_sections, timestamp

PAGE = (
    "struct<id: string, title: string, spaceId: string, version: struct<number: int, createdAt: string>, body: struct<storage: struct<value: string>>, "
    "labels: struct<results: array<struct<name: string>>>, _links: struct<webui: string>>"
)
CASE = "struct<question: string, relevant_page_ids: array<string>, category: string, must_not_retrieve: array<string>, note: string>"
METRIC = "struct<value: double, name: string, tolerance: double, direction: string, note: string, unit: string, sampled: boolean, baseline_runs: int>"


def until_last(pages: DataFrame, scope: str = "scope", number: str = "number", payload: str = "payload") -> DataFrame:
    """Search pages of each scope up to the first that says it is the last, or names no next one."""
    last = F.coalesce(F.get_json_object(payload, "$.isLast") == "true", F.lit(False)) | F.get_json_object(payload, "$.nextPageToken").isNull()
    before = F.max(last.cast("int")).over(Window.partitionBy(scope).orderBy(number).rowsBetween(Window.unboundedPreceding, -1))
    return pages.withColumn("__ended", before).where("__ended is null or __ended = 0").drop("__ended")


def items(pages: DataFrame, field: str, payload: str = "payload") -> DataFrame:
    """One row for each entry of a page's list, as JSON text in ``payload``; the page's other columns are kept."""
    entry = F.explode(F.from_json(F.get_json_object(payload, f"$.{field}"), "array<variant>")).alias("__v")
    return pages.select(*[c for c in pages.columns if c != payload], entry).withColumn(payload, F.to_json("__v")).drop("__v")


def relative_path(link: Column) -> Column:
    """Path and query of a link, absolute or relative; the fragment is left out."""
    return F.regexp_extract(link, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^#]*)", 1)


def map_pages(raw: DataFrame, base_url: str, labels: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, gaps) of ``scope`` (the space) and ``payload`` (JSON text of one wiki page).

    Pages: ``page_id, space_key, title, url, version, updated_at, labels, sections``.
    One without an id or a readable time is a gap.  With ``labels``, only pages that
    carry one of them.
    """
    rows = raw.withColumn("r", F.from_json("payload", PAGE))
    names = F.transform(F.coalesce("r.labels.results", F.array()), lambda x: F.coalesce(x["name"], F.lit("")))
    flat = rows.select(
        "payload", F.col("r.id").alias("page_id"), F.col("scope").alias("space_key"), F.coalesce("r.title", F.lit("")).alias("title"),
        F.concat(F.lit(f"{base_url}/wiki"), F.coalesce("r._links.webui", F.lit(""))).alias("url"), F.coalesce("r.version.number", F.lit(1)).alias("version"),
        timestamp(F.col("r.version.createdAt")).alias("updated_at"), names.alias("labels"), F.coalesce("r.body.storage.value", F.lit("")).alias("html"),
    )
    good = F.col("page_id").isNotNull() & F.col("updated_at").isNotNull()
    gaps = flat.where(~good).select(F.lit("unmappable_page").alias("reason"), F.col("space_key").alias("scope"), F.coalesce("page_id", F.substring("payload", 1, 80)).alias("detail"))
    pages = flat.where(good)
    if labels:
        pages = pages.where(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels])))
    parsed = page_sections(pages.withColumn("about", F.struct("space_key", "title", "url", "version", "updated_at", "labels")), "page_id", "title", "html", keep="about")
    return parsed.select("page_id", "about.*", "sections"), gaps


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON file with a list ``cases``; what is absent has its default."""
    return cases_of(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def cases_of(files: DataFrame) -> DataFrame:
    rows = files.select(F.explode(F.from_json(F.get_json_object("json", "$.cases"), f"array<{CASE}>")).alias("c")).select("c.*")
    none = F.array().cast("array<string>")
    return rows.select("question", F.coalesce("relevant_page_ids", none).alias("relevant_page_ids"), F.coalesce("category", F.lit("general")).alias("category"), F.coalesce("must_not_retrieve", none).alias("must_not_retrieve"), F.coalesce("note", F.lit("")).alias("note"))


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """Recorded thresholds of a JSON file with an object ``metrics``, for :func:`ledgerloom.operators.evaluation.overlay`."""
    return thresholds_of(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def thresholds_of(files: DataFrame) -> DataFrame:
    rows = files.select(F.explode(F.from_json(F.get_json_object("json", "$.metrics"), f"map<string, {METRIC}>")).alias("key", "m"))
    return rows.select("key", "m.name", F.col("m.value").alias("baseline"), "m.tolerance", "m.direction", "m.unit", "m.sampled", "m.note", F.coalesce("m.baseline_runs", F.lit(1)).alias("baseline_runs"))


def field_catalogue(fields: DataFrame, part: str) -> DataFrame:
    """``id, name`` of fields whose name holds ``part``, whatever its case, by name."""
    return fields.where(F.contains(F.lower("name"), F.lit(part.lower()))).orderBy("name", "id")


def known_fields(configured: DataFrame, fields: DataFrame) -> DataFrame:
    """Configured field ids (``id``) and whether a field has each; a search that names one that does not exist is refused."""
    return configured.join(fields.select("id", F.lit(True).alias("there")).dropDuplicates(["id"]), "id", "left").withColumn("exists", F.coalesce("there", F.lit(False))).drop("there")


def connection_sample(issues: DataFrame, n: int = 50) -> DataFrame:
    """One row: how many of the first ``n`` issues by key have a target release and a change."""
    return issues.orderBy("key").limit(n).agg(F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("target_release").isNotNull()).alias("with_release"), F.count_if(F.size("changelog") > 0).alias("with_changes"))


def generated_issues(spark: SparkSession, n: int, project: str = "GEN") -> DataFrame:
    """``n`` issues by rule: every third in progress, four in ten without a release, changes by number."""
    k = F.col("id")
    blank = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(10)) < 4
    return spark.range(n).select(
        F.concat(F.lit(f"{project}-"), k + 1).alias("key"), F.lit(project).alias("project_key"), F.when(k % 3 == 0, "in_progress").when(k % 3 == 1, "todo").otherwise("done").alias("status_category"),
        F.when(~blank, F.concat(F.lit("R"), k % 4)).alias("target_release"), (k % 5).cast("int").alias("moves"),
    )


def blank_rate(issues: DataFrame) -> DataFrame:
    """One row: issues, and how many lack a release."""
    return issues.agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("target_release").isNull()).alias("blank"))


def replayed(prompts: DataFrame, recorded: DataFrame, model: str) -> DataFrame:
    """``prompts`` (``prompt_id, prompt``) with the reply recorded under the prompt's key; null where there is none."""
    keyed = prompts.withColumn("reply_key", F.sha2(F.concat_ws(":", F.lit(model), F.col("prompt")), 256))
    return keyed.join(recorded.select("reply_key", "reply"), "reply_key", "left")


def write_through(cache_path: str, fresh: DataFrame) -> None:
    """Append new vectors (``cache_key, vector``) to the cache."""
    fresh.select("cache_key", "vector").write.mode("append").parquet(cache_path)
