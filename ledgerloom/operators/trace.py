"""Span analytics: self time, occupancy, costs, percentiles."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..steps import dropped, written
from . import ranks

#: Price of a million tokens read and written, by prefix of the model's id; the last is the default (fixed values).
RATES = (("claude-opus", 15.0, 75.0), ("claude-sonnet", 3.0, 15.0), ("claude-haiku", 0.8, 4.0), ("", 3.0, 15.0))


def milliseconds(start: Column, end: Column) -> Column:
    """0 for a span that has not ended."""
    return F.coalesce((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1000.0), F.lit(0.0))


def cost(rates=RATES) -> Column:
    """Of a span's tokens, by the first prefix of its model; a null model takes the default."""
    model = F.coalesce("model", F.lit(""))
    price = lambda i, o: (F.coalesce("input_tokens", F.lit(0)) * F.lit(i) + F.coalesce("output_tokens", F.lit(0)) * F.lit(o)) / F.lit(1_000_000)
    out = price(*rates[-1][1:])
    for prefix, i, o in reversed(rates[:-1]):
        out = F.when(model.startswith(prefix), price(i, o)).otherwise(out)
    return out


def with_durations(spans: DataFrame, rates=RATES) -> DataFrame:
    """Spans with ``duration_ms`` and ``cost_usd``; ``rates`` is the price card, the first prefix that fits counts."""
    return spans.withColumn("duration_ms", milliseconds(F.col("started_at"), F.col("ended_at"))).withColumn("cost_usd", cost(rates))


def self_time(spans: DataFrame, rates=RATES) -> DataFrame:
    """Spans with ``self_ms``: their duration without that of their children, at least 0."""
    spans = with_durations(spans, rates)
    kids = spans.where("parent_id is not null").groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.sum("duration_ms").alias("children_ms"))
    return spans.join(kids, ["trace_id", "span_id"], "left").withColumn("self_ms", F.greatest(F.lit(0.0), F.col("duration_ms") - F.coalesce("children_ms", F.lit(0.0)))).drop("children_ms")


def occupancy(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``occupancy_ms`` of each group: the length of the union of its intervals, by time ranges, so a trace of any size is no single task."""
    ends = spans.withColumn("__until", F.coalesce("ended_at", "started_at"))
    return ranks.covered(ends, keys, "started_at", "__until", milliseconds).withColumnRenamed("covered", "occupancy_ms")


def by_kind(spans: DataFrame) -> DataFrame:
    """Of each trace and kind: count, total, self time, cost, tokens, occupancy and concurrency."""
    timed = self_time(spans)
    sums = timed.groupBy("trace_id", "kind").agg(
        F.count(F.lit(1)).alias("spans"), F.sum("duration_ms").alias("total_ms"), F.sum("self_ms").alias("self_ms"), F.sum("cost_usd").alias("cost_usd"),
        F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"),
    )
    out = sums.join(occupancy(spans, ["trace_id", "kind"]), ["trace_id", "kind"])
    return out.withColumn("concurrency", F.coalesce(F.try_divide("total_ms", "occupancy_ms"), F.lit(0.0)))


def totals(spans: DataFrame, rates=RATES) -> DataFrame:
    """Of each trace: wall time (longest root), cost, tokens and errors."""
    roots = F.max(F.when(F.col("parent_id").isNull(), F.col("duration_ms")))
    return with_durations(spans, rates).groupBy("trace_id").agg(
        F.coalesce(roots, F.lit(0.0)).alias("wall_ms"), F.sum("cost_usd").alias("cost_usd"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"), F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("errors"),
    )


def index_percentiles(df: DataFrame, keys: list[str], value: str, points: tuple[float, ...] = (0.5, 0.95), buckets: int = 1024) -> DataFrame:
    """mean, percentiles by index ``min(int(n * p), n - 1)`` of the sorted values, and max.

    Equal values are counted together first (combined before the shuffle) and
    written with their counts, so ``df`` is read once.  A
    histogram of ``buckets`` even parts of a group's range tells the part that holds
    each index, a second one divides that part again, and only the values in it are
    put in order: no task sorts a whole group.  Nulls are left out.
    """
    df = df.where(F.col(value).isNotNull())
    names = [f"k{i}" for i in range(len(keys))]
    by = lambda *more: Window.partitionBy(*names, *more)
    same = lambda a, b: F.lit(True) if not names else functools.reduce(lambda x, y: x & y, [F.col(f"{a}{n}").eqNullSafe(F.col(f"{b}{n}")) for n in names])
    values = written(df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")), "values")
    ends = values.groupBy(*names).agg(F.sum("n").alias("all"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    point = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(points)]))
    asked = ends.withColumn("x", point).select(*[F.col(n).alias(f"a_{n}") for n in names], "lo", "hi", F.col("x.i").alias("i"), F.least(F.floor(F.col("all") * F.col("x.p")), F.col("all") - 1).alias("index"))
    part = lambda lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.greatest(F.lit(0), F.floor((F.col("v") - F.col(lo)) / (F.col(hi) - F.col(lo)) * buckets)), F.lit(buckets - 1))).otherwise(0).cast("int")
    rows = values.join(asked, same("", "a_")).drop(*[f"a_{n}" for n in names])
    for level in range(2):
        rows = rows.withColumn("b", part("lo", "hi"))
        sums = rows.groupBy(*names, "i", "index", "b").agg(F.sum("n").alias("m"))
        upto = F.sum("m").over(by("i").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        hit = sums.withColumn("upto", upto).where("index < upto and index >= upto - m").select(*[F.col(n).alias(f"h_{n}") for n in names], F.col("i").alias("h_i"), F.col("b").alias("h_b"), (F.col("index") - F.col("upto") + F.col("m")).alias("rest"))
        rows = rows.join(hit, same("", "h_") & (F.col("i") == F.col("h_i")) & (F.col("b") == F.col("h_b")))
        width = (F.col("hi") - F.col("lo")) / buckets
        rows = rows.select(*names, "v", "n", "i", F.col("rest").alias("index"), (F.col("lo") + width * F.col("b")).alias("lo"), (F.col("lo") + width * (F.col("b") + 1)).alias("hi"))
    upto = F.sum("n").over(by("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("upto", upto).where("index < upto and index >= upto - n")
    found = found.groupBy(*[F.col(n).alias(f"f_{n}") for n in names]).agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"p{round(100 * p)}") for i, p in enumerate(points)])
    out = ends.join(found, same("", "f_"))
    out = out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("all").alias("n"), "mean", *[f"p{round(100 * p)}" for p in points], F.col("hi").alias("max"))
    out = written(out, "percentiles")  # one row a group
    dropped(values)
    return out


def slowest(spans: DataFrame, n: int = 5) -> DataFrame:
    return with_durations(spans).orderBy(F.desc("duration_ms"), "span_id").limit(n)


def export_json(spans: DataFrame) -> DataFrame:
    """``span_id, json``: one object a span, values rounded as they are reported."""
    timed = self_time(spans)
    shape = F.struct("trace_id", "span_id", "parent_id", "name", "kind", F.bround("duration_ms", 2).alias("duration_ms"), F.bround("self_ms", 2).alias("self_ms"), "input_tokens", "output_tokens", F.bround("cost_usd", 6).alias("cost_usd"), "model", "error")
    return timed.select("span_id", F.to_json(shape).alias("json"))


#: Spans in one object; a trace of more goes out in parts.
MOST_SPANS = 1_000


def export_objects(spans: DataFrame, most: int = MOST_SPANS, rates=RATES) -> DataFrame:
    """``trace_id, part, parts, json``: one object a trace, with its totals and its spans in order of their start.

    A trace of more than ``most`` spans goes out in ``parts`` objects of ``most`` spans, each
    with the trace's totals, so no array grows with a trace.  Values are rounded as they are reported.
    """
    timed = self_time(spans, rates)
    span = F.struct(
        "name", "kind", "span_id", "parent_id", F.bround("duration_ms", 2).alias("duration_ms"), F.bround("self_ms", 2).alias("self_ms"), F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"), F.bround("cost_usd", 6).alias("cost_usd"), "model", F.coalesce("error", F.lit("")).alias("error"),
    )
    rows = ranks.running_sum(timed.select("trace_id", "started_at", F.col("span_id").alias("of"), span.alias("span")), ["trace_id"], ["started_at", F.col("of").try_cast("long"), "of"], F.lit(1), "place")
    rows = rows.withColumn("part", F.expr(f"(place - 1) div {int(most)}"))
    parts = rows.groupBy("trace_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "span"))), lambda x: x.span).alias("spans"))
    first = spans.groupBy("trace_id").agg(F.min("started_at").alias("started_at"), F.count(F.lit(1)).alias("n"))
    about = totals(spans, rates).join(first, "trace_id")
    said = about.select("trace_id", "started_at", F.bround("wall_ms", 1).alias("wall_ms"), F.bround("cost_usd", 6).alias("cost_usd"), "input_tokens", "output_tokens", F.expr(f"(n - 1) div {int(most)} + 1").alias("parts"))
    whole = F.struct("trace_id", "started_at", "wall_ms", "cost_usd", "input_tokens", "output_tokens", "spans")
    return parts.join(said, "trace_id").select("trace_id", "part", "parts", F.to_json(whole).alias("json"))


def export_collector(spans: DataFrame) -> DataFrame:
    """``trace_id, span_id, json``: a span as a trace collector takes it, with times in nanoseconds and a status of 2 for errors, 1 for others."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    nanos = lambda c: F.unix_micros(c) * 1000
    attributes = F.struct(F.col("kind").alias("gen_ai.operation.name"), F.coalesce("input_tokens", F.lit(0)).alias("gen_ai.usage.input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("gen_ai.usage.output_tokens"))
    shape = F.struct(
        "name", F.col("span_id").alias("spanId"), F.col("parent_id").alias("parentSpanId"), nanos(F.col("started_at")).alias("startTimeUnixNano"), nanos(F.coalesce("ended_at", "started_at")).alias("endTimeUnixNano"),
        attributes.alias("attributes"), F.struct(F.when(failed, 2).otherwise(1).alias("code"), F.coalesce("error", F.lit("")).alias("message")).alias("status"),
    )
    return spans.select("trace_id", "span_id", F.to_json(shape).alias("json"))


def summary(spans: DataFrame) -> DataFrame:
    """Kinds of each trace in the order of a summary, by the clock they owned: ``position`` and ``share`` of the trace's wall time in percent."""
    kinds = by_kind(spans).join(totals(spans).select("trace_id", "wall_ms"), "trace_id")
    order = Window.partitionBy("trace_id").orderBy(F.desc("occupancy_ms"), "kind")  # a row a kind
    return kinds.withColumns({"position": F.row_number().over(order), "share": F.when(F.col("wall_ms") > 0, F.col("occupancy_ms") / F.col("wall_ms") * 100).otherwise(0.0)})


def running_tokens(spans: DataFrame) -> DataFrame:
    """Spans with the tokens used in their trace up to and with them."""
    used = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return ranks.running_sum(spans, ["trace_id"], ["started_at", F.col("span_id").try_cast("long"), "span_id"], used, "tokens")
