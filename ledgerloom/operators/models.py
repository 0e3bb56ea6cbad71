"""Asking a model for replies, and judging claims by them.

The model is the caller's: ``make()`` gives a callable of a prompt to a reply, once a task.
Within a task at most ``concurrency`` prompts are under way, and replies come out in the order of
their prompts, whichever ends first.  A call that fails leaves a null reply and its error in the
row; the others go on.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..steps import written
from .grounding import judged

Model = Callable[[str], str]
#: Calls under way in a task.
CONCURRENCY = 6


def _replies(make: Callable[[], Model], at: int, concurrency: int):
    def one(model: Model, prompt: str | None) -> tuple[str | None, str | None]:
        if prompt is None:
            return None, None
        try:
            return model(prompt), None
        except Exception as e:  # a call that fails is a row that says so
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            model = None
            for batch in batches:
                model = model or make()
                waiting, out = deque(), []
                for prompt in batch.column(at).to_pylist():
                    # The next one is handed over when the oldest is done, so no queue grows with the batch.
                    if len(waiting) >= concurrency:
                        out.append(waiting.popleft().result())
                    waiting.append(pool.submit(one, model, prompt))
                out += [w.result() for w in waiting]
                replies, errors = (pa.array([x[k] for x in out], pa.string()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, replies, errors], [*batch.schema.names, "reply", "error"])

    return run


def asked(prompts: DataFrame, make: Callable[[], Model], prompt_col: str = "prompt", concurrency: int = CONCURRENCY) -> DataFrame:
    """``prompts`` with ``reply`` and ``error``; a null prompt is not asked."""
    schema = StructType([*prompts.schema.fields, StructField("reply", StringType()), StructField("error", StringType())])
    return prompts.mapInArrow(_replies(make, prompts.columns.index(prompt_col), concurrency), schema)


def _asked_of(claims: DataFrame, passages: DataFrame, make, prompt, concurrency: int) -> DataFrame:
    """Each claim (``claim_id, answer_id, claim, indices``) judged by the passages that it cites: ``claim_id, verdict, evidence, error, cited``."""
    each = claims.select("claim_id", "answer_id", "claim", F.explode("indices").alias("position")).join(passages, ["answer_id", "position"])
    shown = each.groupBy("claim_id", "claim").agg(F.array_sort(F.collect_list(F.struct("position", "label", "text"))).alias("p"))  # a claim cites a few
    source = F.array_join(F.transform("p", lambda p: F.concat(p.label, F.lit("\n"), p.text)), "\n\n")
    shown = shown.select("claim_id", source.alias("source"), prompt(F.col("claim"), source).alias("prompt"))
    every = claims.select("claim_id").join(asked(shown, make, concurrency=concurrency), "claim_id", "left")
    return judged(every.withColumn("in_range", F.col("source").isNotNull()))


def default_prompt(claim, source):
    return F.concat(F.lit("PASSAGE:\n"), source, F.lit("\n\nCLAIM:\n"), claim)


def judge(claims: DataFrame, passages: DataFrame, make: Callable[[], Model], prompt=default_prompt, concurrency: int = CONCURRENCY) -> DataFrame:
    """``claim_id, verdict, evidence, error`` of claims by their cited passages, and a second time by all passages.

    ``claims`` are ``claim_id, answer_id, claim, indices``; ``passages`` are ``answer_id, position,
    label, text``, a bounded few an answer.  Only a claim that its passages do not support, and that left
    some uncited, is asked again: where all passages support it, it is miscited.
    Replies are written before they are looked at, so no call is made twice.
    """
    first = written(_asked_of(claims, passages, make, prompt, concurrency).select("claim_id", "verdict", "evidence", "error"), "verdicts")
    there = passages.groupBy("answer_id").agg(F.collect_list("position").alias("there"))
    again = first.where("verdict = 'unsupported'").select("claim_id").join(claims, "claim_id").join(there, "answer_id").where(F.size("there") > F.size("indices"))
    again = again.select("claim_id", "answer_id", "claim", F.col("there").alias("indices"))
    second = written(_asked_of(again, passages, make, prompt, concurrency).where("verdict = 'supported'").select("claim_id", F.col("evidence").alias("elsewhere")), "verdicts")
    met = first.join(second.withColumn("other", F.lit(True)), "claim_id", "left")
    return met.select("claim_id", F.when(F.col("other"), "miscited").otherwise(F.col("verdict")).alias("verdict"), F.when(F.col("other"), F.col("elsewhere")).otherwise(F.col("evidence")).alias("evidence"), "error")
