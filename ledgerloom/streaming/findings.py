"""Risk findings as a stream of files, whose failures are kept as gaps beside the findings.

Each micro-batch writes ``findings``, ``gaps`` and, last, its row of ``log``: how many
issues it saw, mapped or not, how many gaps it left, and whether it came to its end.  All three lie in a folder
``batch=<id>`` of their table and are overwritten, so a batch that is run again
(after a lost driver, or because the checkpoint was not written) adds nothing.  Readers
take the batches that the log names; what a broken batch wrote is not seen.  A batch's
row of the log is taken away before the batch is written, also when it is run again.

The counts are observed while the rows are written (``observe``), not counted again.

A failure of a batch ends the stream and does not propagate: it is one more gap, with what came before kept, and the run that
:func:`outcome` makes of the tables is partial, so no report can be built from
it.  A later call goes on with the batch that failed; if it succeeds, its rows
replace the gap.  What no gap tells of is raised: a failure outside of a batch, or one whose gap could not be written.  Who reads
the tables and not the run asks for ``strict``, which raises every failure.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import steps
from ..operators.rules import RiskConfig, evaluate
from ..plans.gates import CompleteRun, PartialRun, seal
from ..schemas import CITATION, GAP, ISSUE
from ..sources.ingest import failure_reason

ROW = ISSUE + ", error string"
TABLES = {
    "findings": f"issue_key string, project_key string, rule_ordinal int, rule_id string, level string, detail string, citations array<{CITATION}>",
    "gaps": GAP,
    "log": "seen long, gaps long, whole boolean",
}


def split(rows: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(issues, gaps) of issue rows that may carry an ``error`` instead; one without a key, project or time of creation is a gap."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    mapped = F.col("key").isNotNull() & F.col("project_key").isNotNull() & F.col("created_at").isNotNull()
    reason = F.when(failed, failure_reason(F.col("error"))).otherwise("unmappable_issue")
    gaps = rows.where(failed | ~mapped).select(reason.alias("reason"), F.coalesce("project_key", F.lit("sync")).alias("scope"), F.when(failed, F.col("error")).otherwise(F.coalesce("key", F.lit("an issue without a key"))).alias("detail"), at.alias("at"))
    return rows.where(~failed & mapped).drop("error"), gaps


class Recorder:
    """The tables of a stream under one folder, and the body of its micro-batches."""

    def __init__(self, spark: SparkSession, path: str, now: Column, cfg: RiskConfig | None = None, rules=None):
        self.spark, self.path, self.now, self.cfg = spark, path.rstrip("/"), now, cfg
        self.rules = {} if rules is None else {"rules": rules}
        self.failure: Exception | None = None  # that ended the last batch, and has its gap
        self.open: int | None = None  # the batch of whose end the log does not tell yet

    def _put(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def record(self, rows: DataFrame, batch: int) -> None:
        """Write one batch; written again, it replaces itself."""
        seen, lost = Observation(f"seen-{batch}"), Observation(f"lost-{batch}")
        spark = rows.sparkSession
        self.failure, self.open = None, batch
        steps.delete(spark, f"{self.path}/log/batch={batch}")
        rows = rows.persist()  # read by both writes
        try:
            issues, gaps = split(rows, self.now)
            issues = issues.observe(seen, F.count(F.lit(1)).alias("n"))
            self._put(evaluate(issues, self.cfg, self.now, **self.rules), "findings", batch)
            self._put(gaps.observe(lost, F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason") == "unmappable_issue").alias("unmapped")), "gaps", batch)
            log = (seen.get["n"] + lost.get["unmapped"], lost.get["n"], True)
            self._put(spark.createDataFrame([log], TABLES["log"]).coalesce(1), "log", batch)
        except Exception as e:
            self._failed(spark, batch, e)
            self.failure, self.open = e, None
            raise
        finally:
            rows.unpersist()
        self.open = None

    def _failed(self, spark: SparkSession, batch: int, e: Exception) -> None:
        text = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:500]
        gap = spark.range(1).select(failure_reason(F.lit(text)).alias("reason"), F.lit("sync").alias("scope"), F.lit(text).alias("detail"), self.now.alias("at"))
        self._put(spark.createDataFrame([], TABLES["findings"]), "findings", batch)
        self._put(gap, "gaps", batch)
        self._put(spark.createDataFrame([(0, 1, False)], TABLES["log"]).coalesce(1), "log", batch)

    def table(self, name: str) -> DataFrame:
        """Rows of the batches that the log names, with their ``batch``."""
        every = self.spark.read.schema(TABLES[name] + ", batch long")
        at = f"{self.path}/{name}"
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        if not fs.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(fs):
            return self.spark.createDataFrame([], TABLES[name] + ", batch long")
        rows = every.parquet(at)
        return rows if name == "log" else rows.join(F.broadcast(self.table("log").select("batch")), "batch", "left_semi")  # a row a batch


def stream_findings(spark: SparkSession, issues_path: str, out_path: str, checkpoint: str, now: Column, cfg: RiskConfig | None = None) -> None:
    """Read the issue files that are there (and were not read before), and append their findings alone: a failure is raised."""
    issues = spark.readStream.schema(ISSUE).parquet(issues_path)
    query = evaluate(issues, cfg, now).writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def record_findings(spark: SparkSession, issues_path: str, out_path: str, checkpoint: str, now: Column, cfg: RiskConfig | None = None, files: int | None = None, rules=None, strict: bool = False) -> CompleteRun | PartialRun:
    """Read the issue files that are there and were not read before, ``files`` a batch; what the tables then come to.

    With ``strict``, a failure that is kept as a gap is raised as well.
    """
    recorder = Recorder(spark, out_path, now, cfg, rules)
    source = spark.readStream.schema(ROW)
    if files:
        source = source.option("maxFilesPerTrigger", files)
    query = source.parquet(issues_path).writeStream.foreachBatch(recorder.record).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if recorder.failure is None:  # no gap tells of it
            raise
    if recorder.open is not None:  # a stream that is stopped ends without an exception
        raise RuntimeError(f"the stream ended within batch {recorder.open}, and no gap tells of it")
    if strict and recorder.failure is not None:
        raise recorder.failure
    return outcome(recorder)


def outcome(recorder: Recorder) -> CompleteRun | PartialRun:
    """The run as sealed by its gaps: findings only where there is none."""
    seen = recorder.table("log").agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("n")).first().n
    return seal(recorder.table("findings").drop("batch"), recorder.table("gaps").drop("batch"), seen)
