"""Resumable stages: ledgers of finished rows, in batch and as a stream."""

from __future__ import annotations

import time
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.score import last_of_each
from ..operators.judging import LABELS
from ..report import progress
from ..sources.ingest import existing
from ..storage import mark, release, scratch


def valid_label() -> Column:
    return F.col("judge_label").isin(*LABELS)


def pending(rows: DataFrame, ledger: DataFrame, key: str = "row_id", done: Column | None = None) -> DataFrame:
    """Rows that aren't done. done: which ledger rows count; all, if None (else failed rows come again)."""
    finished = ledger if done is None else ledger.filter(done)
    return rows.join(finished.select(key), key, "left_anti")


def latest(ledger: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key: the latest valid one, or if there is none the latest."""
    newest = F.struct(F.coalesce(valid_label(), F.lit(False)).alias("valid"), *order)
    return ledger.groupBy(key).agg(F.max_by(F.struct(*ledger.columns), newest).alias("_row")).select("_row.*")


def completeness(expected: DataFrame, ledger: DataFrame, key: str = "row_id") -> DataFrame:
    return expected.select(key).distinct().join(ledger.filter(valid_label()).select(key), key, "left_anti")


def run_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, step, key: str = "row_id", files: int = 1):
    """Files that arrive in `source` go through step(rows) to the ledger `out`. A batch that is run again after a crash
    writes to its own directory again, so each row is there once."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_latest(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, key: str, *order: str, files: int = 1):
    """latest() kept up to date: lines of the ledger's files that arrive in `source`, late or repeated, change the state of
    their keys. After every trigger the keys that changed are written; a batch that is run again writes the same rows again."""
    newest = F.struct(F.coalesce(valid_label(), F.lit(False)).alias("valid"), *order)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(source)
    found = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rows.columns), newest).alias("_row")).select("_row.*")
    stream = found.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()


def read_latest(spark: SparkSession, out: str, key: str, schema: str | None = None) -> DataFrame:
    """The view as the last trigger left it."""
    if not existing(spark, [out]):
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    return last_of_each(rows, [key], "batch").drop("batch")


def read_ledger(spark: SparkSession, out: str, schema: str | None = None) -> DataFrame:
    """What has been written. Before the first batch an empty frame, for which the schema is needed."""
    if not existing(spark, [out]):
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")


class Unfinished(RuntimeError):
    """Rows of a stage that no batch has finished; what was finished is in the ledger."""


def read_batches(spark: SparkSession, out: str) -> DataFrame | None:
    """All rows that the batches of a stage have finished; None before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/run=*/batch=*/*.parquet")
    if not len(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []):
        return None
    return spark.read.option("basePath", out).parquet(f"{out}/run=*/batch=*").drop("run", "batch")


def resume(
    rows: DataFrame, out: str, step: Callable[[DataFrame], DataFrame], key: str = "id", done: Column | None = None, ready: DataFrame | None = None,
    batch: int = 1000, files: int | None = None, errors: Column | None = None, watch: Callable[[dict], None] | None = None, strict: bool = True,
) -> DataFrame:
    """One run of a stage that can be stopped at any time and run again; returns the whole ledger.

    Rows that the ledger `out` hasn't done are queued in files of at most `batch` rows. A file stream takes `files` of them
    at a time (as many as the cluster has cores), puts them through step() and writes what comes back to a directory of its
    own, which is committed before the next are taken. So a driver that dies loses the batches under way and no others, a lost
    executor has only its own files done again, and a batch that is written twice replaces itself. step() may leave rows out
    that it couldn't do (providers.apply with skip): they are asked for again by the next run, and make this one end with
    Unfinished if it is strict.

    ready: rows that need no step (labelled before), written once. watch: called after each batch with what report.progress
    says of this run; errors: which of the finished rows count as failed there. The counts are taken while rows are written."""
    spark, since, started = rows.sparkSession, mark(), time.monotonic()
    if ready is not None and not existing(spark, [f"{out}/run=ready/batch=0/_SUCCESS"]):
        ready.write.mode("overwrite").parquet(f"{out}/run=ready/batch=0")
    queue, at, held = scratch(spark, "queue"), scratch(spark, "queue-at"), read_batches(spark, out)
    (rows if held is None else pending(rows, held, key, done)).write.option("maxRecordsPerFile", batch).parquet(queue)
    total, run, counts = spark.read.schema(rows.schema).parquet(queue).count(), uuid.uuid4().hex, Counter()

    def write(part: DataFrame, number: int) -> None:
        seen = Observation()
        made = step(part).observe(seen, F.count("*").alias("done"), (F.sum(F.lit(0)) if errors is None else F.count_if(errors)).alias("errors"))
        made.write.mode("overwrite").parquet(f"{out}/run={run}/batch={number}")
        counts.update({k: v or 0 for k, v in seen.get.items()})
        if watch:
            watch(progress(counts["done"], total, counts["errors"], time.monotonic() - started))

    if total:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files or spark.sparkContext.defaultParallelism).parquet(queue)
        stream.writeStream.foreachBatch(write).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    release(spark, since)
    if strict and counts["done"] < total:
        raise Unfinished(f"{total - counts['done']} of {total} rows aren't done")
    held = read_batches(spark, out)
    return spark.createDataFrame([], step(rows.limit(0)).schema) if held is None else held
