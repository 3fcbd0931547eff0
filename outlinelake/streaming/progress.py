"""The folder batch in steps, as a stream over its stored work: totals after each step, and a restart that goes on.

plan() stores what a batch is to do, a file for some documents; run() streams those files, and each micro-batch writes
its lines of the log to a folder of its own number. A micro-batch that is done again, because executors or the driver
were lost before it was committed, replaces that folder, and finds its documents by the batch's mark: they are put back
and done once more. So there is one line for each document, with the same outcome, however often the batch is started.

Defined results: documents without rows have a line that says so; paths that only differ in composition are documents
of their own; a folder without documents is refused by prepare(); a batch that has ended does nothing when it is run
again. An outline is held whole by the task that writes its document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import folder_batch, store
from ..sources.folder_batch import LOG, Job

WORK = f"path string, outline {folder_batch.OUTLINE}"
_COUNTS = {"success": "outcome = 'Success'", "failed": "outcome LIKE 'Failed%'", "skipped": "outcome LIKE 'Skipped%'"}


def plan(job: Job, state: str, documents_per_file: int = 1000) -> None:
    """Store the work of a batch below the folder `state`; work that is stored stays, as documents may have been changed by it."""
    if not store.exists(f"{state}/work/_SUCCESS"):
        work = job.documents.join(folder_batch.outlines(job), "key", "left").select("path", "outline")
        work.write.mode("overwrite").option("maxRecordsPerFile", documents_per_file).parquet(f"{state}/work")


def run(spark: SparkSession, folder: str, state: str, files_per_step: int = 32, open_file: str | None = None, apply: Callable = folder_batch.appended, verify: Callable = folder_batch.whole) -> DataFrame:
    """Do what plan() stored and is not done yet, in steps of some files; the log (see log())."""
    mark = f".batch-{hashlib.sha256(state.encode()).hexdigest()[:32]}"
    process = partial(folder_batch._process, folder, mark, open_file, apply, verify)

    def step(work: DataFrame, number: int) -> None:
        work.mapInPandas(process, LOG).write.mode("overwrite").parquet(f"{state}/log/step={number}")

    work = spark.readStream.schema(WORK).option("maxFilesPerTrigger", files_per_step).parquet(f"{state}/work")
    query = work.writeStream.foreachBatch(step).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    store.delete(f"{folder}/{mark}")
    return log(spark, state)


def log(spark: SparkSession, state: str) -> DataFrame:
    """path, outcome, bookmark_count, error, step of the documents done so far."""
    return spark.read.schema(f"{LOG}, step int").parquet(f"{state}/log")


def totals(done: DataFrame) -> DataFrame:
    """step, total, success, failed, skipped after each step of a log: a row for each step, summed up in their order."""
    each = done.groupBy("step").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.expr(is_it)).alias(name) for name, is_it in _COUNTS.items()))
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("step", *(F.sum(c).over(before).alias(c) for c in ("total", *_COUNTS)))
