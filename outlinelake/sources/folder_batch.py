"""The batch over a folder, from scan to log: sheets are read, the first sheet with a document's rows wins, each document
with rows is backed up and gets its outline, and a log tells what became of each.

A document's file is renamed to `<name>.backup`, written anew from the backup and read again; whatever fails puts the
backup back. Tasks that run again are told from backups of earlier batches by a mark of this batch, left before the
rename: a marked document is put back first and then done once more, so a batch that loses executors ends as if it
hadn't. (Speculative execution must be off, as two attempts at once would both rename.)

Writing documents needs a library of their format, so `apply` is a parameter: a function of a document's bytes and its
outline's rows that gives the new bytes or raises, and `verify` says whether bytes are a document.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batch
from . import sheets, store
from .files import UNREADABLE

OUTLINE = "array<struct<ord:bigint,rank:bigint,sheet:int,src_row:bigint,depth:bigint,title:string,page:bigint>>"
LOG = "path string, outcome string, bookmark_count long, error string"
#: What a written outline stands behind.
TRAILER = b"\n%outline "


def appended(raw: bytes, outline: list[tuple]) -> bytes:
    """A document with its outline as a line of JSON behind it: effective depth, title, page of each row. Only bytes that start as a document does are one."""
    if not raw.startswith(b"%PDF"):
        raise ValueError("not a document")
    rows, at = [], -1
    for depth, title, page in outline:
        at = min(depth, at + 1)
        rows.append([at, title, page])
    return raw.split(TRAILER)[0] + TRAILER + json.dumps(rows, ensure_ascii=False).encode()


def whole(raw: bytes) -> bool:
    """Whether bytes are a document with an outline that can be read."""
    try:
        return raw.startswith(b"%PDF") and bool(json.loads(raw.rpartition(TRAILER)[2]))
    except ValueError:
        return False


def one_document(folder: str, path: str, outline: list[tuple], mark: str, apply: Callable, verify: Callable) -> tuple[str, str | None]:
    """Back up a document, write it anew, read it again: the outcome and the error of a failure."""
    file, marked = f"{folder}/{path}", f"{folder}/{mark}/{hashlib.sha256(path.encode()).hexdigest()}"
    backup = f"{file}.backup"
    if store.exists(marked) and store.exists(backup):  # an earlier attempt of this batch got so far
        store.move(backup, file)
    if store.exists(backup):
        return "SkippedBackupExists", None
    store.write(marked, b"")
    try:
        store.move(file, backup)
    except OSError as e:
        return "FailedRename", str(e)
    try:
        store.write(file, apply(store.read(backup), outline))
    except Exception as e:  # noqa: BLE001  whatever is wrong with a document is told in the log
        store.move(backup, file)
        return "FailedWrite", str(e) or type(e).__name__
    if not verify(store.read(file)):
        store.move(backup, file)
        return "FailedVerify", None
    return "Success", None


def _process(folder: str, mark: str, open_file: str | None, apply: Callable, verify: Callable, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for path, outline in zip(b["path"], b["outline"], strict=True):
            n = None if outline is None else len(outline)
            if n is None:
                out.append((path, "SkippedNoRows", None, None))
            elif path == open_file:
                out.append((path, "SkippedOpenFile", n, None))
            else:
                out.append((path, *_swapped(one_document(folder, path, [(int(r["depth"]), r["title"], int(r["page"])) for r in outline], mark, apply, verify), n)))
        yield pd.DataFrame(out, columns=["path", "outcome", "bookmark_count", "error"]).astype({"bookmark_count": "Int64"})


def _swapped(done: tuple[str, str | None], n: int) -> tuple[str, int, str | None]:
    return done[0], n, done[1]


@dataclass
class Job:
    """A batch that is prepared and has touched nothing: documents (path, key), sources (path, rank), the winning rows (key, rank, sheet, src_row, ord, depth, title, page) and notes (rank, key, note)."""

    folder: str
    documents: DataFrame
    sources: DataFrame
    rows: DataFrame
    notes: DataFrame

    def matched(self) -> DataFrame:
        """matched: how many documents have rows."""
        return self.documents.join(self.rows.select("key").distinct(), "key", "left_semi").agg(F.count(F.lit(1)).alias("matched"))


def prepare(spark: SparkSession, folder: str) -> Job:
    """The batch of a folder; a ValueError says what forbids it. Names are compared composed, paths are below the folder."""
    names = [n for n, _ in store.below(folder) if not n.rpartition("/")[2].startswith((".", "~$"))]
    found = [n for n in names if n.lower().endswith(".pdf")]
    read = [n for n in names if sheets.is_sheet(n)]
    if said := batch.preconditions(len(found), len(read)):
        raise ValueError(said)
    documents = spark.createDataFrame([(n, unicodedata.normalize("NFC", n.rpartition("/")[2])) for n in found], "path string, key string")
    sources = batch.source_rank(spark.createDataFrame([(n,) for n in read], "path string"))
    table = sheets.read_folder(spark, folder).join(sources.withColumnRenamed("path", "src"), "src")
    good = table.where("error is null").select(batch.nfc(F.col("filename")).alias("key"), "rank", "sheet", "src_row", "ord", "depth", "title", "page")
    warned = table.where("error is not null").select("rank", F.lit("").alias("key"), F.format_string(UNREADABLE, batch.relative(F.col("src"), F.lit("")), F.col("error")).alias("note"))
    lost = batch.duplicate_notes(good, sources).select("rank", "key", "note")
    return Job(folder, documents, sources, batch.first_source_wins(good).where("rank = winner").drop("winner"), warned.unionByName(lost))


def outlines(job: Job) -> DataFrame:
    """key, outline (OUTLINE, in the order of rows) of the winning rows."""
    return job.rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ord", "rank", "sheet", "src_row", "depth", "title", "page"))).alias("outline"))


def run(job: Job, open_file: str | None = None, apply: Callable = appended, verify: Callable = whole) -> DataFrame:
    """LOG of every document, once it is done. An outline is held whole by the task that writes its document."""
    spark, mark = job.documents.sparkSession, f".batch-{uuid.uuid4().hex}"
    work = job.documents.join(outlines(job), "key", "left").select("path", "outline")
    log = work.mapInPandas(partial(_process, job.folder, mark, open_file, apply, verify), LOG)
    kept = store.scratch(spark, "batch-log")
    log.write.parquet(kept)  # once, as doing it again would find its own backups
    store.delete(f"{job.folder}/{mark}")
    return spark.read.schema(LOG).parquet(kept)


def write_log(job: Job, log: DataFrame, started: Column, title: str = batch.LOG_TITLE) -> str:
    """Write the batch's log into its folder; the file's name."""
    name = log.sparkSession.range(1).select(batch.log_name(started)).first()[0]
    lines = batch.log_file(log, job.sources, job.notes, job.folder, started, title)
    sheets.write_files(lines.withColumn("file", F.lit(name)), job.folder, "section", "rank", "name")
    return name


def _lines(folder: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for name in b["file"]:
            text = store.read(f"{folder}/{name}").decode().split("\n")[:-1]
            yield pd.DataFrame({"file": name, "n": range(1, len(text) + 1), "line": text})


def read_lines(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """file, n (from 1), line of logs."""
    return spark.createDataFrame([(n,) for n in names], "file string").mapInPandas(partial(_lines, folder), "file string, n long, line string")
