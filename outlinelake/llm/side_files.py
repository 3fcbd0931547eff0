"""Rows that belong to the texts of a scan, as files of the shared folder: one for each input partition.

What is found about texts elsewhere comes back to them by these files, so texts need no shuffle. A row number holds its
input partition (see common.numbered()), and every partition has a file, if one without rows: a file that is missing is
an error, never "nothing found". Files are written by the task that has all rows of their partition, which are bounded
by the size of an input split, and get their names by a move.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, few_shuffle_files, scan_parts, scratch, tidied


def put(folder: str, name: str, raw: bytes) -> str:
    """Write a file under a passing name, then move it to its own. A file of that name is of an earlier attempt of the same task, with the same content: where the store refuses to replace it, it stays."""
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    part = f"{base}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(raw)
    try:
        store.move(part, f"{base}/{name}")
    except OSError:
        if store.get_file_info(f"{base}/{name}").type != pafs.FileType.File:
            raise
        store.delete_file(part)
    return f"{folder}/{name}"


def get(uri: str) -> bytes:
    store, path = pafs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read()


@tidied
def _put(folder: str, change: Callable | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, p = [b for b in batches if b.num_rows], TaskContext.get().partitionId()
    t = pa.Table.from_batches(held).drop_columns("p") if held else pa.table({})
    if held and change:
        t = change(t)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    put(folder, f"{p}.arrow", sink.getvalue())
    yield pa.RecordBatch.from_pydict({"p": [p]})


def _put_none(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        pass
    yield from _put(folder, None, iter(()))


def write(rows: DataFrame, docs: DataFrame, label: str, *order: str, change: Callable | None = None) -> str:
    """Write rows, which have the row number `rid` of a row of docs, to a file for each input partition of docs, sorted by rid and `order`; the folder. change: what is done to a partition's rows (an Arrow table) before."""
    folder, parts = scratch(rows.sparkSession, label), scan_parts(docs)
    keyed = rows.select(F.shiftright("rid", 33).cast("int").alias("p"), "*").repartitionById(parts, "p")
    with few_shuffle_files(rows.sparkSession):
        found = keyed.sortWithinPartitions("rid", *order).mapInArrow(partial(_put, folder, change), "p long").agg(F.count_distinct("p")).first()[0]
    if not found:  # of a table without rows Spark runs no task
        empty = rows.sparkSession.range(0, parts, 1, parts)
        found = empty.mapInArrow(partial(_put_none, folder), "p long").agg(F.count_distinct("p")).first()[0]
    if found != parts:
        raise RuntimeError(f"{found} files were written for {parts} input partitions")
    return folder


class Side:
    """The rows of write() for the texts of a scan."""

    def __init__(self, folder: str):
        self.folder, self.p = folder, None

    def of(self, rids: np.ndarray, *columns: str) -> list[np.ndarray]:
        """Text number and `columns` of the rows of these texts, in order. rids are ascending."""
        found = []
        for p in np.unique(rids >> 33).tolist():
            if p != self.p:
                t = pa.ipc.open_stream(get(f"{self.folder}/{p}.arrow")).read_all()
                self.p, self.t = p, {c: t[c].to_numpy() for c in t.column_names}
            if self.t:
                rid = self.t["rid"]
                lo, hi = np.searchsorted(rid, [rids.min(), rids.max() + 1])
                doc = np.searchsorted(rids, rid[lo:hi])
                ok = rids[np.minimum(doc, len(rids) - 1)] == rid[lo:hi]
                found.append([doc[ok], *(x if x.dtype == object else x.astype(np.int64) for x in (self.t[c][lo:hi][ok] for c in columns))])
        if not found:
            return [np.zeros(0, np.int64)] * (1 + len(columns))
        return [np.concatenate(x) for x in zip(*found, strict=True)]


@tidied
def _having(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    side = Side(folder)
    for b in batches:
        if b.num_rows:
            (mine,) = side.of(b.column("rid").to_numpy())
            if len(mine):
                yield b.select(["row"]).take(pa.array(mine))


def having(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose number (see numbered()) is among `rids`. Rows stay where they are read; no columns, no rows."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"))
    kept = write(rids.select("rid"), bounded(docs), "kept")
    return rows.mapInArrow(partial(_having, kept), rows.select("row").schema).select("row.*")


@tidied
def _put_keyed(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by p: a file for each p."""
    held: list[pa.RecordBatch] = []

    def write() -> int:
        t = pa.Table.from_batches(held)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
        p = t["p"][0].as_py()
        put(folder, f"{p}.arrow", sink.getvalue())
        held.clear()
        return p

    done = []
    for b in batches:
        p = b.column("p").to_numpy()
        cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a < z:
                if held and held[-1].column("p")[0].as_py() != p[a]:
                    done.append(write())
                held.append(b.slice(a, z - a))
    if held:
        done.append(write())
    yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["p"])


def keyed_files(rows: DataFrame, order: list[str], label: str, parts: int, task: Column | None = None) -> str:
    """Write rows to one Arrow file for each value of p (not null), sorted; the folder. The rows of a p are held by one task, the one whose number `task` gives (below parts; p if it isn't named), so tasks have what they are meant to have and not what a hash of few numbers gives them."""
    folder = scratch(rows.sparkSession, label)
    dealt = rows.repartitionById(parts, (F.col("p") if task is None else task).cast("int")).sortWithinPartitions("p", *order)
    with few_shuffle_files(rows.sparkSession):
        dealt.mapInArrow(partial(_put_keyed, folder), "p long").agg(F.count(F.lit(1))).first()
    return folder


def keyed_file(folder: str, p: int) -> pa.Table | None:
    """The rows of keyed_files() with this p; None if there are none."""
    with suppress(FileNotFoundError):
        return pa.ipc.open_stream(get(f"{folder}/{p}.arrow")).read_all()
    return None


def quoted(name: str) -> str:
    """A column's name as F.col() takes it, dots and all."""
    return f"`{name.replace('`', '``')}`"
