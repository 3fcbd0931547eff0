"""Folders of sheets as a source of Spark and as its sink.

The source reads all CSV and XLSX files below a folder, a partition for each group of files of about `groupbytes`; a
filter on `src` prunes files before any is read. A file that can't be read is one row with its error.

The sink writes one file for each value of `file`: sheets by the name's ending (.xlsx, else CSV), plain lines where the
rows have a column `line`. A task writes under passing names and tells the driver, which gives the files their names
when all tasks have ended and deletes what other attempts have left; an aborted job leaves nothing. Rows of a file
stream through one task, as one file is asked for; the driver sees names only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from . import store
from .files import COLUMNS, ROWS, Workbook, csv_bytes, parsed

NAME, GROUP_BYTES = "outline_sheets", 8 << 20
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
_SCHEMA = pa.schema([(c, _KINDS[k]) for c, k in (x.split() for x in ROWS.split(", "))])


def is_sheet(path: str) -> bool:
    """Whether a path is a sheet to read: not hidden, no lock file of an open workbook."""
    name = path.rpartition("/")[2]
    return name.lower().endswith((".xlsx", ".csv")) and not name.startswith((".", "~$"))


@dataclass
class Group(InputPartition):
    """Files of one task."""

    names: list[str]


class SheetReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.encoding, self.most = options["path"], options.get("encoding") or None, int(options.get("groupbytes", GROUP_BYTES))
        self.wanted: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("src",):
                self.wanted.append((type(f).__name__, f.value))
            else:
                yield f

    def _taken(self, name: str) -> bool:
        test = {"EqualTo": lambda v: name == v, "In": lambda v: name in v, "StringStartsWith": lambda v: name.startswith(v)}
        return is_sheet(name) and all(test[kind](v) for kind, v in self.wanted)

    def partitions(self) -> list[InputPartition]:
        groups, size = [], 0
        for name, n in store.below(self.folder):
            if self._taken(name):
                if not groups or size + n > self.most:
                    groups.append(Group([]))
                    size = 0
                groups[-1].names.append(name)
                size += n
        return groups or [Group([])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        for name in partition.names:
            try:
                raw = store.read(f"{self.folder}/{name}")
                rows = parsed(name, raw, self.encoding)
            except OSError as e:
                rows = [(name, *[None] * (len(COLUMNS) - 2), f"{type(e).__name__}: {e}"[:300])]
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


class _Csv:
    def __init__(self, f, encoding: str | None):
        self.f, self.encoding = f, encoding or "utf-8"
        f.write(b"\xef\xbb\xbf" * (encoding is None) + csv_bytes([], self.encoding, head=True))

    def rows(self, rows: list[tuple]) -> None:
        self.f.write(csv_bytes(rows, self.encoding))

    def close(self) -> None:
        pass


class _Lines(_Csv):
    def __init__(self, f, encoding: str | None):
        self.f, self.encoding = f, encoding or "utf-8"

    def rows(self, rows: list[tuple]) -> None:
        self.f.write("".join(f"{line}\n" for (line,) in rows).encode(self.encoding))


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: passing name and name."""

    files: list[tuple[str, str]]


class SheetWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType):
        self.folder, self.names = options["path"].rstrip("/"), schema.names
        self.stage = f"{self.folder}/.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, own, open_ = [], f"{self.stage}/{uuid.uuid4().hex}", None
        values = ["line"] if "line" in self.names else COLUMNS[3:-1]

        def close() -> None:
            if open_:
                open_[1].close()
                open_[2].close()

        for b in iterator:
            t = b.to_pydict()
            files = t["file"]
            encodings = t.get("encoding") or [None] * len(files)
            rows = list(zip(*(t[c] for c in values), strict=True))
            at = 0
            while at < len(files):
                to = at + 1
                while to < len(files) and files[to] == files[at]:
                    to += 1
                if not open_ or open_[0] != files[at]:
                    close()
                    place, path = store.of(f"{own}/{len(done)}")
                    place.create_dir(path.rpartition("/")[0], recursive=True)
                    f = place.open_output_stream(path)
                    kind = _Lines(f, encodings[at]) if values == ["line"] else Workbook(f) if files[at].lower().endswith(".xlsx") else _Csv(f, encodings[at])
                    open_ = files[at], kind, f
                    done.append((f"{own}/{len(done)}", files[at]))
                open_[1].rows(rows[at:to])
                at = to
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        moves = [x for m in messages if m for x in m.files]
        if len({name for _, name in moves}) != len(moves):
            self.abort(messages)
            raise ValueError("the rows of a file were in several tasks; see write_files()")
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda x: store.move(x[0], f"{self.folder}/{x[1]}"), moves))
        store.delete(self.stage)

    def abort(self, messages: list[Written | None]) -> None:
        store.delete(self.stage)


class Sheets(DataSource):
    """Options: path (a folder); to read, encoding (else it is detected) and groupbytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(self.options, schema)


def read_folder(spark: SparkSession, folder: str, encoding: str | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """ROWS of all sheets below a folder; src is the path below it. Filters on src prune files. An empty or missing folder has no rows."""
    spark.dataSource.register(Sheets)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).option("encoding", encoding or "").option("groupbytes", group_bytes).load(folder)


def write_files(rows: DataFrame, folder: str, *order: str) -> None:
    """Write one file of the folder for each value of `file` (a path below it; a file of that name is replaced). rows: file, encoding if any (null: UTF-8 behind a mark in CSV files), and either ord, filename, depth, title, page in order of ord, or line; order: columns by which a file's rows come, after ord for sheets."""
    rows.sparkSession.dataSource.register(Sheets)
    lines = "line" in rows.columns
    by = list(order) if lines else ["ord", *(c for c in (order or ("filename", "depth", "title", "page")) if c != "ord")]
    values = ["line"] if lines else COLUMNS[3:-1]
    dealt = rows.repartition("file").sortWithinPartitions("file", *by).select("file", *(c for c in ("encoding",) if c in rows.columns), *values)
    dealt.write.format(NAME).mode("append").option("path", folder).save()
