"""Folders of documents and sheets as tables: scan, CSV and XLSX reading and writing, logs, staged saves, sessions.

Rows keep `src` (the file) and `src_row` (their place in it), as a DataFrame has no order of its own. CSV files are
strict (one bad number rejects the file), workbooks lenient (cell by cell). A file that can't be read gives one row
with `error`, never an exception.
"""

from __future__ import annotations

import csv
import io
import math
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from decimal import Decimal
from typing import TYPE_CHECKING
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pandas as pd

#: Fixed values of the interchange format.
HEADERS = ["순서", "파일명", "계층", "북마크명", "페이지번호"]
U32 = 4294967295
MISSING_COLUMN, NOT_A_NUMBER = "필수 컬럼 '%s'을 찾을 수 없음", "%s 컬럼이 숫자가 아님"
NO_SHEET = "필수 컬럼(파일명/계층/북마크명/페이지번호)을 갖춘 시트를 찾을 수 없음 (%d개 시트 검사)"
UNREADABLE = "[경고] 북마크 파일 '%s' 읽기 실패 — 무시함: %s"
ROWS = "src string, sheet int, src_row long, ord long, filename string, depth long, title string, page long, error string"
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, ext of all pdf, xlsx and csv files below a folder. Files that start with . or ~$ are left out; hidden folders are entered, links not followed, unreadable folders passed over."""
    found = []
    for at, _, names in os.walk(folder, followlinks=False):
        for n in names:
            ext = n.rpartition(".")[2].lower() if "." in n else ""
            if ext in ("pdf", "xlsx", "csv") and not n.startswith((".", "~$")) and not os.path.islink(f"{at}/{n}"):
                found.append((f"{at}/{n}", n, ext))
    return spark.createDataFrame(found, "path string, name string, ext string")


def decode(raw: bytes, encoding: str | None = None) -> str:
    """Text by the encoding given, else by detection (see encodings.detect())."""
    from ..functions.encodings import detect  # not above: what plans sources and sinks on the driver needs no numpy or pandas

    return raw.decode(encoding, "replace") if encoding else detect(raw)[1]


def number(text: str) -> int:
    """A trimmed unsigned 32-bit number."""
    s = text.strip()
    if not re.fullmatch(r"\+?[0-9]+", s) or int(s) > U32:
        raise ValueError(f"not a number: {text!r}")
    return int(s)


def parse_csv(text: str) -> list[tuple]:
    """(ord, filename, depth, title, page) of each record; columns are found by header. Quotes are taken as they come; records of another length and numbers that are none reject the file."""
    csv.field_size_limit(1 << 30)
    records = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    head = [h.strip().lstrip("\ufeff") for h in records[0]] if records else []
    if missing := [h for h in HEADERS[1:] if h not in head]:
        raise ValueError(MISSING_COLUMN % missing[0])
    at = {h: head.index(h) for h in HEADERS if h in head}

    def of(r: list[str], h: str) -> int:
        try:
            return number(r[at[h]])
        except ValueError:
            raise ValueError(NOT_A_NUMBER % h) from None

    out = []
    for i, r in enumerate(records[1:]):
        if len(r) != len(head):
            raise ValueError(f"record {i + 1} has {len(r)} fields, not {len(head)}")
        out.append((of(r, HEADERS[0]) if HEADERS[0] in at else i + 1, r[at[HEADERS[1]]], of(r, HEADERS[2]), r[at[HEADERS[3]]], of(r, HEADERS[4])))
    return out


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheets(raw: bytes) -> list[list[list]]:
    """The cells of every sheet of a workbook, in order, from the first row with a value to the last, blank rows between them included: numbers as floats, truth values as such, others as strings, gaps as None."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", _NS)) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", _NS):
            target = rels[s.get(_REL)]
            tree, rows = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")), {}
            at = 0
            for row in tree.iterfind("m:sheetData/m:row", _NS):
                cells: list = []
                at = int(row.get("r", at + 1))
                for c in row.iterfind("m:c", _NS):
                    letters = re.match(r"[A-Z]+", c.get("r", ""))
                    place = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    cells += [None] * (place + 1 - len(cells))
                    value, kind = c.find("m:v", _NS), c.get("t", "n")
                    if kind == "inlineStr":
                        cells[place] = "".join(t.text or "" for t in c.iterfind(".//m:t", _NS))
                    elif value is not None and value.text is not None:
                        cells[place] = shared[int(value.text)] if kind == "s" else float(value.text) if kind == "n" else value.text == "1" if kind == "b" else value.text
                if any(x is not None for x in cells):
                    rows[at] = cells
            out.append([rows.get(k, []) for k in range(min(rows), max(rows) + 1)] if rows else [])
    return out


_FLOAT = re.compile(r"[+-]?(inf(inity)?|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)", re.IGNORECASE)


def cell_number(x, otherwise: int) -> int:
    """A number, a text that is one or a truth value, cut to a whole number within 32 bits; else the default."""
    if isinstance(x, str):
        x = float(x) if _FLOAT.fullmatch(x) else None
    if x is None:
        return otherwise
    x = float(x)
    return 0 if math.isnan(x) else max(0, min(U32, int(x) if math.isfinite(x) else U32 if x > 0 else 0))


def cell_text(x) -> str:
    """A cell as it is shown: no text for a gap, numbers without an exponent, whole ones without a point."""
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float) and math.isfinite(x):
        return str(int(x)) if x == int(x) else format(Decimal(repr(x)), "f")
    return "" if x is None else str(x)


def parse_xlsx(raw: bytes) -> list[tuple]:
    """(sheet, ord, filename, depth, title, page) of all rows of all sheets that have the columns."""
    out, valid, every = [], False, sheets(raw)
    for k, rows in enumerate(every):
        head = [cell_text(x).strip() for x in rows[0]] if rows else []
        if any(h not in head for h in HEADERS[1:]):
            continue
        valid, at = True, {h: head.index(h) for h in HEADERS if h in head}
        for i, r in enumerate(rows[1:]):
            get = lambda h, r=r: r[at[h]] if h in at and at[h] < len(r) else None
            out.append((k, cell_number(get(HEADERS[0]), i + 1), cell_text(get(HEADERS[1])), cell_number(get(HEADERS[2]), 0), cell_text(get(HEADERS[3])), cell_number(get(HEADERS[4]), 1)))
    if not valid:
        raise ValueError(NO_SHEET % len(every))
    return out


def parsed(name: str, raw: bytes, encoding: str | None = None) -> list[tuple]:
    """A file's rows as COLUMNS; one row with the error of a file that can't be read."""
    try:
        rows = parse_xlsx(raw) if name.lower().endswith(".xlsx") else [(0, *r) for r in parse_csv(decode(raw, encoding))]
        return [(name, r[0], i, *r[1:], None) for i, r in enumerate(rows)]
    except Exception as e:  # noqa: BLE001  whatever is wrong with a file is told in its row
        return [(name, None, None, None, None, None, None, None, (str(e) or type(e).__name__)[:300])]


def _read(encoding: str | None, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pandas as pd

    for b in batches:
        out = [r for path, raw in zip(b["path"], b["content"], strict=True) for r in parsed(path, bytes(raw), encoding)]
        yield pd.DataFrame(out, columns=COLUMNS).astype({c: "Int64" for c in ("sheet", "src_row", "ord", "depth", "page")})


def read_sheets(spark: SparkSession, paths: list[str], encoding: str | None = None) -> DataFrame:
    """Rows of CSV and XLSX files, read in parallel, one file whole in one task; unreadable files give a row with error."""
    if not paths:
        return spark.createDataFrame([], ROWS)
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(lambda b: _read(encoding, b), ROWS)


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and a note for each file that couldn't be read."""
    note = F.format_string(UNREADABLE, "src", "error")
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("src", note.alias("note"))


def _in_order(rows: DataFrame) -> Iterator:
    return rows.orderBy("ord").select("ord", "filename", "depth", "title", "page").toLocalIterator()


def write_csv(rows: DataFrame, path: str) -> None:
    """One file with a UTF-8 mark and a header; rows stream through the driver in order. For many documents, see sheets.write_files()."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(HEADERS)
        w.writerows(_in_order(rows))


_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_NS["m"]}" xmlns:r="{_REL[1:-3]}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
}


def _cell(text: str) -> str:
    clean = escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", text)).replace("\r", "&#13;")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{clean}</t></is></c>'


class Workbook:
    """A workbook of one sheet that is written row by row to an open file: numbers as numbers, text inline."""

    def __init__(self, f):
        self.zip = zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED)
        for name, part in _PARTS.items():
            self.zip.writestr(zipfile.ZipInfo(name), part)
        self.sheet = self.zip.open(zipfile.ZipInfo("xl/worksheets/sheet1.xml"), "w")
        self.sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS["m"]}"><sheetData><row>{"".join(map(_cell, HEADERS))}</row>'.encode())

    def rows(self, rows: Iterable[tuple]) -> None:
        number = lambda x: f"<c><v>{x}</v></c>"
        self.sheet.write("".join(f"<row>{number(o)}{_cell(name or '')}{number(depth)}{_cell(title or '')}{number(page)}</row>" for o, name, depth, title, page in rows).encode())

    def close(self) -> None:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.zip.close()


def csv_bytes(rows: Iterable[tuple], encoding: str = "utf-8", head: bool = False) -> bytes:
    """Rows as CSV, behind the header if asked."""
    f = io.StringIO(newline="")
    w = csv.writer(f, lineterminator="\n")
    w.writerows([HEADERS, *rows] if head else rows)
    return f.getvalue().encode(encoding)


def write_xlsx(rows: DataFrame, path: str) -> None:
    """A workbook of one sheet; rows stream through the driver in order. For many documents, see sheets.write_files()."""
    with open(path, "wb") as f:
        book = Workbook(f)
        book.rows(_in_order(rows))
        book.close()


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """A text file of (path, line) rows in path order, or in another."""
    with open(path, "w", encoding="utf-8") as f:
        for row in lines.orderBy(*(order or ("path",))).select("line").toLocalIterator():
            f.write(row[0] + "\n")


def staged_save(df: DataFrame, path: str) -> int:
    """Write to a folder beside the target, read it again and compare the counts, then exchange the folders; on a difference or an error the old one stays or comes back."""
    part, old = f"{path}.part-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    try:
        df.write.parquet(part)
        n = df.sparkSession.read.parquet(part).count()
        if n != df.count():
            raise OSError("what was written isn't what was read again")
        if os.path.exists(path):
            os.rename(path, old)
        try:
            os.rename(part, path)
        except OSError:
            if os.path.exists(old):
                os.rename(old, path)
            raise
    finally:
        shutil.rmtree(part, ignore_errors=True)
    shutil.rmtree(old, ignore_errors=True)
    return n


SNAPSHOT = "clean_exit boolean, file_path string, bookmarks string, saved_at timestamp"


def autosave(sessions: DataFrame) -> DataFrame:
    """session, state (JSON) of the last snapshot of each session with a file: clean_exit is true where nothing was unsaved. sessions: session, saved_at, dirty, file_path, bookmarks."""
    last = sessions.where("file_path is not null").groupBy("session").agg(F.max(F.struct("saved_at", "dirty", "file_path", "bookmarks")).alias("s"))
    return last.select("session", F.to_json(F.struct((~F.col("s.dirty")).alias("clean_exit"), "s.file_path", "s.bookmarks", "s.saved_at")).alias("state"))


def recover(saved: DataFrame) -> DataFrame:
    """session, file_path, bookmarks of snapshots that can be read and weren't a clean exit."""
    s = saved.select("session", F.from_json("state", SNAPSHOT).alias("s"))
    return s.where("s.clean_exit = false and s.file_path is not null").select("session", "s.file_path", "s.bookmarks")


def session_store(sessions: DataFrame) -> DataFrame:
    """session, store (JSON): last file, last page, recent files. sessions: session, last_file, last_page, recent."""
    return sessions.select("session", F.to_json(F.struct("last_file", "last_page", "recent")).alias("store"))


def outline_rows(read: DataFrame) -> DataFrame:
    """Outline entries as a document library gives them (doc, ord, title, page0), with its defaults: empty title, page 1."""
    return read.select("doc", "ord", "depth", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.col("page0") + 1, F.lit(1)).cast("long").alias("page"))
