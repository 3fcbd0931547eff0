"""The folder source and sink, encodings, and the batch over a folder, with failures at every step."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from outlinelake.functions import encodings
from outlinelake.operators import batch
from outlinelake.sources import files, folder_batch, sheets, store
from outlinelake.streaming import progress

SHEET = "file string, encoding string, ord long, filename string, depth long, title string, page long"
APART = unicodedata.normalize("NFD", "문서")


def row(file, ord_, name, title="t", page=1, depth=0, encoding=None):
    return file, encoding, ord_, name, depth, title, page


def test_folder_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/a b#c%20"
    titles = ['제목 "하나", 둘', "줄\r\n바꿈\r끝\t", "<&>\x07", "", "x" * 140_000]
    rows = [row(f, i, "문서.pdf", t, i + 1, i % 2, "cp949" if f.startswith("legacy") else None) for f in ("d/é 1.csv", "b.xlsx", "legacy.csv") for i, t in enumerate(titles)]
    sheets.write_files(spark.createDataFrame(rows, SHEET).repartition(5), folder)
    assert [n for n, _ in store.below(folder)] == ["b.xlsx", "d/é 1.csv", "legacy.csv"]
    read = sheets.read_folder(spark, folder, group_bytes=10)
    assert read.rdd.getNumPartitions() == 3
    got = sorted((r.src, r.src_row, r.ord, r.filename, r.depth, r.title, r.page, r.error) for r in read.collect())
    shown = lambda f, t: t.replace("\x07", "") if f.endswith("xlsx") else t
    assert got == sorted((f, o, o, n, d, shown(f, t), p, None) for f, _, o, n, d, t, p in rows)
    # what is there already is replaced, other files stay
    sheets.write_files(spark.createDataFrame([row("b.xlsx", 7, "n.pdf")], SHEET), folder)
    assert read.where("src = 'b.xlsx'").select("ord").collect() == [(7,)] and read.where("src <> 'b.xlsx'").count() == 10
    assert sheets.read_folder(spark, f"{folder}/none").count() == 0


def test_filters_on_src_prune_files(spark, tmp_path):
    for n in ("a/x.csv", "a/y.csv", "b/x.csv", ".z.csv", "~$w.xlsx", "u.txt"):
        store.write(f"{tmp_path}/{n}", ",".join(files.HEADERS).encode())
    found = {}
    for name, kept in {"=": [sheets.EqualTo(("src",), "a/x.csv")], "in": [sheets.In(("src",), ("b/x.csv", "u.txt"))], "starts": [sheets.StringStartsWith(("src",), "a/")], "both": [sheets.StringStartsWith(("src",), "a/"), sheets.In(("src",), ("a/y.csv",))], "other": [sheets.EqualTo(("page",), 1)]}.items():
        r = sheets.SheetReader({"path": str(tmp_path)})
        left = list(r.pushFilters(kept))
        found[name] = sorted(n for g in r.partitions() for n in g.names), len(left)
    assert found == {"=": (["a/x.csv"], 0), "in": (["b/x.csv"], 0), "starts": (["a/x.csv", "a/y.csv"], 0), "both": (["a/y.csv"], 0), "other": (["a/x.csv", "a/y.csv", "b/x.csv"], 1)}


def test_errors_are_rows(spark, tmp_path):
    head = "파일명,계층,북마크명,페이지번호"
    bad = {"empty.csv": "", "column.csv": "파일명,계층,북마크명\na,0,b", "number.csv": f"{head}\na,0,b,1\na,0,b,-1", "depth.csv": f"{head}\na,x,b,1", "short.csv": f"{head}\na,0,b", "zip.xlsx": "no zip"}
    for n, text in bad.items():
        store.write(f"{tmp_path}/{n}", text.encode())
    store.write(f"{tmp_path}/good.csv", f'{head}\n\na"b,0,"b""c",+1\n'.encode())
    got = {r.src: r for r in sheets.read_folder(spark, str(tmp_path)).collect()}
    assert {n: got[n].error for n in ("empty.csv", "column.csv", "number.csv", "depth.csv")} == {"empty.csv": "필수 컬럼 '파일명'을 찾을 수 없음", "column.csv": "필수 컬럼 '페이지번호'을 찾을 수 없음", "number.csv": "페이지번호 컬럼이 숫자가 아님", "depth.csv": "계층 컬럼이 숫자가 아님"}
    assert got["short.csv"].error and got["zip.xlsx"].error and len(got) == 7
    assert (got["good.csv"].ord, got["good.csv"].filename, got["good.csv"].title, got["good.csv"].page) == (1, 'a"b', 'b"c', 1)
    _, notes = files.split_errors(sheets.read_folder(spark, str(tmp_path)))
    assert notes.count() == 6


def test_workbooks_with_gaps(tmp_path):
    import io
    import zipfile

    f = io.BytesIO()
    book = files.Workbook(f)
    book.rows([(1, "a", 0, "b", 2)])
    book.sheet.write('<row r="5"><c r="A5" t="b"><v>1</v></c><c r="B5"><v>1.5</v></c><c r="C5" t="str"><v>2.9</v></c><c r="E5" t="str"><v> 3</v></c></row><row r="9"/>'.encode())
    book.close()
    assert files.parse_xlsx(f.getvalue()) == [(0, 1, "a", 0, "b", 2), (0, 2, "", 0, "", 1), (0, 3, "", 0, "", 1), (0, 1, "1.5", 2, "", 1)]
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        for n, part in files._PARTS.items():
            z.writestr(n, part)
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{files._NS["m"]}"><sheetData/></worksheet>')
    with pytest.raises(ValueError, match="1개 시트 검사"):
        files.parse_xlsx(other.getvalue())


def attempt(writer, rows):
    import pyarrow as pa

    names = [c.split()[0] for c in SHEET.split(", ")]
    return writer.write(iter([pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows[k : k + 2]))))) for k in range(0, len(rows), 2)]))


def test_a_task_that_runs_twice_leaves_one_whole_file(tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SHEET)
    writer = sheets.SheetWriter({"path": str(tmp_path)}, schema)
    rows = [row("a.csv", i, "n.pdf") for i in range(5)] + [row("b.xlsx", 1, "n.pdf")]

    def dies():
        yield from ()
        raise RuntimeError

    attempt(writer, rows[:3])  # an attempt that was lost after it had written
    with pytest.raises(RuntimeError):
        writer.write(dies())
    second = attempt(writer, rows)
    assert [n for n, _ in store.below(str(tmp_path)) if not n.startswith(".writing")] == []
    writer.commit([second, None])
    assert [n for n, _ in store.below(str(tmp_path))] == ["a.csv", "b.xlsx"] and len(files.parsed("a.csv", store.read(f"{tmp_path}/a.csv"))) == 5
    again = sheets.SheetWriter({"path": str(tmp_path)}, schema)
    again.abort([attempt(again, [row("a.csv", 1, "other.pdf")]), None])
    with pytest.raises(ValueError, match="several tasks"):
        again.commit([attempt(again, rows), attempt(again, rows)])
    assert [n for n, _ in store.below(str(tmp_path))] == ["a.csv", "b.xlsx"] and len(files.parsed("a.csv", store.read(f"{tmp_path}/a.csv"))) == 5


def test_encodings():
    texts = {"EUC-KR": "제1장 총칙, 서론과 본론", "Shift_JIS": "第一章 はじめに、目次とページ", "GBK": "第一章 总则以及目录和页码", "Big5": "第一章 總則以及目錄和頁碼", "windows-1252": "Übersicht über die Straße, café", "windows-1251": "Глава первая, введение", "KOI8-R": "Глава первая, введение", "EUC-JP": "はじめに、目次とページ"}
    for name, t in texts.items():
        assert encodings.detect(t.encode(encodings.CANDIDATES[name])) == (name, t)
        assert encodings.detect(t.encode()) == ("UTF-8", t) == encodings.detect(encodings.MARK + t.encode())
    assert encodings.detect(b"") == ("UTF-8", "") and encodings.detect(b"plain") == ("UTF-8", "plain")
    name, text = encodings.detect(b"\xff\xff\x81 a")
    assert isinstance(text, str) and name


def test_accents_are_not_cyrillic():
    latin = "Of erlysh er thedtion esou atlyre isantiwhin esin thened erououon "
    western = [latin + "on on èê, le", "Anaieux éé èçou éç.lisr", latin + "e.\nAu éèeau, uenle ç sur êvi éèêé, tre", latin + "üß " * 40 + "enst", latin + "una " + "íñ " * 60 + "y Ñarie ció"]
    for t in western:
        assert encodings.detect(t.encode("cp1252")) == ("windows-1252", t)
    for t in (latin * 20 + "Иванов", "Привет, this is a long sentence in English", "USB-порт и Wi-Fi"):
        assert encodings.detect(t.encode("cp1251")) == ("windows-1251", t)


@pytest.fixture
def folder(spark, tmp_path):
    base = f"file://{tmp_path}/f"
    rows = [row("b.csv", 1, "문서1.pdf", "late"), row("b.csv", 2, APART + "2.pdf", "two", 3), row("a/s.xlsx", 2, "문서1.pdf", "second", 5, 7), row("a/s.xlsx", 1, "문서1.pdf", "first", 4), row("a/s.xlsx", 1, "bad.pdf", "x")]
    sheets.write_files(spark.createDataFrame(rows, SHEET), base)
    for name, raw in {f"z/{APART}1.pdf": b"%PDF 1", "a-b/문서2.pdf": b"%PDF 2", "a/문서2.pdf": b"%PDF 3", "bad.pdf": b"junk", "none.pdf": b"%PDF", "문서1.pdf": b"%PDF 4", "문서1.pdf.backup": b"old", "junk.csv": b"x"}.items():
        store.write(f"{base}/{name}", raw)
    return base


def test_the_whole_batch(spark, folder):
    job = folder_batch.prepare(spark, folder)
    assert job.matched().first().matched == 5 and [r.key for r in job.notes.orderBy("rank", "key").collect()] == ["문서1.pdf", ""]
    log = folder_batch.run(job, open_file="a/문서2.pdf")
    name = folder_batch.write_log(job, log, F.lit("2026-01-02 03:04:05").cast("timestamp_ntz"))
    assert name == "bookmark-import-20260102-030405.log"
    lines = [r.line for r in folder_batch.read_lines(spark, folder, [name]).orderBy("n").collect()]
    assert lines[3:6] == ["북마크 파일(읽은 순서): a/s.xlsx", "북마크 파일(읽은 순서): b.csv", "북마크 파일(읽은 순서): junk.csv"]
    assert lines[6:9] == ["[중복] 'b.csv'의 '문서1.pdf' 행 1개 건너뜀 — 먼저 읽은 'a/s.xlsx'의 행을 적용", "[경고] 북마크 파일 'junk.csv' 읽기 실패 — 무시함: 필수 컬럼 '파일명'을 찾을 수 없음", "----"]
    assert lines[9:] == [
        "[건너뜀] a/문서2.pdf — 현재 앱에 열려 있는 파일", "[성공] a-b/문서2.pdf — 북마크 1개 저장", "[실패] bad.pdf — 북마크 쓰기 실패(원본 복원됨): not a document", "[건너뜀] none.pdf — 일치하는 '파일명' 행 없음",
        "[성공] z/문서1.pdf — 북마크 2개 저장", "[건너뜀] 문서1.pdf — .backup 파일이 이미 있음(이전 실행 흔적)", "----", "전체 6개 중 2개 성공, 1개 실패, 3개 건너뜀",
    ]
    assert store.read(f"{folder}/bad.pdf") == b"junk" and store.read(f"{folder}/z/{APART}1.pdf.backup") == b"%PDF 1" and not store.exists(f"{folder}/bad.pdf.backup")
    assert store.read(f"{folder}/z/{APART}1.pdf") == b'%PDF 1\n%outline [[0, "first", 4], [1, "second", 5]]'.replace(b"second", "second".encode())
    # once more: what was written has a backup now
    again = {r.path: r.outcome for r in folder_batch.run(folder_batch.prepare(spark, folder)).collect()}
    assert again["a-b/문서2.pdf"] == "SkippedBackupExists" and again["a/문서2.pdf"] == "Success"


def test_a_batch_in_steps_that_stops_before_a_commit(spark, folder, tmp_path, monkeypatch):
    """The driver is lost after a step was done and before it was committed: the batch goes on, with a line for each document."""
    state = f"file://{tmp_path}/state"
    progress.plan(folder_batch.prepare(spark, folder), state, documents_per_file=1)
    with monkeypatch.context() as m:
        m.setattr(progress.store, "delete", lambda uri: None)  # the mark stays when the driver is lost
        first = progress.run(spark, folder, state, files_per_step=2, open_file="a/문서2.pdf").collect()
    commits = sorted((tmp_path / "state" / "checkpoint" / "commits").glob("[0-9]*"), key=lambda x: int(x.name))
    assert len(commits) == 3
    for part in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        part.unlink(missing_ok=True)
    progress.plan(folder_batch.prepare(spark, folder), state)  # what was planned stays, though documents have changed
    log = progress.run(spark, folder, state, files_per_step=2, open_file="a/문서2.pdf")
    assert sorted(map(tuple, log.collect()), key=str) == sorted(map(tuple, first), key=str)
    assert {r.path: r.outcome for r in log.collect()} == {
        "a/문서2.pdf": "SkippedOpenFile", "a-b/문서2.pdf": "Success", "bad.pdf": "FailedWrite", "none.pdf": "SkippedNoRows", f"z/{APART}1.pdf": "Success", "문서1.pdf": "SkippedBackupExists",
    }
    after = [tuple(r) for r in progress.totals(log).orderBy("step").collect()]
    assert [r[:2] for r in after] == [(0, 2), (1, 4), (2, 6)] and after[-1] == (2, 6, 2, 1, 3)
    assert store.read(f"{folder}/z/{APART}1.pdf.backup") == b"%PDF 1" and not [n for n, _ in store.below(folder) if n.startswith(".batch")]
    assert progress.run(spark, folder, state).count() == 6  # done is done


def test_what_forbids_a_batch(spark, tmp_path):
    with pytest.raises(ValueError, match="PDF"):
        folder_batch.prepare(spark, str(tmp_path))
    store.write(f"{tmp_path}/a.PDF", b"%PDF")
    with pytest.raises(ValueError, match="xlsx/csv"):
        folder_batch.prepare(spark, str(tmp_path))
    assert batch.preconditions(1, 1) is None


@pytest.mark.parametrize("step", range(6))
def test_a_document_survives_a_crash_at_each_step(tmp_path, monkeypatch, step):
    """The attempt dies before its step-th call of the store; a second attempt of the same batch ends as if there had been no first."""
    base, calls = str(tmp_path), []
    store.write(f"{base}/x.pdf", b"%PDF 1")
    with monkeypatch.context() as m:
        for name in ("move", "write", "read"):
            real = getattr(store, name)

            def dying(*args, real=real):
                calls.append(real)
                if len(calls) > step:
                    raise KeyboardInterrupt
                return real(*args)

            m.setattr(folder_batch.store, name, dying)
        try:
            folder_batch.one_document(base, "x.pdf", [(0, "t", 1)], ".run", folder_batch.appended, folder_batch.whole)
        except KeyboardInterrupt:
            pass
    assert folder_batch.one_document(base, "x.pdf", [(0, "t", 1)], ".run", folder_batch.appended, folder_batch.whole) == ("Success", None)
    assert store.read(f"{base}/x.pdf") == b'%PDF 1\n%outline [[0, "t", 1]]' and store.read(f"{base}/x.pdf.backup") == b"%PDF 1"


def test_verification_puts_the_document_back(tmp_path):
    store.write(f"{tmp_path}/x.pdf", b"%PDF 1")
    assert folder_batch.one_document(str(tmp_path), "x.pdf", [], ".run", lambda raw, rows: b"broken", folder_batch.whole) == ("FailedVerify", None)
    assert store.read(f"{tmp_path}/x.pdf") == b"%PDF 1" and not store.exists(f"{tmp_path}/x.pdf.backup")


def test_same_files(spark):
    rows = [("/a/b", "/a/./b", True), ("/a/../a/b", "/a//b", True), ("/a/b", "/a/c", False), (None, "/a", False), ("/..", "/", True)]
    got = spark.createDataFrame(rows, "a string, b string, same boolean").select(batch.same_file(F.col("a"), F.col("b")).alias("x"), "same").collect()
    assert all(r.x == r.same for r in got)


def test_logs_sort_by_components(spark):
    paths = ["a-b/x.pdf", "a/x.pdf", "a/b/x.pdf", "a.pdf"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").orderBy(batch.by_components(F.col("p"))).collect()
    assert [r.p for r in got] == sorted(paths, key=lambda p: p.split("/"))
