"""Files, batch reports, sessions and layouts."""

import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from outlinelake.functions import layout, text
from outlinelake.operators import batch
from outlinelake.sources import files
from outlinelake.streaming import session

ROWS = "ord long, filename string, depth long, title string, page long"
KOREAN = [(1, "문서.pdf", 0, '제목 "하나", 둘', 1), (2, "문서.pdf", 1, "줄\n바꿈", 7)]


@pytest.mark.parametrize("ext", ["csv", "xlsx"])
def test_round_trip(spark, tmp_path, ext):
    path = str(tmp_path / f"rows.{ext}")
    (files.write_csv if ext == "csv" else files.write_xlsx)(spark.createDataFrame(KOREAN, ROWS), path)
    assert ext != "csv" or open(path, "rb").read(3) == b"\xef\xbb\xbf"
    good, notes = files.split_errors(files.read_sheets(spark, [path]))
    assert [tuple(r) for r in good.orderBy("src_row").select("ord", "filename", "depth", "title", "page").collect()] == KOREAN
    assert notes.count() == 0


def test_legacy_and_strict_csv():
    raw = "파일명,계층,북마크명,페이지번호\n문서.pdf,0,서론,+5\n".encode("euc-kr")
    assert files.parse_csv(files.decode(raw)) == [(1, "문서.pdf", 0, "서론", 5)]
    for bad in ("-1", "3.7", "", "4294967296"):
        with pytest.raises(ValueError):
            files.parse_csv(f"파일명,계층,북마크명,페이지번호\na,0,b,{bad}\n")


def test_bad_files_are_notes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    good, notes = files.split_errors(files.read_sheets(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.xlsx")]))
    assert good.count() == 0 and notes.count() == 2
    assert files.read_sheets(spark, []).count() == 0


def test_cells():
    assert [files.cell_number(x, 9) for x in (3.9, -2.0, float("nan"), float("inf"), "4", "-1.5e1", "7.9", " 4", "4_0", "x", "", True, None)] == [3, 0, 0, files.U32, 4, 0, 7, 9, 9, 9, 9, 1, 9]
    assert [files.cell_text(x) for x in (1.0, 1.5, 1e-7, 1e21, True, False, None, "x")] == ["1", "1.5", "0.0000001", "1" + "0" * 21, "true", "false", "", "x"]


def test_scan(spark, tmp_path):
    for n in ("a.PDF", ".b.pdf", "~$c.xlsx", "d.csv", "e.txt"):
        (tmp_path / n).write_text("")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden/f.xlsx").write_text("")
    assert {r.name for r in files.scan(spark, str(tmp_path)).collect()} == {"a.PDF", "d.csv", "f.xlsx"}


def test_source_order_and_duplicates(spark):
    src = batch.source_rank(spark.createDataFrame([("a-b.csv",), ("a/b.csv",), ("나중.csv",), ("우선.xlsx",)], "path string"))
    assert [r.path for r in src.orderBy("rank").collect()] == ["우선.xlsx", "a/b.csv", "a-b.csv", "나중.csv"]
    rows = spark.createDataFrame([("a.pdf", 1), ("a.pdf", 4), ("a.pdf", 4)], "key string, rank long")
    assert batch.first_source_wins(rows).where("rank = winner").count() == 1
    (note,) = batch.duplicate_notes(rows, src).collect()
    assert note.note == "[중복] '나중.csv'의 'a.pdf' 행 2개 건너뜀 — 먼저 읽은 '우선.xlsx'의 행을 적용"


def test_batch_report(spark):
    ok = dict(is_open=False, has_backup=False, rename_ok=True, write_ok=True, parses=True)
    files_ = [dict(path=p, key=p.split("/")[-1], **ok) for p in ("a.pdf", "sub/b.pdf", "norows.pdf")] + [dict(path="bad.pdf", key="bad.pdf", **(ok | {"write_ok": False}))]
    log = batch.outcomes(spark.createDataFrame(files_), spark.createDataFrame([("a.pdf",), ("a.pdf",), ("b.pdf",), ("bad.pdf",)], "key string"))
    assert batch.stats(log).first().line == "전체 4개 중 2개 성공, 1개 실패, 1개 건너뜀"
    assert "[성공] a.pdf — 북마크 2개 저장" in {r.line for r in batch.log_lines(log).collect()}


def test_names(spark):
    nfd = unicodedata.normalize("NFD", "한글.pdf")
    row = spark.createDataFrame([(nfd, "/r/x/" + nfd)], "n string, p string").select(batch.nfc(F.col("n")).alias("n"), batch.relative(F.col("p"), F.lit("/r")).alias("p"), batch.backup_path(F.lit("/a/문서.pdf")).alias("b")).first()
    assert tuple(row) == ("한글.pdf", "x/한글.pdf", "/a/문서.pdf.backup")


def test_layout(spark):
    w = lambda *x: layout.render_width(*(F.lit(float(v)) for v in x[:3]), F.lit(x[3]))
    row = spark.range(1).select(w(2000, 612, 792, 16384), w(16000, 612, 792, 16384), w(20000, 792, 612, 16384), w(40000, 612, 612, 1000000), w(2000, 0, 792, 16384)).first()
    assert row[0] == 2000 and row[1] * 792 / 612 <= 16384 and row[2] == row[3] == 16384 and row[4] >= 50


def test_text(spark):
    pages = spark.createDataFrame([(1, 1, "a.A.a"), (1, 2, None)], "doc long, page long, text string")
    assert text.search(pages, " A. ").count() == 2 and text.search(pages, "  ").count() == 0
    row = spark.range(1).select(text.u32(F.lit(" +5 ")), text.u32(F.lit("-1")), text.u32(F.lit("4294967296")), text.export_name(F.lit("/x/.pdf"), "csv"), text.export_name(F.lit(None).cast("string"), "csv")).first()
    assert tuple(row) == (5, None, None, "bookmark-.pdf.csv", "bookmarks.csv")


def test_autosave(spark):
    t = datetime(2026, 1, 1)
    rows = [(1, t, True, "f", "[]"), (2, t, True, "f", "[]"), (2, t.replace(day=2), False, "f", "[]"), (3, t, True, None, "[]")]
    saved = files.autosave(spark.createDataFrame(rows, "session long, saved_at timestamp, dirty boolean, file_path string, bookmarks string"))
    assert [r.session for r in files.recover(saved).collect()] == [1]
    assert files.recover(spark.createDataFrame([(1, "junk")], "session long, state string")).count() == 0


def test_staged_save(spark, tmp_path):
    assert files.staged_save(spark.range(5), str(tmp_path / "t")) == 5 and files.staged_save(spark.range(3), str(tmp_path / "t")) == 3
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3 and len(list(tmp_path.iterdir())) == 1


def test_history_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    from outlinelake.plans.queries import _events

    action = F.when(F.col("event_type") == "error", "back").when(F.col("event_type") == "signup", "forward").otherwise("go")
    events = _events(spark, sf).where("session < 20").select("session", "ts", action.alias("action"), "page")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = session.page_history_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("history").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("history").collect())) == sorted(map(tuple, session.page_history(events).collect()))


def test_undo_limit(spark):
    rows = [(1, i, "edit", i) for i in range(1, 31)] + [(1, 100 + i, "undo", 0) for i in range(25)] + [(1, 200, "redo", 0)]
    (r,) = session.undo_redo(spark.createDataFrame(rows, "session long, ts long, action string, version long")).collect()
    assert (r.current, r.undo, r.redo) == (11, 1, 19)


def test_whole_log(spark, tmp_path):
    log = spark.createDataFrame([("/b/x.pdf", "Success", 3), ("/b/d/café.pdf", "FailedWrite", 1), ("/else/y.pdf", "SkippedNoRows", None)], "path string, outcome string, bookmark_count long")
    sources = spark.createDataFrame([("/b/s.xlsx", 1), ("/b/t.csv", 2)], "path string, rank long")
    notes = spark.createDataFrame([(2, "x.pdf", "note")], "rank long, key string, note string")
    started = F.lit("2026-01-02 03:04:05").cast("timestamp_ntz")
    lines = batch.log_file(log, sources, notes, "/b", started)
    files.write_lines(lines, str(tmp_path / "log"), "section", "rank", "name")
    got = (tmp_path / "log").read_text(encoding="utf-8").split("\n")
    assert got[1:3] == ["실행 시각: 2026-01-02 03:04:05", "대상 폴더: /b"]
    assert got[3:7] == ["북마크 파일(읽은 순서): s.xlsx", "북마크 파일(읽은 순서): t.csv", "note", "----"]
    assert [x.split(" — ")[0] for x in got[7:10]] == ["[건너뜀] /else/y.pdf", "[실패] d/café.pdf", "[성공] x.pdf"]
    assert got[10:] == ["----", "전체 3개 중 1개 성공, 1개 실패, 1개 건너뜀", ""]
    empty = batch.log_file(log.limit(0), sources.limit(0), notes.limit(0), "/b", started)
    assert [r.section for r in empty.orderBy("section", "rank").collect()] == [0, 0, 0, 3, 5, 6]


def test_links_at_points(spark):
    links = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, 15.0, 15.0, 5.0, 5.0), (1, 1, 2, None, 0.0, 99.0, 99.0), (1, 2, 0, 0.0, 0.0, 1.0, 1.0)], "doc long, page long, link_no long, left double, bottom double, right double, top double")
    points = spark.createDataFrame([(1, 1, 0, 2.0, 2.0), (1, 1, 1, 7.0, 7.0), (1, 1, 2, 15.0, 15.0), (1, 1, 3, 20.0, 20.0), (1, 2, 4, 7.0, 7.0), (1, 1, 5, None, 1.0)], "doc long, page long, probe long, x double, y double")
    assert {r.probe: r.link_no for r in text.links_at(links, points).collect()} == {0: 0, 1: 1, 2: 1}
    assert text.links_at(links.limit(0), points).count() == text.links_at(links, points.limit(0)).count() == 0


def test_recent_files_that_are_missing(spark):
    rows = [(1, 1, "a", True), (1, 2, "b", True), (1, 3, "a", False), (1, 4, "c", None), (1, 5, "d", False), (1, 6, "d", True), (1, 7, "e", True), (1, 7, "e", False), (2, 1, "a", False)]
    opened = spark.createDataFrame(rows, "session long, ts long, path string, found boolean")
    got = lambda df: [(r.session, r.place, r.path) for r in session.recent_files(df).orderBy("session", "place").collect()]
    assert got(opened) == [(1, 1, "e"), (1, 2, "d"), (1, 3, "c"), (1, 4, "b")]
    assert got(opened.drop("found")) == [(1, 1, "e"), (1, 2, "d"), (1, 3, "c"), (1, 4, "a"), (1, 5, "b"), (2, 1, "a")]
    assert got(opened.where("session > 2")) == []
