"""Folders of sheets and documents that are made of the driver's tables, the queries over them, and their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encodings
from ..operators import batch
from ..sources import folder_batch, sheets, store
from ..sources.files import HEADERS, MISSING_COLUMN, NOT_A_NUMBER, UNREADABLE
from ..streaming import progress

#: Letters of other scripts that stand for a to z, and the encodings that documents are put in, by doc_id % 6.
SCRIPTS = {3: "가나다라마바사아자차카타파하고노도로모보소오조초코토", 4: "あいうえおかきくけこさしすせそたちつてとなにぬねのは", 5: "абцдефгхийклмнопярстувшьыз"}
PLANTED = ["UTF-8", "UTF-8 mark", "windows-1252", "EUC-KR", "Shift_JIS", "windows-1251"]
LETTERS = "abcdefghijklmnopqrstuvwxyz"
WORD = "문서"
APART = unicodedata.normalize("NFD", WORD)
STARTED = "2026-01-02 03:04:05"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _respelt(text, letters):
    return F.translate(F.lower(F.regexp_replace(text, r"[^\x00-\x7F]", "")), LETTERS, letters)


def detected_texts(spark, sf):
    """Documents in six encodings, three of them in other scripts, and what detection makes of their bytes."""
    d = table(spark, sf, "documents").select("doc_id", F.pmod("doc_id", F.lit(6)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    for k, letters in SCRIPTS.items():
        text = F.when(F.col("k") == k, _respelt(F.col("text"), letters)).otherwise(text)
    name = F.element_at(F.array(*map(F.lit, PLANTED)), (F.col("k") + 1).cast("int"))
    d = d.select("doc_id", "k", text.alias("text"), name.alias("name"))
    found = d.select("doc_id", "k", encodings.decoded(encodings.encoded("text", "name")).alias("f"))
    return found.select("doc_id", F.when(F.col("k") > 2, F.col("f.encoding")).alias("encoding"), F.md5("f.text").alias("text_md5"))


def _conversations(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("c"), F.col("turn").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    return c.withColumn("k", F.floor(F.col("c") / 4).cast("long"))


def _sheet_name(k):
    ext = F.when(k % 8 % 4 == 0, ".xlsx").otherwise(".csv")
    return F.concat(F.lit("d"), k % 3, F.lit("/sheet"), k, ext)


def _sheet_rows(spark, sf):
    """Turns as rows of sheets: a sheet for four conversations; those of every fifth conversation stand in the next sheet too."""
    c = _conversations(spark, sf)
    c = c.unionByName(c.where("c % 5 = 0").withColumn("k", F.col("k") + 1))
    return c.select("k", _sheet_name(F.col("k")).alias("file"), "c", "turn", "text")


def _made(spark, sf) -> str:
    """A folder of sheets: workbooks, CSV in UTF-8 with a mark and without and in EUC-KR, some with a number that is none, some without a column."""
    folder, rows = store.scratch(spark, "sheets"), _sheet_rows(spark, sf)
    kind, apart = F.col("k") % 8, (F.col("k") % 8 != 3) & (F.col("c") % 2 == 1)
    title = F.when(kind == 3, F.concat(F.lit("제목 "), F.regexp_replace("text", r"[^\x00-\x7F]", ""))).otherwise(F.col("text"))
    name = F.concat(F.when(apart, APART).otherwise(WORD), F.col("c"), F.lit(".pdf"))
    good = rows.where(kind < 5).select("file", F.when(kind == 2, "utf-8").when(kind == 3, "cp949").alias("encoding"), F.col("turn").alias("ord"), name.alias("filename"), (F.col("turn") % 3).alias("depth"), title.alias("title"), (F.col("turn") + 1).alias("page"))
    sheets.write_files(good, folder)
    bad = rows.where(kind.between(5, 7)).withColumn("bad", kind)
    own = F.concat_ws(",", name, F.when(F.col("bad") == 5, F.lit("0")), F.lit("t"), F.when((F.col("bad") == 5) & (F.col("turn") == 1), F.lit("x")).otherwise((F.col("turn") + 1).cast("string")))
    head = bad.select("file", "bad").distinct().select("file", F.lit(-1).cast("long").alias("n"), F.when(F.col("bad") == 5, ",".join(HEADERS[1:])).otherwise(",".join([HEADERS[1], *HEADERS[3:]])).alias("line"))
    sheets.write_files(head.unionByName(bad.select("file", F.col("turn").alias("n"), own.alias("line"))), folder, "n", "line")
    return folder


def sheet_folder(spark, sf):
    """The rows of all sheets of a folder that can be read."""
    read = sheets.read_folder(spark, _made(spark, sf)).where("error is null")
    return read.select("src", "src_row", "ord", batch.nfc(F.col("filename")).alias("filename"), "depth", "title", "page")


def sheet_warnings(spark, sf):
    """A note for each sheet that can't be read."""
    read = sheets.read_folder(spark, _made(spark, sf)).where("error is not null")
    return read.select("src", F.format_string(UNREADABLE, "src", "error").alias("note"))


def _with_documents(spark, sf) -> str:
    """The folder of _made() with documents, some of which are none, and some with backups."""
    folder = _made(spark, sf)
    c = _conversations(spark, sf).select("c").distinct().where("c % 4 <> 3")
    path = F.concat(F.lit("p"), F.col("c") % 3, F.lit("/"), F.lit(APART), F.col("c"), F.lit(".pdf"))
    line = F.when(F.col("c") % 11 == 0, F.lit("junk")).otherwise(F.concat(F.lit("%PDF "), F.col("c")))
    documents = c.select(path.alias("file"), line.alias("line"))
    backups = c.where("c % 9 = 0").select(F.concat(path, F.lit(".backup")).alias("file"), F.lit("old").alias("line"))
    sheets.write_files(documents.unionByName(backups), folder)
    return folder


def folder_log(spark, sf):
    """The whole batch over a folder of sheets and documents: the lines of its log as read again from its file."""
    folder = _with_documents(spark, sf)
    job = folder_batch.prepare(spark, folder)
    log = folder_batch.run(job, open_file=f"p1/{APART}1.pdf")
    name = folder_batch.write_log(job, log, F.lit(STARTED).cast("timestamp_ntz"))
    lines = folder_batch.read_lines(spark, folder, [name])
    return lines.select("n", F.when(F.col("n") == 3, batch.LOG_FOLDER).otherwise(F.col("line")).alias("line"))  # the folder has another name in each run


def batch_progress(spark, sf):
    """The same batch in steps: a line for each document, and the statistics after the last step."""
    folder, state = _with_documents(spark, sf), store.scratch(spark, "progress")
    progress.plan(folder_batch.prepare(spark, folder), state)
    log = progress.run(spark, folder, state, open_file=f"p1/{APART}1.pdf")
    lines = batch.log_lines(log.withColumn("path", batch.relative(F.col("path"), F.lit(""))))
    last = progress.totals(log).groupBy().agg(*(F.max(c).alias(c) for c in ("total", "success", "failed", "skipped")))
    return lines.unionAll(last.select(F.lit(""), F.format_string(batch.STATISTICS, "total", "success", "failed", "skipped")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (detected_texts, sheet_folder, sheet_warnings, folder_log, batch_progress)}


_SHEETS = f"""WITH conv AS (SELECT conv_id AS c, turn, coalesce(text, '') AS text, conv_id // 4 AS k FROM conversations),
    dealt AS (SELECT * FROM conv UNION ALL SELECT c, turn, text, k + 1 FROM conv WHERE c % 5 = 0),
    rows_ AS (SELECT *, 'd' || k % 3 || '/sheet' || k || CASE WHEN k % 4 = 0 THEN '.xlsx' ELSE '.csv' END AS src, '{WORD}' || c || '.pdf' AS key FROM dealt),
    good AS (SELECT *, CASE WHEN k % 8 = 3 THEN '제목 ' || regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') ELSE text END AS title FROM rows_ WHERE k % 8 < 5),
    warned AS (SELECT DISTINCT src, '{UNREADABLE.replace("%s", "").split("'")[0]}''' || src || ''' 읽기 실패 — 무시함: ' || CASE WHEN k % 8 = 5 THEN '{NOT_A_NUMBER % HEADERS[4]}' ELSE '{(MISSING_COLUMN % HEADERS[2]).replace("'", "''")}' END AS note FROM rows_ WHERE k % 8 >= 5)"""


_LOG = _SHEETS + f""", src AS (SELECT src, row_number() OVER (ORDER BY NOT src LIKE '%.xlsx', string_split(src, '/')) AS rank FROM (SELECT DISTINCT src FROM rows_)),
            first AS (SELECT key, rank, src, count(*) AS n, min(rank) OVER (PARTITION BY key) AS winner FROM good JOIN src USING (src) GROUP BY key, rank, src),
            files AS (SELECT DISTINCT c, 'p' || c % 3 || '/{WORD}' || c || '.pdf' AS path, '{WORD}' || c || '.pdf' AS key FROM conv WHERE c % 4 <> 3),
            log AS (SELECT path, n, CASE WHEN n IS NULL THEN '{batch.NO_ROWS.replace("'", "''")}' WHEN c = 1 THEN '{batch.OPEN_FILE}' WHEN c % 9 = 0 THEN '{batch.BACKUP_EXISTS}' WHEN c % 11 = 0 THEN '{batch.WRITE_FAILED}: not a document' ELSE '북마크 ' || n || '개 저장' END AS detail,
                CASE WHEN n IS NULL OR c = 1 OR c % 9 = 0 THEN '{batch.SKIPPED}' WHEN c % 11 = 0 THEN '{batch.FAILED}' ELSE '{batch.SUCCESS}' END AS label FROM files LEFT JOIN (SELECT key, n FROM first WHERE rank = winner) USING (key))"""
_STATISTICS = f"""'전체 ' || count(*) || '개 중 ' || count(*) FILTER (WHERE label = '{batch.SUCCESS}') || '개 성공, ' || count(*) FILTER (WHERE label = '{batch.FAILED}') || '개 실패, ' || count(*) FILTER (WHERE label = '{batch.SKIPPED}') || '개 건너뜀' FROM log"""


def oracle_sql() -> dict[str, str]:
    cases = " ".join(f"WHEN {k} THEN translate(lower(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '', 'g')), '{LETTERS}', '{letters}')" for k, letters in SCRIPTS.items())
    return {
        "detected_texts": f"""WITH t AS (SELECT doc_id, doc_id % 6 AS k, CASE doc_id % 6 {cases} ELSE coalesce(text, '') END AS text FROM documents)
            SELECT doc_id, CASE WHEN k > 2 THEN CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN ['EUC-KR', 'Shift_JIS', 'windows-1251'][k - 2] ELSE 'UTF-8' END END AS encoding, md5(text) AS text_md5 FROM t""",
        "sheet_folder": _SHEETS + """ SELECT src, row_number() OVER (PARTITION BY src ORDER BY turn, CASE WHEN c % 2 = 1 AND k % 8 <> 3 THEN 0 ELSE 1 END, c::VARCHAR || '.pdf') - 1 AS src_row, turn AS ord, key AS filename, turn % 3 AS depth, title, turn + 1 AS page FROM good""",
        "sheet_warnings": _SHEETS + " SELECT * FROM warned",
        "folder_log": _LOG + f""",
            out AS (SELECT 0 AS s, unnest([0, 1, 2]) AS r, '' AS a, unnest(['{batch.LOG_TITLE}', '{batch.LOG_TIME}{STARTED}', '{batch.LOG_FOLDER}']) AS line
                UNION ALL SELECT 1, rank, '', '{batch.LOG_SHEET}' || src FROM src
                UNION ALL SELECT 2, rank, '', note FROM warned JOIN src USING (src)
                UNION ALL SELECT 2, f.rank, f.key, '[중복] ''' || f.src || '''의 ''' || f.key || ''' 행 ' || f.n || '개 건너뜀 — 먼저 읽은 ''' || w.src || '''의 행을 적용' FROM first f JOIN src w ON w.rank = f.winner WHERE f.rank > f.winner
                UNION ALL SELECT unnest([3, 5]), 0, '', '{batch.LOG_RULE}'
                UNION ALL SELECT 4, 0, replace(path, '/', chr(1)), '[' || label || '] ' || path || ' — ' || detail FROM log
                UNION ALL SELECT 6, 0, '', {_STATISTICS})
            SELECT row_number() OVER (ORDER BY s, r, a) AS n, line FROM out""",
        "batch_progress": _LOG + f""" SELECT path, '[' || label || '] ' || path || ' — ' || detail AS line FROM log UNION ALL SELECT '', {_STATISTICS}""",
    }
