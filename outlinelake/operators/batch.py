"""The folder batch: ranked sources, first source wins, matching files, outcomes, statistics, log."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the report and of what forbids a batch.
SUCCESS, FAILED, SKIPPED = "성공", "실패", "건너뜀"
NO_ROWS, BACKUP_EXISTS, OPEN_FILE = "일치하는 '파일명' 행 없음", ".backup 파일이 이미 있음(이전 실행 흔적)", "현재 앱에 열려 있는 파일"
LOG_TITLE, LOG_TIME, LOG_FOLDER, LOG_SHEET, LOG_RULE = "폴더 일괄 북마크 적용 로그", "실행 시각: ", "대상 폴더: ", "북마크 파일(읽은 순서): ", "----"
DUPLICATE, SAVED = "[중복] '%s'의 '%s' 행 %d개 건너뜀 — 먼저 읽은 '%s'의 행을 적용", "북마크 %d개 저장"
STATISTICS = "전체 %d개 중 %d개 성공, %d개 실패, %d개 건너뜀"
NO_DOCUMENTS, NO_SHEETS = "선택한 폴더(하위 폴더 포함)에서 PDF를 찾지 못했습니다.", "폴더(하위 폴더 포함)에서 북마크 파일(xlsx/csv)을 찾지 못했습니다."
RENAME_FAILED, WRITE_FAILED, VERIFY_FAILED = "백업 rename 실패", "북마크 쓰기 실패(원본 복원됨)", "저장 결과 검증 실패(원본 복원됨)"


@F.pandas_udf(T.StringType())
def nfc(names: pd.Series) -> pd.Series:
    """Unicode composition, for which Spark has no function."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def source_rank(sources: DataFrame) -> DataFrame:
    """rank of sheets (path): workbooks first, then by path components."""
    order = Window.orderBy(~F.lower("path").endswith(".xlsx"), F.split("path", "/"))
    return sources.withColumn("rank", F.row_number().over(order).cast("long"))


def first_source_wins(rows: DataFrame) -> DataFrame:
    """rows (key, rank, ...) with winner, the lowest rank that has the key."""
    first = rows.groupBy(F.col("key").alias("won_key")).agg(F.min("rank").alias("winner"))
    return rows.join(first, F.col("key").eqNullSafe(F.col("won_key"))).drop("won_key")


def duplicate_notes(rows: DataFrame, sources: DataFrame, folder: str = "") -> DataFrame:
    """One note for each later sheet and key, with the number of rows left out. Paths below the folder are shown relative to it."""
    root = F.lit(folder)
    lost = first_source_wins(rows).where("rank > winner").groupBy("key", "rank", "winner").agg(F.count(F.lit(1)).alias("n"))
    of = lambda name: sources.select(F.col("rank").alias(name), relative(F.col("path"), root).alias(f"{name}_path"))
    lost = lost.join(of("rank"), "rank").join(of("winner"), "winner")
    text = F.format_string(DUPLICATE, "rank_path", "key", "n", "winner_path")
    return lost.select("rank", "key", "n", text.alias("note"))


def outcomes(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """manifest (path, key, is_open, has_backup, rename_ok, write_ok, parses) with bookmark_count and outcome. rows: winning rows by key."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("bookmark_count"))
    m = manifest.join(counts, "key", "left")
    outcome = (
        F.when(F.col("bookmark_count").isNull(), "SkippedNoRows").when(F.col("is_open"), "SkippedOpenFile").when(F.col("has_backup"), "SkippedBackupExists")
        .when(~F.col("rename_ok"), "FailedRename").when(~F.col("write_ok"), "FailedWrite").when(~F.col("parses"), "FailedVerify").otherwise("Success")
    )
    return m.withColumn("outcome", outcome)


def label(outcome: Column) -> Column:
    return F.when(outcome == "Success", SUCCESS).when(outcome.startswith("Failed"), FAILED).otherwise(SKIPPED)


def detail(outcome: Column, count: Column, error: Column | None = None) -> Column:
    """What is said of an outcome; with the error of a failure, where there is one."""
    said = {"SkippedNoRows": NO_ROWS, "SkippedBackupExists": BACKUP_EXISTS, "SkippedOpenFile": OPEN_FILE, "FailedRename": RENAME_FAILED, "FailedWrite": WRITE_FAILED, "FailedVerify": VERIFY_FAILED}
    out = F.when(outcome == "Success", F.format_string(SAVED, count))
    for k, v in said.items():
        out = out.when(outcome == k, F.lit(v) if error is None or not k.startswith("Failed") else F.concat_ws(": ", F.lit(v), error))
    return out


def by_components(path: Column) -> Column:
    """A text by which paths sort component by component."""
    return F.translate(path, "/", "\x01")


def stats(log: DataFrame) -> DataFrame:
    """total, success, failed, skipped and the line that says so."""
    one = log.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") == "Success").alias("success"), F.count_if(F.col("outcome").startswith("Failed")).alias("failed"), F.count_if(F.col("outcome").startswith("Skipped")).alias("skipped"))
    return one.withColumn("line", F.format_string(STATISTICS, "total", "success", "failed", "skipped"))


def log_lines(log: DataFrame) -> DataFrame:
    """path, line of each file; they come in the order of by_components(path). log: path, outcome, bookmark_count, and error if there are any."""
    error = F.col("error") if "error" in log.columns else None
    line = F.concat(F.lit("["), label(F.col("outcome")), F.lit("] "), F.col("path"), F.lit(" — "), detail(F.col("outcome"), F.col("bookmark_count"), error))
    return log.select("path", line.alias("line"))


def log_file(log: DataFrame, sources: DataFrame, notes: DataFrame, folder: str, started: Column, title: str = LOG_TITLE) -> DataFrame:
    """section, rank, name, line of a batch's whole log, in that order: title, time and folder, the sheets as read, notes, a line for each file in the order of its path's components, statistics, with rules around the files. log: path, outcome, bookmark_count, error if any; sources: path, rank; notes: rank, key, note. name is what lines of a section and rank sort by. Paths below the folder are shown relative to it. An empty batch has the heading, the rules and statistics of zeros."""
    spark, root = log.sparkSession, F.lit(folder)
    row = lambda section, rank, line, name=F.lit(""): [F.lit(section).alias("section"), rank.cast("long").alias("rank"), name.alias("name"), line.alias("line")]
    head = [F.lit(title), F.concat(F.lit(LOG_TIME), F.date_format(started, "yyyy-MM-dd HH:mm:ss")), F.concat(F.lit(LOG_FOLDER), nfc(root))]
    one = spark.range(1)
    out = one.select(*row(0, F.lit(0), head[0])).unionAll(one.select(*row(0, F.lit(1), head[1]))).unionAll(one.select(*row(0, F.lit(2), head[2])))
    out = out.unionAll(sources.select(*row(1, F.col("rank"), F.concat(F.lit(LOG_SHEET), relative(F.col("path"), root)))))
    out = out.unionAll(notes.select(*row(2, F.col("rank"), F.col("note"), F.col("key"))))
    shown = log_lines(log.withColumn("path", relative(F.col("path"), root))).withColumn("path", by_components(F.col("path")))
    out = out.unionAll(one.select(*row(3, F.lit(0), F.lit(LOG_RULE)))).unionAll(shown.select(*row(4, F.lit(0), F.col("line"), F.col("path"))))
    return out.unionAll(one.select(*row(5, F.lit(0), F.lit(LOG_RULE)))).unionAll(stats(log).select(*row(6, F.lit(0), F.col("line"))))


def log_name(started: Column) -> Column:
    return F.concat(F.lit("bookmark-import-"), F.date_format(started, "yyyyMMdd-HHmmss"), F.lit(".log"))


def preconditions(files: int, sheets: int) -> str | None:
    """What forbids a batch: no documents, then no sheets."""
    return NO_DOCUMENTS if not files else NO_SHEETS if not sheets else None


def backup_path(path: Column) -> Column:
    return F.concat(path, F.lit(".backup"))


def relative(path: Column, root: Column) -> Column:
    """The path below root, composed; the whole path if it isn't below."""
    start = F.concat(root, F.lit("/"))
    return nfc(F.when(path.startswith(start), F.substr(path, F.length(start) + 1)).otherwise(path))


def canonical(path: Column) -> Column:
    """The path without . and .. and doubled slashes, as far as text tells."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x != "..", F.concat(out, F.array(x))).otherwise(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(walked, "/"))


def same_file(a: Column, b: Column) -> Column:
    """Whether two paths name one file, however they are written; null is no file."""
    return F.coalesce(canonical(a) == canonical(b), F.lit(False))
