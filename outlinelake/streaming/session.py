"""Session folds over ordered events: navigation history, undo, recent files, crash detection; in batch and as streams.

The batch folds sort a session's events in an array and fold it inside the JVM; a session is one person's work with
one document, so its array is small. The stream keeps the same state with transformWithStateInPandas.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.layout import page_clamp

UNDO_LIMIT, RECENT = 20, 10
_PAGES = "array<bigint>"


def _times(events) -> list[str]:
    """What events come by: their time, and among equal times their sequence number if they have one."""
    return [c for c in ("ts", "seq") if c in list(events.columns)]


def page_history(events: DataFrame) -> DataFrame:
    """session, page, back, forward after all events (session, ts, action in go/back/forward, page). Events of one time come by seq, if they have it; with total, the number of pages, targets are clamped to 1..total."""
    start = F.struct(F.lit(1).cast("long").alias("page"), F.array().cast(_PAGES).alias("back"), F.array().cast(_PAGES).alias("forward"))
    state = lambda page, back, forward: F.struct(page.alias("page"), back.alias("back"), forward.alias("forward"))

    def step(s, e):
        last, first = F.element_at(s["back"], -1), F.element_at(s["forward"], -1)
        cut = lambda a: F.slice(a, F.lit(1), F.size(a) - 1)
        push = lambda a, x: F.concat(a, F.array(x))
        moved = (e["action"] == "go") & (e["page"] != s["page"])
        return (
            F.when(moved, state(e["page"], push(s["back"], s["page"]), F.array().cast(_PAGES)))
            .when((e["action"] == "back") & (F.size(s["back"]) > 0), state(last, cut(s["back"]), push(s["forward"], s["page"])))
            .when((e["action"] == "forward") & (F.size(s["forward"]) > 0), state(first, push(s["back"], s["page"]), cut(s["forward"])))
            .otherwise(s)
        )

    page = page_clamp(F.col("page"), F.col("total")) if "total" in events.columns else F.col("page")
    ordered = events.groupBy("session").agg(F.sort_array(F.collect_list(F.struct(*_times(events), "action", page.cast("long").alias("page")))).alias("all"))
    done = ordered.select("session", F.aggregate("all", start, step).alias("s"))
    return done.select("session", F.col("s.page").alias("page"), F.array_join("s.back", ",").alias("back"), F.array_join("s.forward", ",").alias("forward"))


def undo_redo(events: DataFrame) -> DataFrame:
    """session, current, undo, redo (sizes) after all events (session, ts, action in edit/undo/redo, version). An edit keeps at most UNDO_LIMIT snapshots and clears redo; redo has no limit of its own on undo."""
    start = F.struct(F.lit(0).cast("long").alias("now"), F.array().cast(_PAGES).alias("undo"), F.array().cast(_PAGES).alias("redo"))
    state = lambda now, undo, redo: F.struct(now.alias("now"), undo.alias("undo"), redo.alias("redo"))
    last_few = lambda a: F.when(F.size(a) > UNDO_LIMIT, F.slice(a, F.lit(-UNDO_LIMIT), F.lit(UNDO_LIMIT))).otherwise(a)
    cut = lambda a: F.slice(a, F.lit(1), F.size(a) - 1)

    def step(s, e):
        push = lambda a: F.concat(a, F.array(s["now"]))
        return (
            F.when(e["action"] == "edit", state(e["version"], last_few(push(s["undo"])), F.array().cast(_PAGES)))
            .when((e["action"] == "undo") & (F.size(s["undo"]) > 0), state(F.element_at(s["undo"], -1), cut(s["undo"]), last_few(push(s["redo"]))))
            .when((e["action"] == "redo") & (F.size(s["redo"]) > 0), state(F.element_at(s["redo"], -1), push(s["undo"]), cut(s["redo"])))
            .otherwise(s)
        )

    ordered = events.groupBy("session").agg(F.sort_array(F.collect_list(F.struct(*_times(events), "action", F.col("version").cast("long").alias("version")))).alias("all"))
    done = ordered.select("session", F.aggregate("all", start, step).alias("s"))
    return done.select("session", F.col("s.now").alias("current"), F.size("s.undo").cast("long").alias("undo"), F.size("s.redo").cast("long").alias("redo"))


def recent_files(opened: DataFrame) -> DataFrame:
    """session, place, path of the last RECENT different paths (session, ts, path), newest first. With found, a path that was missing when it was last asked for is none of them (of attempts at one time, one that found it counts; null counts as found)."""
    found = F.coalesce("found", F.lit(True)) if "found" in opened.columns else F.lit(True)
    last = opened.groupBy("session", "path").agg(F.max("ts").alias("ts"), F.max(F.struct("ts", found.alias("found"))).alias("last"))
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("ts"), "path"))
    return last.where("last.found").select("session", place.cast("long").alias("place"), "path").where(F.col("place") <= RECENT)


def crashed(snapshots: DataFrame) -> DataFrame:
    """session, saved_at of sessions whose last snapshot (session, saved_at, clean_exit) isn't a clean exit."""
    last = snapshots.groupBy("session").agg(F.max_by("clean_exit", "saved_at").alias("clean_exit"), F.max("saved_at").alias("saved_at"))
    return last.where(~F.col("clean_exit")).select("session", "saved_at")


class _History(StatefulProcessor):
    """page_history() of a stream, session by session."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("history", "page bigint, back array<bigint>, forward array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        page, back, forward = self.state.get() if self.state.exists() else (1, [], [])
        back, forward = list(back), list(forward)
        events = pd.concat(list(rows))
        events = events.sort_values([*_times(events), "action", "page"])
        for action, to in zip(events["action"], events["page"], strict=True):
            if action == "go" and to != page:
                back, forward, page = [*back, page], [], int(to)
            elif action == "back" and back:
                forward, page = [*forward, page], back.pop()
            elif action == "forward" and forward:
                back, page = [*back, page], forward.pop()
        self.state.update((page, back, forward))
        yield pd.DataFrame({"session": [key[0]], "page": [page], "back": [",".join(map(str, back))], "forward": [",".join(map(str, forward))]})

    def close(self) -> None:
        pass


def page_history_stream(events: DataFrame) -> DataFrame:
    """The streaming form of page_history(): each micro-batch updates its sessions. It needs the RocksDB state store."""
    return events.groupBy("session").transformWithStateInPandas(statefulProcessor=_History(), outputStructType="session bigint, page bigint, back string, forward string", outputMode="Update", timeMode="None")
