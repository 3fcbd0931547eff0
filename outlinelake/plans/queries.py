"""Adapters that make outlines, pages, links and sessions of the driver's tables, and the queries over them."""

from __future__ import annotations

import os
import tempfile
import unicodedata
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import layout, text
from ..operators import batch, edits, tree
from ..sources import files
from ..streaming import session
from . import folders

LEVELS, WIDTH = 4, 600.0
TIE = ("l_partkey", "l_suppkey", "l_extendedprice")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rows_of(spark, sf) -> DataFrame:
    """lineitem as outline rows."""
    # the key gets its name before any window, so that all windows share one shuffle
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("ord"), (F.col("l_quantity").cast("long") % 4).alias("depth"), F.concat(F.lit("part "), F.col("l_partkey")).alias("title"), F.col("l_suppkey").alias("page"), *TIE)


def tree_of(spark, sf) -> DataFrame:
    return tree.build(rows_of(spark, sf), *TIE, levels=LEVELS).select("doc", "rn", "eff", "title", "page", "path", "depth")


def asked(spark, sf) -> DataFrame:
    """orders as edits: one per document."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 5).alias("at"), F.lit(tree.NEW_TITLE).alias("title"), (F.col("o_custkey") % 100).alias("page"), (F.col("o_custkey") % 7).alias("moving"), (F.col("o_orderkey") % 5).alias("target"))


def shown(path):
    return F.array_join(path.cast("array<string>"), "/")


def effective_depth(spark, sf):
    t = tree.effective_depth(tree.numbered(rows_of(spark, sf), *TIE))
    return t.select("doc", "rn", "eff", (F.col("eff") < F.col("depth")).alias("clamped"))


def ancestor_path(spark, sf):
    return tree_of(spark, sf).select("doc", "rn", shown(F.col("path")).alias("path"))


def parent_of(spark, sf):
    return tree_of(spark, sf).select("doc", "rn", tree.parent().alias("parent"))


def ancestors_of(spark, sf):
    return tree_of(spark, sf).select("doc", "rn", shown(tree.ancestors()).alias("ancestors"))


def subtree_size(spark, sf):
    return tree.ends(tree_of(spark, sf)).select("doc", F.col("top").alias("rn"), "end", "size")


def find_title(spark, sf):
    t = tree_of(spark, sf)
    return t.groupBy("doc", "title").agg(F.min(F.struct("rn", "page")).alias("first")).select("doc", "title", F.col("first.rn").alias("rn"), F.col("first.page").alias("page"))


def flatten_outline(spark, sf):
    r, n, c = table(spark, sf, "region"), table(spark, sf, "nation"), table(spark, sf, "customer")
    region = r.select(F.lit("geo").alias("doc"), F.col("r_regionkey").alias("k0"), F.lit(-1).alias("k1"), F.lit(-1).cast("long").alias("k2"), F.lit(0).cast("long").alias("depth"), F.col("r_name").alias("title"))
    nation = n.select(F.lit("geo"), "n_regionkey", "n_nationkey", F.lit(-1).cast("long"), F.lit(1).cast("long"), "n_name")
    customer = c.join(n, c.c_nationkey == n.n_nationkey).select(F.lit("geo"), "n_regionkey", "n_nationkey", "c_custkey", F.lit(2).cast("long"), "c_name")
    # one document per region keeps the windows apart
    rows = region.union(nation).union(customer).withColumn("doc", F.concat(F.lit("geo"), F.col("k0"))).withColumn("ord", F.lit(0)).withColumn("page", (F.col("k1") + 2).cast("long"))
    return tree.flatten(tree.build(rows, "k1", "k2", levels=3))


def import_filter_sort(spark, sf):
    rows = rows_of(spark, sf).withColumn("filename", F.when(F.col("l_partkey") % 3 == 0, "other.pdf").otherwise("own.pdf"))
    return tree.prepare_import(rows, F.lit("own.pdf"), *TIE).select("doc", "rn", "ord", "title", "page", "skipped")


def _files_of(spark, sf):
    """lineitem as rows for several files; of a third of the documents no row is for their own."""
    return rows_of(spark, sf).withColumn("filename", F.when((F.col("doc") % 3 == 0) | (F.col("l_partkey") % 3 == 0), "other.pdf").when(F.col("l_partkey") % 7 != 1, "own.pdf"))


def import_counts(spark, sf):
    return tree.import_counts(_files_of(spark, sf), F.lit("own.pdf"))


def apply_import(spark, sf):
    return tree.apply_import(tree_of(spark, sf), _files_of(spark, sf), F.lit("own.pdf"), *TIE, levels=LEVELS).select(*_T)


_T = ["doc", "rn", "eff", "title", "page"]


def insert_child(spark, sf):
    return tree.insert(tree_of(spark, sf), asked(spark, sf), by_page=False).select(*_T)


def insert_by_page_parent(spark, sf):
    return tree.insert(tree_of(spark, sf), asked(spark, sf), by_page=True).select(*_T)


def insert_by_page_anchor(spark, sf):
    return tree.insert(tree_of(spark, sf), asked(spark, sf).withColumn("at", F.lit(None).cast("long")), by_page=True).select(*_T)


def remove_subtree(spark, sf):
    return tree.remove(tree_of(spark, sf), asked(spark, sf).select("doc", F.col("moving").alias("victim"))).select(*_T)


def _moves(spark, sf):
    return asked(spark, sf).select("doc", "moving", "target")


def move_before(spark, sf):
    return tree.move(tree_of(spark, sf), _moves(spark, sf), "Before").select(*_T)


def move_after(spark, sf):
    return tree.move(tree_of(spark, sf), _moves(spark, sf), "After").select(*_T)


def move_inside(spark, sf):
    return tree.move(tree_of(spark, sf), _moves(spark, sf), "Inside").select(*_T)


def move_rejected(spark, sf):
    return tree.check_moves(tree_of(spark, sf), _moves(spark, sf)).where("error is not null").select("doc", "moving", "target", "error")


def active_bookmark(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") * 3 + 1).alias("doc"), F.col("event_id").alias("probe"), (F.floor("value") + 1).alias("page"))
    return tree.active(tree_of(spark, sf), e)


def next_selection(spark, sf):
    return tree.next_selection(tree_of(spark, sf)).select("doc", "rn", "selected")


def _visible(spark, sf):
    return tree.visible(tree_of(spark, sf), asked(spark, sf).select("doc", F.array("at", "moving").alias("shut")))


def visible_outline(spark, sf):
    return _visible(spark, sf).select("doc", "rn", "title")


def visible_neighbours(spark, sf):
    return _visible(spark, sf).select("doc", "rn", "above", "below")


def fold_target(spark, sf):
    return tree.fold_target(tree_of(spark, sf)).select("doc", "rn", "has_children", "fold")


def drop_position(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tree.drop_position((F.col("conv_id") * 7 + F.col("turn")) % 100 / 100.0).alias("position"))


def rename_blanks(spark, sf):
    d = table(spark, sf, "documents")
    blank = F.lit("\t\u00a0\u3000 \n")
    return d.select("doc_id", tree.rename(F.col("source"), F.when(F.col("doc_id") % 3 == 0, blank).otherwise(F.concat(blank, F.col("lang"), F.lit("\n")))).alias("title"), text.u32(F.concat(F.lit("\t"), F.col("doc_id").cast("string"), F.lit("\n"))).alias("page"))


def rename_commit(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tree.rename(F.col("source"), F.when(F.col("doc_id") % 3 == 0, "   ").otherwise(F.concat(F.lit("  "), F.col("lang"), F.lit(" ")))).alias("title"))


def write_page_fallback(spark, sf):
    pages = table(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select((F.col("s_suppkey") % 5).alias("bucket"), F.col("s_suppkey").alias("page"))
    t = tree_of(spark, sf).select((F.col("doc") % 6).alias("doc"), F.col("doc").alias("outline"), "rn", "page")
    return tree.resolve_pages(t, pages.withColumnRenamed("bucket", "doc")).select("outline", "rn", "page", "target")


def _sources(spark, sf):
    n = table(spark, sf, "nation")
    path = F.concat(F.element_at(F.array(F.lit("a"), F.lit("a-b"), F.lit("c/d")), (F.col("n_nationkey") % 3 + 1).cast("int")), F.lit("/sheet"), F.col("n_nationkey"), F.when(F.col("n_nationkey") % 4 == 0, ".xlsx").otherwise(".csv"))
    return batch.source_rank(n.select(path.alias("path"), "n_nationkey"))


def _sheet_rows(spark, sf):
    s, src = table(spark, sf, "supplier"), _sources(spark, sf)
    rows = s.join(src, s.s_nationkey == src.n_nationkey)
    return rows.select("rank", F.concat(F.lit("file"), F.col("s_suppkey") % 37, F.lit(".pdf")).alias("key"), (F.col("s_suppkey") % 11).alias("ord"), F.col("s_suppkey").alias("src_row"), F.col("s_name").alias("title"))


def _manifest(spark, sf):
    p = table(spark, sf, "part")
    flag = lambda n: F.col("p_partkey") % n == 0
    key = F.concat(F.lit("file"), F.col("p_partkey") % 45, F.lit(".pdf"))
    return p.select(F.concat(F.lit("dir"), F.col("p_partkey") % 3, F.lit("/"), F.col("p_partkey"), F.lit("/"), key).alias("path"), key.alias("key"), flag(19).alias("is_open"), flag(7).alias("has_backup"), (~flag(13)).alias("rename_ok"), (~flag(11)).alias("write_ok"), (~flag(5)).alias("parses"))


def source_rank(spark, sf):
    return _sources(spark, sf).select("path", "rank")


def first_source_wins(spark, sf):
    won = batch.first_source_wins(_sheet_rows(spark, sf)).where("rank = winner")
    place = F.row_number().over(Window.partitionBy("key").orderBy("ord", "rank", "src_row")) - 1
    return won.select("key", place.cast("long").alias("rn"), "ord", "title", "winner")


def duplicate_notes(spark, sf):
    return batch.duplicate_notes(_sheet_rows(spark, sf), _sources(spark, sf).select("rank", "path")).select("rank", "key", "n", "note")


def _log(spark, sf):
    return batch.outcomes(_manifest(spark, sf), batch.first_source_wins(_sheet_rows(spark, sf)).where("rank = winner"))


def matched_files(spark, sf):
    keys = _sheet_rows(spark, sf).select("key").distinct()
    return _manifest(spark, sf).join(keys, "key", "left_semi").agg(F.count(F.lit(1)).alias("matched"))


def batch_outcome(spark, sf):
    return _log(spark, sf).select("path", "outcome", "bookmark_count")


def batch_stats(spark, sf):
    return batch.stats(_log(spark, sf))


def batch_log(spark, sf):
    return batch.log_lines(_log(spark, sf))


def batch_log_file(spark, sf):
    below = lambda df: df.withColumn("path", F.concat(F.lit("/batch/"), "path"))
    sources = below(_sources(spark, sf).select("rank", "path"))
    notes = batch.duplicate_notes(_sheet_rows(spark, sf), sources, "/batch")
    return batch.log_file(below(_log(spark, sf)), sources, notes, "/batch", F.lit("2026-01-02 03:04:05").cast("timestamp_ntz"))


def nfc_match(spark, sf):
    c = table(spark, sf, "customer")
    raw = F.concat(F.lit("café 한글 "), F.col("c_custkey") % 10, F.lit(".pdf"))
    composed = F.concat(F.lit("café 한글 "), F.col("c_nationkey") % 10, F.lit(".pdf"))
    return c.select("c_custkey", (batch.nfc(raw) == composed).alias("matched"), (raw == composed).alias("raw_matched"))


def _pages(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"), "text")


def page_search(spark, sf):
    return text.search(_pages(spark, sf), " The ")


def _found(spark, sf):
    m = text.search(_pages(spark, sf), "an")
    return m, m.select("doc").distinct().withColumn("at", F.col("doc") % 5 + 1)


def search_start(spark, sf):
    return text.start_match(*_found(spark, sf))


def search_cycle(spark, sf):
    m, _ = _found(spark, sf)
    n = F.count(F.lit(1)).over(Window.partitionBy("doc"))
    after, before = text.cycled(F.col("idx"), n)
    return m.select("doc", "idx", after.alias("next"), before.alias("previous"), text.highlight(F.col("idx"), F.lit(0)).alias("class"))


def _documents(spark, sf):
    """doc, text and n, its number of characters, of documents that have any."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text", F.char_length("text").alias("n")).where("n > 0")


def _anchors():
    """Two anchors of a selection anywhere in a document's n characters."""
    return F.col("doc") * 7919 % F.col("n"), F.col("doc") * 104729 % F.col("n")


def _set(row: dict, columns: int = 80) -> dict:
    """A text set in lines of so many columns: its characters and their boxes."""
    idx = np.arange(len(row["text"]))
    left, top = idx % columns * 6.0, idx // columns * -12.0
    return {"chars": row["text"], "left": left, "right": left + 6, "bottom": top - 10, "top": top}


def _chars(spark, sf):
    d = _documents(spark, sf).select("doc", "n", F.posexplode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("idx", "ch"))
    left, top = (F.col("idx") % 80) * 6.0, -12.0 * F.floor(F.col("idx") / 80)
    return d.select("doc", "n", F.col("idx").cast("long").alias("idx"), "ch", left.alias("left"), top.cast("double").alias("top"), (left + 6).alias("right"), (top - 10).cast("double").alias("bottom"), F.lit(0.0).alias("angle"))


def range_extract(spark, sf):
    first, last, _ = text.normalised_range(*_anchors())
    docs = _documents(spark, sf)
    return text.extract(docs.select("doc", "text"), docs.select("doc", first.alias("first"), last.alias("last")), _set)


def line_breaks(spark, sf):
    t = _documents(spark, sf).select("doc", text.broken(F.struct("text"), _set).alias("text"))
    return t.select("doc", F.md5("text").alias("text_md5"), F.char_length("text").cast("long").alias("n_chars"))


def page_texts(spark, sf):
    """Characters of conversations' turns as pages: breaks start anew on each page."""
    return _pages(spark, sf).where("length(text) > 0").select("doc", "page", text.broken(F.struct("text"), partial(_set, columns=20)).alias("text"))


def _corners(q):
    c = lambda k, f: F.col("quad")[k][f]
    return q.select("doc", "idx", c(0, "x").alias("x0"), c(0, "y").alias("y0"), c(2, "x").alias("x2"), c(2, "y").alias("y2"), "rotation")


def char_quads(spark, sf):
    return _corners(text.quads(_chars(spark, sf)))


def selection_quads(spark, sf):
    return _corners(text.quads(_chars(spark, sf).where(F.col("idx").between(*text.normalised_range(*_anchors())[:2]))))


def char_hit(spark, sf):
    height = 12 * F.ceil(F.col("n") / 80)
    points = _documents(spark, sf).select("doc", F.col("doc").alias("probe"), ((F.col("doc") * 13) % 500 + 0.25).cast("double").alias("x"), (-1.0 * ((F.col("doc") * 7919) % height) - 0.5).cast("double").alias("y"))
    return text.hit_test(_documents(spark, sf).select("doc", "text"), points, layout=_set)


def _uris(spark, sf):
    p = table(spark, sf, "pages")
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    made = F.when(F.col("page_id") % 4 == 0, F.col("url")).when(F.col("page_id") % 4 == 1, bare).when(F.col("page_id") % 4 == 2, F.concat(F.lit("user"), F.col("page_id"), F.lit("@example.org"))).otherwise(F.concat(F.lit("mailto:a@"), bare))
    return p.select("page_id", made.alias("uri"))


def normalize_uri(spark, sf):
    return _uris(spark, sf).select("page_id", text.normalize_uri(F.col("uri")).alias("uri"))


def link_target(spark, sf):
    k = F.col("page_id") % 5
    kind = F.when(k == 0, "local").when(k == 1, "uri").when(k == 2, "launch")
    what, page, to = text.link_target(kind, F.col("uri"), F.col("page_id") % 90, F.when(k == 3, F.col("page_id") % 70))
    return _uris(spark, sf).select("page_id", what.alias("kind"), page.alias("page"), to.alias("uri"))


def link_at_point(spark, sf):
    k, p = F.col("link_no"), F.col("page_id")
    links = _uris(spark, sf).withColumn("link_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    near, far = (p % 7 + 20 * k).cast("double"), (p % 7 + 20 * k + 30).cast("double")
    flip = (p + k) % 2 == 0  # corners may be given either way
    kind = F.when((p + k) % 4 == 0, "local").when((p + k) % 4 == 1, "uri").when((p + k) % 4 == 2, "launch")
    what, page, to = text.link_target(kind, F.col("uri"), p % 90 + k, p % 70 + k)
    links = links.select((p % 50).alias("doc"), p.alias("page"), "link_no", F.when(flip, near).otherwise(far).alias("left"), F.when(flip, far).otherwise(near).alias("right"), (10 * k).cast("double").alias("bottom"), (10 * k + 25).cast("double").alias("top"), what.alias("kind"), page.alias("target"), to.alias("uri"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("probe")
    points = table(spark, sf, "pages").select("page_id", at).select((p % 50).alias("doc"), p.alias("page"), "probe", ((p * 13 + F.col("probe") * 31) % 150).cast("double").alias("x"), ((p * 7 + F.col("probe") * 17) % 80).cast("double").alias("y"))
    return text.links_at(links, points).select(F.col("page").alias("page_id"), "probe", "link_no", "kind", "target", "uri")


def export_name(spark, sf):
    p = table(spark, sf, "part")
    path = F.when(F.col("p_partkey") % 9 == 0, F.lit(None)).otherwise(F.concat(F.lit("/docs/"), F.regexp_replace("p_name", "[^a-z0-9]", "_"), F.lit(".v2.pdf")))
    return p.select("p_partkey", text.export_name(path, "xlsx").alias("name"), text.u32(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" +"), "p_size", F.lit(" "))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("-"), "p_size")).otherwise(F.concat("p_size", F.lit("000000000")))).alias("page"))


def _laid(spark, sf):
    p = table(spark, sf, "pages")
    m = p.select(F.floor(F.col("page_id") / 10).alias("doc"), (F.col("page_id") % 10 + 1).alias("page"), F.when(F.col("page_id") % 17 != 0, 1 + (F.col("page_id") * 7 % 13) / 10.0).cast("double").alias("aspect"))
    return layout.offsets(m, WIDTH)


def _views(spark, sf):
    d = table(spark, sf, "pages").select(F.floor(F.col("page_id") / 10).alias("doc")).distinct()
    return d.withColumn("view_top", (F.col("doc") % 7 * 900).cast("double")).withColumn("view_bottom", F.col("view_top") + 700.0)


def page_layout(spark, sf):
    return _laid(spark, sf).select("doc", "page", *(F.round(c, 4).alias(c) for c in ("height", "top", "bottom")))


def page_at_y(spark, sf):
    probes = _views(spark, sf).select("doc", (F.col("doc") * 37 % 700 - 20.0).cast("double").alias("x"), (F.col("view_top") + 3.0).alias("y"))
    return layout.page_at(_laid(spark, sf), probes, WIDTH)


def visible_pages(spark, sf):
    return layout.visible(_laid(spark, sf), _views(spark, sf), WIDTH)


def _several_views(spark, sf):
    """Two views of each document, far apart."""
    v = _views(spark, sf)
    far = v.select("doc", (F.col("view_top") + 4000.0).alias("view_top"), (F.col("view_bottom") + 4000.0).alias("view_bottom"))
    return v.withColumn("view", F.lit(0)).unionByName(far.withColumn("view", F.lit(1)))


def views_tracked(spark, sf):
    laid, views = _laid(spark, sf), _several_views(spark, sf)
    return layout.visible(laid, views, WIDTH).join(layout.tracked(laid, views, WIDTH), ["doc", "view"])


def tracked_page(spark, sf):
    return layout.tracked(_laid(spark, sf), _views(spark, sf), WIDTH)


def render_width(spark, sf):
    p = table(spark, sf, "part")
    w, h = (F.col("p_partkey") * 37 % 900).cast("double"), (F.col("p_partkey") * 53 % 1200 + 1).cast("double")
    return p.select("p_partkey", layout.render_width((F.col("p_partkey") * 91 % 40000).cast("double"), w, h, F.lit(16384)).alias("width"), F.round(layout.aspect(w, h), 6).alias("aspect"))


def zoom_fit(spark, sf):
    p = table(spark, sf, "part")
    ratio, panel = (F.col("p_size") / 20.0).cast("double"), (F.col("p_partkey") % 1500 + 1).cast("double")
    return p.select("p_partkey", F.round(layout.fit_zoom(panel, F.lit(900.0), ratio), 6).alias("fit"), F.round(layout.zoom_ceiling(ratio, F.lit(20000), panel, F.lit(2.0)), 6).alias("ceiling"), layout.target_width(panel, F.lit(1.25), F.lit(2.0)).alias("width"), F.round(layout.wheel_zoom(ratio, F.col("p_size") * 10.0), 6).alias("wheel"), (F.round(layout.pan_clamp(F.col("p_size") * 10.0, panel, F.lit(700.0)), 6) + 0.0).alias("pan"))


def page_clamp(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", layout.page_clamp(F.col("o_custkey") % 40 - 5, F.col("o_orderkey") % 25).alias("page"))


def _events(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("seq"), "event_type", (F.floor("value") + 1).cast("long").alias("page"))


def recent_files(spark, sf):
    return session.recent_files(_events(spark, sf).select("session", "ts", F.concat(F.lit("doc"), F.col("page") % 20).alias("path")))


def crash_sessions(spark, sf):
    return session.crashed(_events(spark, sf).select("session", F.col("ts").alias("saved_at"), (F.col("event_type") == "purchase").alias("clean_exit")))


def page_history(spark, sf):
    action = F.when(F.col("event_type") == "error", "back").when(F.col("event_type") == "signup", "forward").otherwise("go")
    return session.page_history(_events(spark, sf).select("session", "ts", "seq", action.alias("action"), "page", F.lit(90).alias("total")))


def undo_redo(spark, sf):
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("edit")
    return session.undo_redo(_events(spark, sf).select("session", "ts", "seq", action.alias("action"), F.col("page").alias("version")))


def _edited(spark, sf):
    """Conversations as outlines of eight each, and their turns as edits of the next eight's outline."""
    c = table(spark, sf, "conversations").select(F.floor(F.col("conv_id") / 8).alias("doc"), "conv_id", "turn", F.char_length(F.coalesce("text", F.lit(""))).alias("n"))
    rows = c.select("doc", F.struct("conv_id", "turn").alias("ord"), (F.col("n") % 4).cast("long").alias("depth"), F.concat(F.lit("turn "), "n").alias("title"), (F.col("n") % 30 + 1).cast("long").alias("page"))
    outline = tree.effective_depth(tree.numbered(rows))
    k = (F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("n")) % 12
    names = F.array(*map(F.lit, ["add", "select", "add", "delete", "before", "after", "inside", "rename", "page", "select", "undo", "redo"]))
    log = c.select((F.col("doc") + 1).alias("doc"), (F.col("conv_id") % 8 * 1000 + F.col("turn")).alias("seq"), F.element_at(names, (k + 1).cast("int")).alias("action"), (F.col("n") % 40).alias("node"), (F.col("n") % 37).alias("target"), F.concat(F.lit(" renamed "), "n").alias("title"), (F.col("n") % 35).alias("page"))
    return outline, log


def edit_replay(spark, sf):
    return edits.replay(*_edited(spark, sf))


def edit_sessions(spark, sf):
    return edits.sessions(*_edited(spark, sf))


def _interchange(spark, sf):
    n = table(spark, sf, "nation")
    return n.select((F.col("n_nationkey") + 1).cast("long").alias("ord"), F.lit("문서, \"가\".pdf").alias("filename"), (F.col("n_nationkey") % 3).cast("long").alias("depth"), F.concat(F.lit("제목 "), "n_name").alias("title"), (F.col("n_regionkey") + 1).cast("long").alias("page"))


def _roundtrip(spark, sf, ext):
    with tempfile.TemporaryDirectory() as d:
        path = os.path.join(d, f"rows.{ext}")
        (files.write_csv if ext == "csv" else files.write_xlsx)(_interchange(spark, sf), path)
        read, columns = files.read_sheets(spark, [path]), ["ord", "filename", "depth", "title", "page"]
        return spark.createDataFrame(read.select(*columns).collect(), read.select(*columns).schema)  # the file of 25 rows goes with its folder


def csv_roundtrip(spark, sf):
    return _roundtrip(spark, sf, "csv")


def xlsx_roundtrip(spark, sf):
    return _roundtrip(spark, sf, "xlsx")


def legacy_csv(spark, sf):
    raw = "파일명,계층,북마크명,페이지번호\n문서.pdf,0,서론,1\n문서.pdf,1,본론,+5\n".encode("euc-kr")
    rows = files.parse_csv(files.decode(raw))
    return spark.createDataFrame(rows, "ord long, filename string, depth long, title string, page long")


def autosave_recover(spark, sf):
    e = _events(spark, sf).select("session", F.col("ts").alias("saved_at"), (F.col("event_type") != "purchase").alias("dirty"), F.when(F.col("page") % 3 != 0, F.concat(F.lit("f"), "page")).alias("file_path"), F.lit("[]").alias("bookmarks"))
    return files.recover(files.autosave(e))


_HELPERS = {"table", "rows_of", "tree_of", "asked", "shown", "queries"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__}
    return {k: f for k, f in own.items() if not k.startswith("_") and k not in _HELPERS} | folders.queries()
