"""Search, selections, line breaks, links and small string rules as column expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: What counts as white space when a title or a number is trimmed: Unicode's White_Space.
_BLANK = r"[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def trimmed(text: Column) -> Column:
    """text without white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, f"^{_BLANK}", ""), f"{_BLANK}$", "")


def _place(chars: DataFrame) -> list[str]:
    """What an index counts in: the page if there are pages, else the document."""
    return [c for c in ("doc", "page") if c in chars.columns]


def search(pages: DataFrame, query: str) -> DataFrame:
    """doc, page, match_no, idx of every occurrence of the query in page order, whatever its case; nothing for a blank query. pages: doc, page, text."""
    needle = query.strip().lower()
    hits = F.regexp_extract_all(F.lower("text"), F.lit(re.escape(needle)), F.lit(0)) if needle else F.array().cast("array<string>")
    found = pages.where(F.lit(bool(needle))).select("doc", "page", F.posexplode(hits).alias("match_no", "hit")).drop("hit")
    order = Window.partitionBy("doc").orderBy("page", "match_no")
    return found.select("doc", "page", F.col("match_no").cast("long").alias("match_no"), (F.row_number().over(order) - 1).cast("long").alias("idx"))


def start_match(matches: DataFrame, current: DataFrame) -> DataFrame:
    """doc, start: the first match on the current page or later, else 0. current: doc, at."""
    return matches.join(current, "doc").groupBy("doc").agg(F.coalesce(F.min(F.when(F.col("page") >= F.col("at"), F.col("idx"))), F.lit(0)).cast("long").alias("start"))


def cycled(idx: Column, n: Column) -> tuple[Column, Column]:
    """The next and the previous index, round and round."""
    return F.pmod(idx + 1, n), F.pmod(idx - 1, n)


def highlight(idx: Column, current: Column) -> Column:
    return F.when(idx == current, "primary").otherwise("secondary")


def normalised_range(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """First, last and number of characters of an inclusive range between two anchors."""
    return F.least(a, b), F.greatest(a, b), F.abs(a - b) + 1


def breaks_of(left: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """Before which of a run of characters a new line starts: where the distance from the one before it is more than 1.5 heights up or down or 6 aside (a height is 1 at least). Not before the first, nor next to one without bounds (nan)."""
    out = np.zeros(len(left), bool)
    if len(left) > 1:
        size = np.maximum(np.abs(top - bottom), 1.0)[1:]
        out[1:] = (np.abs(np.diff(top)) > size * 1.5) | (np.abs(np.diff(left)) > size * 6.0)
    return out


def _with_breaks(chars, boxes: dict, first: int = 0, last: int | None = None) -> str | None:
    """The text of a page's characters from first to last, with line breaks; None if one of them isn't there."""
    if chars is None:
        return None
    points = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), "<u4") if isinstance(chars, str) else None
    n = len(chars) if points is None else len(points)
    last = n - 1 if last is None else last
    if first < 0 or last >= n:
        return None
    cut = slice(first, last + 1)
    at = np.flatnonzero(breaks_of(*(np.asarray(boxes[c], float)[cut] for c in ("left", "top", "bottom"))))
    if points is not None:
        return np.insert(points[cut], at, 10).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    pieces = ["" if c is None else c for c in chars[cut]]
    for i in at.tolist():
        pieces[i] = "\n" + pieces[i]
    return "".join(pieces)


#: What a page's columns become before a kernel sees them: a function of a row (a dict) that gives chars or boxes as arrays.
Layout = Callable[[dict], dict]


def _rows(page: pd.DataFrame, layout: Layout | None) -> Iterator[dict]:
    for row in page.to_dict("records"):
        yield row | layout(row) if layout else row


def broken(page: Column, layout: Layout | None = None) -> Column:
    """A page's text with the inferred line breaks, of its characters from first to last where the page has these (null where one of them isn't there). page: a struct, whose fields or what layout makes of them are chars (a text whose code points are the characters, or an array of them; null: no text at that place), the arrays left, top, bottom of the same length (null: no bounds), and first and last for a range. One kernel a page, without a row a character."""

    @F.pandas_udf(T.StringType())
    def kernel(pages: pd.DataFrame) -> pd.Series:
        out = []
        for r in _rows(pages, layout):
            first, last = r.get("first", 0), r.get("last")
            if "first" in r and (pd.isna(first) or pd.isna(last)):
                out.append(None)
            else:
                out.append(_with_breaks(r["chars"], r, int(first), None if last is None else int(last)))
        return pd.Series(out, dtype=object)

    return kernel(page)


def extract(pages: DataFrame, ranges: DataFrame, layout: Layout | None = None) -> DataFrame:
    """doc (and page, if pages have it), text of inclusive ranges (doc, page, first, last) with the line breaks inside each range; no row where an index is missing. pages: what broken() needs of a page."""
    place = _place(pages)
    own = [c for c in pages.columns if c not in place]
    inside = pages.join(ranges.select(*place, "first", "last"), place)
    return inside.select(*place, broken(F.struct(*own, "first", "last"), layout).alias("text")).where("text is not null")


def line_breaks(chars: DataFrame) -> DataFrame:
    """chars with breaks: whether a new line starts before the character, by the distance from the one before it. A character without bounds breaks nothing and neither does the next. chars: doc, page if there are pages, idx, ch, left, top, bottom."""
    w = Window.partitionBy(*_place(chars)).orderBy("idx")
    size = F.greatest(F.abs(F.col("top") - F.col("bottom")), F.lit(1.0))
    far = (F.abs(F.col("top") - F.lag("top").over(w)) > size * 1.5) | (F.abs(F.col("left") - F.lag("left").over(w)) > size * 6.0)
    return chars.withColumn("breaks", F.coalesce(far, F.lit(False)))


def broken_text(chars: DataFrame) -> DataFrame:
    """doc (and page, if chars have it), text with the inferred line breaks."""
    piece = F.concat(F.when(F.col("breaks"), "\n").otherwise(""), F.coalesce("ch", F.lit("")))
    return line_breaks(chars).groupBy(*_place(chars)).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", piece.alias("s")))), lambda x: x["s"]), "").alias("text"))


def quads(chars: DataFrame) -> DataFrame:
    """The four corners of each character's box; the angle is passed on, not applied."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return chars.select("doc", "idx", F.array(corner("left", "top"), corner("right", "top"), corner("right", "bottom"), corner("left", "bottom")).alias("quad"), F.coalesce("angle", F.lit(0.0)).alias("rotation"))


class Grid:
    """A page's boxes by cells of `size`: each box is in all cells that it touches when widened by the tolerance, so a point looks at its own cell only. Boxes that touch more than 64 cells are kept apart and always looked at. within: the rectangle (left, right, bottom, top) that the points are in; boxes beyond it are left out."""

    def __init__(self, left, right, bottom, top, tolerance: float, size: float = 24.0, within: tuple = (-np.inf, np.inf, -np.inf, np.inf)):
        self.box, self.tolerance, self.size = (left, right, bottom, top), tolerance, size
        good = np.flatnonzero((left <= within[1] + tolerance) & (right >= within[0] - tolerance) & (bottom <= within[3] + tolerance) & (top >= within[2] - tolerance))
        cell = lambda x: np.floor(x / size).astype(np.int64)
        x0, x1, y0, y1 = cell(left[good] - tolerance), cell(right[good] + tolerance), cell(bottom[good] - tolerance), cell(top[good] + tolerance)
        wide, high = np.maximum(x1 - x0 + 1, 0), np.maximum(y1 - y0 + 1, 0)
        large = wide.astype(float) * high > 64
        self.large, n = good[large], np.where(large, 0, wide * high)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w = np.repeat(np.maximum(wide, 1), n)
        keys = self.key(np.repeat(x0, n) + k % w, np.repeat(y0, n) + k // w)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], np.repeat(good, n)[order]

    @staticmethod
    def key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x << 32) ^ (y & 0xFFFFFFFF)

    def nearest(self, x: float, y: float) -> int | None:
        """The box nearest to a point (the first of equals), if one is within the tolerance in both directions."""
        at = self.key(np.int64(np.floor(x / self.size)), np.int64(np.floor(y / self.size)))
        some = np.concatenate([self.rows[np.searchsorted(self.keys, at, "left") : np.searchsorted(self.keys, at, "right")], self.large])
        left, right, bottom, top = (b[some] for b in self.box)
        dx, dy = np.maximum(np.maximum(left - x, x - right), 0), np.maximum(np.maximum(bottom - y, y - top), 0)
        near = (dx <= self.tolerance) & (dy <= self.tolerance)
        if not near.any():
            return None
        d, some = (dx * dx + dy * dy)[near], some[near]
        return int(some[np.lexsort([some, d])[0]])


_HITS = T.ArrayType(T.StructType([T.StructField("probe", T.LongType()), T.StructField("idx", T.LongType())]))


def hit_test(pages: DataFrame, points: DataFrame, tolerance: float = 6.0, layout: Layout | None = None, at_once: int = 1000) -> DataFrame:
    """doc (and page, if pages have it), probe, idx of the character whose box, widened by the tolerance, is nearest to a point; no row for a point near none. points: doc, page if pages have it, probe, x, y; pages: the arrays left, right, bottom, top of a page's characters, or what layout makes them of.

    Each page builds a grid of its boxes in one task and its points look at their own cells, so neither a row a character nor a pair of character and point is made. Points of a page come in groups of about `at_once`."""
    place = _place(pages)
    own = [c for c in pages.columns if c not in place]

    @F.pandas_udf(_HITS)
    def kernel(rows: pd.DataFrame) -> pd.Series:
        out = []
        for r in _rows(rows, layout):
            some = [p for p in r["points"] if p["x"] is not None and p["y"] is not None and math.isfinite(p["x"] + p["y"])]
            x, y = [p["x"] for p in some] or [0.0], [p["y"] for p in some] or [0.0]
            grid = Grid(*(np.asarray(r[c], float) for c in ("left", "right", "bottom", "top")), tolerance, within=(min(x), max(x), min(y), max(y)))
            found = [(p["probe"], grid.nearest(p["x"], p["y"])) for p in some]
            out.append([{"probe": p, "idx": i} for p, i in found if i is not None])
        return pd.Series(out, dtype=object)

    # most pages have few points; those of others are dealt to as many groups as they need
    many = points.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / at_once).alias("groups"))
    dealt = points.join(many, place).withColumn("part", F.pmod(F.xxhash64("probe", "x", "y"), "groups"))
    some = dealt.groupBy(*place, "part").agg(F.collect_list(F.struct(F.col("probe").cast("long").alias("probe"), "x", "y")).alias("points"))
    found = pages.join(some, place).select(*place, F.explode(kernel(F.struct(*own, "points"))).alias("h"))
    return found.select(*place, "h.probe", "h.idx")


def normalize_uri(uri: Column) -> Column:
    whole = uri.contains("://") | uri.startswith("mailto:")
    return F.when(whole, uri).when(uri.contains("@") & ~uri.contains("/"), F.concat(F.lit("mailto:"), uri)).otherwise(F.concat(F.lit("http://"), uri))


def link_target(kind: Column, uri: Column, action_page0: Column, dest_page0: Column) -> tuple[Column, Column, Column]:
    """kind, page and uri of a link: its action decides if it has one, else its destination. Pages count from 1."""
    page = F.when(kind == "local", action_page0 + 1).when(kind.isNull(), dest_page0 + 1)
    to = F.when(kind == "uri", normalize_uri(uri))
    return F.when(page.isNotNull(), "Page").when(to.isNotNull(), "Uri"), page, to


def _level(size: Column) -> Column:
    """The grid for boxes of a size: cells of 64 * 2 ** level, so a box touches four of them at most."""
    return F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(1.0)) / 64)), F.lit(0)).cast("long")


def links_at(links: DataFrame, points: DataFrame) -> DataFrame:
    """The link under each point: points (doc, page, probe, x, y) with the columns of the last link (doc, page, link_no, left, bottom, right, top, ...) of the page whose box holds the point, edges included and corners in any order; no row for a point that no link holds. Links without a corner hold nothing, nor do links or points at no finite place.

    Links and points meet by the cells of grids, each link in the grid of its size, so a point is compared with the links near it. Columns of links may have any name."""
    own = [c for c in links.columns if c not in ("doc", "page")]
    fine = lambda c: F.coalesce(F.abs(c) < 1e15, F.lit(False))
    box = {"_l": F.least("left", "right"), "_r": F.greatest("left", "right"), "_b": F.least("bottom", "top"), "_t": F.greatest("bottom", "top")}
    placed = links.where(fine(F.col("left")) & fine(F.col("right")) & fine(F.col("bottom")) & fine(F.col("top"))).select("doc", "page", "link_no", *(c.cast("double").alias(k) for k, c in box.items()), F.struct(*(F.col(f"`{c}`") for c in own)).alias("_link"))
    placed = placed.withColumn("_level", _level(F.greatest(F.col("_r") - F.col("_l"), F.col("_t") - F.col("_b"))))
    cell = lambda x: F.floor(x / (64 * F.pow(F.lit(2.0), F.col("_level")))).cast("long")
    placed = placed.withColumn("_x", F.explode(F.sequence(cell(F.col("_l")), cell(F.col("_r"))))).withColumn("_y", F.explode(F.sequence(cell(F.col("_b")), cell(F.col("_t")))))
    levels = [r[0] for r in placed.select("_level").distinct().collect()]  # one for each power of two of a size
    at = points.where(fine(F.col("x")) & fine(F.col("y"))).select("doc", "page", "probe", F.col("x").alias("_px"), F.col("y").alias("_py"))
    at = at.withColumn("_level", F.explode(F.array(*(F.lit(v) for v in levels)).cast("array<bigint>"))).withColumn("_x", cell(F.col("_px"))).withColumn("_y", cell(F.col("_py")))
    held = placed.join(at, ["doc", "page", "_level", "_x", "_y"]).where("_px between _l and _r and _py between _b and _t")
    last = held.groupBy("doc", "page", "probe").agg(F.max_by("_link", "link_no").alias("link"))
    return last.select("doc", "page", "probe", "link.*")


def u32(text: Column) -> Column:
    """A trimmed unsigned 32-bit number, else null."""
    s = trimmed(text)
    n = F.expr("null").cast("long")
    value = F.when(s.rlike(r"^\+?[0-9]{1,18}$"), F.regexp_replace(s, r"^\+", "").cast("long")).otherwise(n)
    return F.when(value <= 4294967295, value)


def export_name(path: Column, ext: str) -> Column:
    """bookmark-<stem>.<ext>, or bookmarks.<ext> without a name."""
    name = F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.when(F.length(stem) > 0, F.concat(F.lit("bookmark-"), stem, F.lit(f".{ext}"))).otherwise(f"bookmarks.{ext}")
