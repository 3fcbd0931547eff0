"""Page geometry: clamps, render widths, offsets, and look-ups of pages by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the viewer.
MIN_ZOOM, MAX_ZOOM, MAX_SIDE, MIN_WIDTH, GAP, DEFAULT_ASPECT = 0.25, 8.0, 16384, 50, 8.0, 1.414


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def page_clamp(page: Column, total: Column) -> Column:
    return clamp(page, F.lit(1), F.greatest(total, F.lit(1)))


def zoom_clamp(zoom: Column) -> Column:
    return clamp(zoom, F.lit(MIN_ZOOM), F.lit(MAX_ZOOM))


def wheel_zoom(zoom: Column, dy: Column) -> Column:
    return zoom_clamp(zoom * (F.lit(1.0) + dy * 0.001))


def pan_clamp(pan: Column, page: Column, view: Column) -> Column:
    most = F.greatest((page - view) / 2, F.lit(0.0))
    return clamp(pan, -most, most)


def render_width(target: Column, width: Column, height: Column, limit: Column) -> Column:
    """The widest render at most `target` whose sides fit the texture limit."""
    side = F.least(limit, F.lit(MAX_SIDE)).cast("double")
    aspect = F.when(width > 0, height.cast("double") / width).otherwise(1.0)
    fitted = F.when(target * aspect > side, side / aspect).otherwise(target.cast("double"))
    return F.greatest(F.floor(F.least(fitted, side)), F.lit(MIN_WIDTH)).cast("long")


def zoom_ceiling(aspect: Column, limit: Column, panel: Column, scale: Column) -> Column:
    side = F.least(limit, F.lit(MAX_SIDE)).cast("double")
    return F.greatest(F.when(aspect > 1, side / aspect).otherwise(side) / F.greatest(panel * scale, F.lit(1.0)), F.lit(MIN_ZOOM))


def fit_zoom(width: Column, height: Column, aspect: Column) -> Column:
    return zoom_clamp(height / F.greatest(width * aspect, F.lit(1.0)))


def target_width(width: Column, zoom: Column, scale: Column) -> Column:
    return F.greatest(F.round(width * zoom * scale), F.lit(float(MIN_WIDTH))).cast("long")


def aspect(width: Column, height: Column) -> Column:
    """Height by width; 1 for a page that can't be read."""
    return F.coalesce(height / F.greatest(width, F.lit(1.0)), F.lit(1.0))


def offsets(pages: DataFrame, width: float) -> DataFrame:
    """pages (doc, page, aspect) with height, top and bottom in one column of pages."""
    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    p = pages.withColumn("height", F.lit(width) * F.coalesce("aspect", F.lit(DEFAULT_ASPECT)))
    p = p.withColumn("top", F.coalesce(F.sum(F.col("height") + GAP).over(before), F.lit(0.0)))
    return p.withColumn("bottom", F.col("top") + F.col("height"))


def _views(views: DataFrame) -> list[str]:
    """What a view or probe is known by: its id if it has one, else its document."""
    return [c for c in ("doc", "view") if c in views.columns]


#: Height of the bins in which pages and probes meet.
BIN = 4096.0


def page_at(laid: DataFrame, probes: DataFrame, width: float) -> DataFrame:
    """probes (doc, y, and x if they have it, and what else) with page, the first page there; null in gaps and beside the pages. Pages stand in all bins of the heights that they reach into and a probe looks at its own bin, so it is compared with the pages near it, however many the document has."""
    slot = lambda y: F.floor(y / BIN).cast("long")
    own = probes.columns
    inside = F.lit(True) if "x" not in own else F.col("x").between(0, width)
    p = probes.withColumn("_bin", slot(F.col("y"))).withColumn("_id", F.monotonically_increasing_id())
    binned = laid.select(F.col("doc").alias("_doc"), F.col("page").alias("_page"), "top", "bottom", F.explode(F.sequence(slot(F.col("top")), slot(F.col("bottom")))).alias("_bin"))
    at = (F.col("doc") == F.col("_doc")) & (p["_bin"] == binned["_bin"]) & (F.col("top") <= F.col("y")) & (F.col("y") <= F.col("bottom")) & inside
    found = p.join(binned, at, "left")
    return found.groupBy("_id", *own).agg(F.min("_page").alias("page")).drop("_id")


def visible(laid: DataFrame, views: DataFrame, width: float) -> DataFrame:
    """doc, view if views have it, first, last: pages in view, a buffer of a page's width (200 at least) around it. views: doc, view, view_top, view_bottom."""
    buffer = max(width, 200.0)
    seen = (F.col("bottom") >= F.greatest(F.col("view_top") - buffer, F.lit(0.0))) & (F.col("top") <= F.col("view_bottom") + buffer)
    return laid.join(views, "doc").groupBy(*_views(views)).agg(F.coalesce(F.min(F.when(seen, F.col("page"))), F.min("page")).alias("first"), F.coalesce(F.max(F.when(seen, F.col("page"))), F.min("page")).alias("last"))


def tracked(laid: DataFrame, views: DataFrame, width: float) -> DataFrame:
    """doc, page: of the pages in view the one whose middle is nearest to the view's, the first of equals."""
    keys = _views(views)
    j = laid.join(views, "doc").join(visible(laid, views, width), keys).where(F.col("page").between(F.col("first"), F.col("last")))
    distance = F.abs(F.col("top") + F.col("height") / 2 - (F.col("view_top") + F.col("view_bottom")) / 2)
    return j.groupBy(*keys).agg(F.min(F.struct(distance.alias("d"), "page")).alias("m")).select(*keys, F.col("m.page").alias("page"))


def retained(page: Column, first: Column, last: Column) -> Column:
    """Whether a rendered page is kept: in view or next to it."""
    return page.between(first - 1, last + 1)
