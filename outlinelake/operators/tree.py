"""Outline trees as flat pre-order tables: doc, rn (0-based pre-order place), eff (effective depth), title, page, path.

Input rows have doc, ord, depth, title, page and a tie-break that makes (ord, tie...) a total order in a document.
Everything is one window per document, array functions, or an order-key rewrite: rows that stay have the key
(rn, 0), rows that are put elsewhere a key before (x, -1) or behind (x, 1) another row, and rn is numbered anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.text import trimmed

#: A fixed value: the title of a row that is put in without one.
NEW_TITLE = "새 북마크"


def _so_far():
    """A document's rows up to the current one."""
    return Window.partitionBy("doc").orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def numbered(rows: DataFrame, *tie: str) -> DataFrame:
    """rn of rows in stable order."""
    return rows.withColumn("rn", (F.row_number().over(Window.partitionBy("doc").orderBy("ord", *tie)) - 1).cast("long"))


def effective_depth(rows: DataFrame) -> DataFrame:
    """eff: a row is at most one level below the row before it, the first a root. eff - rn is a running minimum."""
    return rows.withColumn("eff", F.col("rn") + F.least(F.lit(0).cast("long"), F.min(F.col("depth") - F.col("rn")).over(_so_far())))


def paths(tree: DataFrame, levels: int | None = None) -> DataFrame:
    """path: rn of all ancestors from the root down to the row itself. levels: 1 + the largest eff, else it is looked up."""
    if levels is None:
        levels = (tree.agg(F.max("eff")).first()[0] or 0) + 1
    last = [F.last(F.when(F.col("eff") == k, F.col("rn")), ignorenulls=True).over(_so_far()) for k in range(levels)]
    return tree.withColumn("path", F.slice(F.array(*last), F.lit(1), (F.col("eff") + 1).cast("int")))


def build(rows: DataFrame, *tie: str, levels: int | None = None) -> DataFrame:
    """The tree of depth-encoded rows."""
    return paths(effective_depth(numbered(rows, *tie)), levels)


def parent() -> Column:
    return F.when(F.size("path") > 1, F.element_at("path", -2))


def ancestors() -> Column:
    return F.slice("path", F.lit(1), F.size("path") - 1)


def contains(path: Column | str, rn: Column) -> Column:
    """Whether the row of this path is rn or below it."""
    return F.array_contains(path, rn)


def ends(tree: DataFrame) -> DataFrame:
    """doc, top, end, size: the last rn of each row's subtree and its number of rows."""
    return tree.select("doc", "rn", F.explode("path").alias("top")).groupBy("doc", "top").agg(F.max("rn").alias("end"), F.count(F.lit(1)).alias("size"))


def flatten(tree: DataFrame) -> DataFrame:
    """Interchange rows in pre-order with a fresh 1-based order."""
    return tree.select("doc", (F.row_number().over(Window.partitionBy("doc").orderBy("rn"))).cast("long").alias("ord"), F.col("eff").alias("depth"), "title", "page")


def prepare_import(rows: DataFrame, name: Column, *tie: str) -> DataFrame:
    """Rows whose filename is `name` byte for byte, in stable order; skipped counts the others of the document."""
    all_ = rows.withColumn("skipped", F.count_if(~F.coalesce(F.col("filename") == name, F.lit(False))).over(Window.partitionBy("doc")))
    return numbered(all_.where(F.col("filename") == name), *tie)


def import_counts(rows: DataFrame, name: Column) -> DataFrame:
    """doc, kept, skipped: how many rows of a document have the filename `name` and how many don't, documents of which none is kept included; a null filename is another name."""
    own = F.coalesce(F.col("filename") == name, F.lit(False))
    return rows.groupBy("doc").agg(F.count_if(own).alias("kept"), F.count_if(~own).alias("skipped"))


def apply_import(tree: DataFrame, rows: DataFrame, name: Column, *tie: str, levels: int | None = None) -> DataFrame:
    """The outlines after an import: a document's tree is replaced by that of its rows with the filename `name`, and stays as it is where no row is kept."""
    kept = prepare_import(rows, name, *tie)
    new = paths(effective_depth(kept), levels).select("doc", "rn", "eff", "title", "page", "path")
    # documents with a row that is kept, one row each
    taken = new.where("rn = 0").select("doc")
    return tree.select(*new.columns).join(taken, "doc", "left_anti").unionByName(new)


def _renumber(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc").orderBy("k1", "k2", "rn")
    return rows.select("doc", (F.row_number().over(order) - 1).cast("long").alias("rn"), "eff", "title", "page")


def _with_edits(tree: DataFrame, edits: DataFrame, *own: str) -> tuple[DataFrame, WindowSpec]:
    """Rows and edits of each document side by side (is_edit tells which), the edits' columns `own` on all of them; and the document as a window. One pass over the tree: what an edit has to know of it are windows by doc."""
    null = lambda kind: F.lit(None).cast(kind)
    kinds = dict(tree.dtypes)
    rows = tree.select("doc", "rn", "eff", "title", "page", "path", F.lit(False).alias("is_edit"), *(null("bigint").alias(f"_{c}") for c in own))
    asked = edits.select("doc", null("bigint").alias("rn"), null("bigint").alias("eff"), *(F.col(c).cast(kinds[c]).alias(c) if c in edits.columns else null(kinds[c]).alias(c) for c in ("title", "page")), null(kinds["path"]).alias("path"), F.lit(True).alias("is_edit"), *(F.col(c).cast("bigint").alias(f"_{c}") for c in own))
    w = Window.partitionBy("doc")
    return rows.unionByName(asked).withColumns({c: F.max(f"_{c}").over(w) for c in own}).drop(*(f"_{c}" for c in own)), w


def insert(tree: DataFrame, probes: DataFrame, by_page: bool) -> DataFrame:
    """Insert one node per document. probes: doc, at (rn of the parent; null: none given), title, page.

    Plainly the node becomes the last child, or the last root where the parent is missing. By page it comes before the
    first sibling of a later page; with no parent given it follows, as a sibling, the subtree of the last row in
    pre-order whose page isn't later, or comes among the roots if there is none.
    """
    both, w = _with_edits(tree, probes, "at")
    both = both.withColumn("new_page", F.max(F.when(F.col("is_edit"), F.col("page"))).over(w))
    old, later = ~F.col("is_edit"), F.col("page") > F.col("new_page")
    facts = {
        "p_eff": F.max(F.when(F.col("rn") == F.col("at"), F.col("eff"))), "p_end": F.max(F.when(F.array_contains("path", F.col("at")), F.col("rn"))),
        "child": F.min(F.when(old & later & (parent() == F.col("at")), F.col("rn"))), "root": F.min(F.when(old & later & (F.col("eff") == 0), F.col("rn"))),
        "anchor": F.max(F.when(old & ~later, F.struct("rn", "eff"))), "end": F.max("rn"),
    }
    both = both.withColumns({k: f.over(w) for k, f in facts.items()})
    both = both.withColumn("a_end", F.max(F.when(F.array_contains("path", F.col("anchor.rn")), F.col("rn"))).over(w))
    has_parent = F.col("p_eff").isNotNull()
    rules = [(has_parent, F.col("p_end"), F.lit(1), F.col("p_eff") + 1), (F.lit(True), F.coalesce("end", F.lit(-1)), F.lit(1), F.lit(0))]
    if by_page:
        anchored = F.col("at").isNull() & F.col("anchor").isNotNull()
        rules = [(has_parent & F.col("child").isNotNull(), F.col("child"), F.lit(-1), F.col("p_eff") + 1), rules[0], (anchored, F.col("a_end"), F.lit(1), F.col("anchor.eff")), (F.col("root").isNotNull(), F.col("root"), F.lit(-1), F.lit(0)), rules[1]]
    choose = lambda k, stays: F.coalesce(F.when(old, stays), *(F.when(r[0], r[k]) for r in rules)).cast("long")
    return _renumber(both.select("doc", choose(1, F.col("rn")).alias("k1"), choose(2, F.lit(0)).alias("k2"), F.coalesce("rn", F.lit(-1)).cast("long").alias("rn"), choose(3, F.col("eff")).alias("eff"), "title", "page"))


def remove(tree: DataFrame, victims: DataFrame) -> DataFrame:
    """The tree without the subtrees of victims (doc, victim), numbered anew."""
    left = tree.join(victims, "doc", "left").where(F.col("victim").isNull() | ~F.array_contains("path", F.col("victim")))
    return _renumber(left.select("doc", F.col("rn").alias("k1"), F.lit(0).alias("k2"), "rn", "eff", "title", "page"))


def check_moves(tree: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (doc, moving, target) with error: InvalidMoveIntoDescendant, TargetNotFound, or null; and both rows' eff."""
    of = lambda rn, c: F.max(F.when(F.col("rn") == F.col(rn), F.col(c)))
    facts = tree.join(moves, "doc").groupBy("doc").agg(of("moving", "eff").alias("m_eff"), of("target", "eff").alias("t_eff"), of("target", "path").alias("t_path"))
    bad = (F.col("moving") == F.col("target")) | F.coalesce(F.array_contains("t_path", F.col("moving")), F.lit(False))
    missing = F.col("m_eff").isNull() | F.col("t_eff").isNull()
    return moves.join(facts, "doc", "left").withColumn("error", F.when(bad, "InvalidMoveIntoDescendant").when(missing, "TargetNotFound"))


def move(tree: DataFrame, moves: DataFrame, position: str) -> DataFrame:
    """Move one subtree per document Before, After or Inside (as last child of) a target; rejected moves change nothing."""
    if position not in ("Before", "After", "Inside"):
        raise ValueError(position)
    both, w = _with_edits(tree, moves, "moving", "target")
    of = lambda rn, c: F.max(F.when(F.col("rn") == F.col(rn), F.col(c))).over(w)
    both = both.withColumns({"m_eff": of("moving", "eff"), "t_eff": of("target", "eff"), "t_path": of("target", "path")})
    good = F.coalesce((F.col("moving") != F.col("target")) & F.col("m_eff").isNotNull() & F.col("t_eff").isNotNull() & ~F.array_contains("t_path", F.col("moving")), F.lit(False))
    both = both.withColumn("moved", good & F.coalesce(F.array_contains("path", F.col("moving")), F.lit(False)))
    both = both.withColumn("end", F.max(F.when(~F.col("moved") & F.array_contains("path", F.col("target")), F.col("rn"))).over(w)).where("not is_edit")
    k1, k2 = (F.col("target"), -1) if position == "Before" else (F.col("end"), 1)
    delta = F.col("t_eff") + (1 if position == "Inside" else 0) - F.col("m_eff")
    return _renumber(both.select("doc", F.when(F.col("moved"), k1).otherwise(F.col("rn")).alias("k1"), F.when(F.col("moved"), k2).otherwise(0).alias("k2"), "rn", (F.col("eff") + F.when(F.col("moved"), delta).otherwise(0)).alias("eff"), "title", "page"))


def active(tree: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (doc, probe, page) with active: the last row in pre-order whose page isn't later, null if there is none. A running maximum over pages, no join."""
    both = tree.select("doc", "page", "rn", F.lit(None).cast("long").alias("probe")).unionByName(probes.select("doc", "page", F.lit(None).cast("long").alias("rn"), F.col("probe").cast("long")))
    upto = Window.partitionBy("doc").orderBy("page").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("active", F.max("rn").over(upto)).where("probe is not null").select("doc", "probe", "page", "active")


def next_selection(tree: DataFrame) -> DataFrame:
    """What is selected after a row goes: the next sibling, else the one before, else the parent, else nothing."""
    t = tree.withColumn("parent", parent())
    w = Window.partitionBy("doc", "parent").orderBy("rn")
    return t.withColumn("selected", F.coalesce(F.lead("rn").over(w), F.lag("rn").over(w), F.col("parent")))


def visible(tree: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Rows with no proper ancestor among collapsed (doc, shut array<long>), with the rows before and after in sight."""
    seen = tree.join(collapsed, "doc", "left").where(F.col("shut").isNull() | ~F.arrays_overlap(ancestors(), F.col("shut")))
    w = Window.partitionBy("doc").orderBy("rn")
    return seen.withColumn("above", F.lag("rn").over(w)).withColumn("below", F.lead("rn").over(w))


def fold_target(tree: DataFrame) -> DataFrame:
    """Which row a fold acts on: a row with children itself, else its parent."""
    below = F.lead("eff").over(Window.partitionBy("doc").orderBy("rn"))
    return tree.withColumn("has_children", F.coalesce(below > F.col("eff"), F.lit(False))).withColumn("fold", F.when(F.col("has_children"), F.col("rn")).otherwise(parent()))


def drop_position(ratio: Column) -> Column:
    return F.when(ratio < 0.25, "Before").when(ratio > 0.75, "After").otherwise("Inside")


def rename(old: Column, new: Column) -> Column:
    """A trimmed new title, or the old one if nothing is left."""
    title = trimmed(new)
    return F.when(F.length(title) > 0, title).otherwise(old)


def resolve_pages(tree: DataFrame, pages: DataFrame) -> DataFrame:
    """target: the row's page if the document has it, else its first page, 0 without pages. pages: doc, page."""
    have = pages.select("doc", F.col("page").alias("target")).distinct()
    first = pages.groupBy("doc").agg(F.min("page").alias("first_page"))
    t = tree.join(have, (tree.doc == have.doc) & (tree.page == have.target), "left").select(tree["*"], "target").join(first, "doc", "left")
    return t.withColumn("target", F.coalesce("target", "first_page", F.lit(0))).drop("first_page")
