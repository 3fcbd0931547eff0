"""Edit logs of outlines: many ordered edits a document, replayed over its tree with selection, undo and redo.

A document's rows and then its edits reach one task in order and are folded as they come; the task holds one tree, as
rows in pre-order, and up to UNDO_LIMIT earlier ones that share their rows with it. Documents are dealt by key; a log is
a sequence, so a document's edits can't be shared out, but they are never held.

Edits (action, with node, target, title, page as it needs them):
  add            a row under the selected one, if that was chosen, else by page (see tree.insert()); it is then chosen
  delete         the selected row and all below it; the next one in line is then chosen (see tree.next_selection())
  before, after, inside   move node to target; what tree.check_moves() rejects changes nothing
  rename         node gets the title, trimmed, if anything is left of it; this can't be undone
  select         node is chosen (a node that isn't there can be chosen, and nothing is under it)
  page           go to a page (1 at least): its active row is selected, but not chosen
  undo, redo     the tree before the last change, or after the last undone; nothing is selected then
Other actions, and nodes and pages that are missing where they are needed, change nothing. A change puts the tree on the
undo pile and empties the redo pile, even if it is then rejected, but for a move onto itself; of more than UNDO_LIMIT
the oldest go (redo puts back without that limit).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tree import NEW_TITLE

UNDO_LIMIT = 20
#: Unicode's White_Space, as functions.text.trimmed() takes it.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
Row = tuple  # id, depth, title, page


def _at(rows: list[Row], node) -> int:
    return next((i for i, r in enumerate(rows) if r[0] == node), -1)


def _end(rows: list[Row], i: int) -> int:
    """Behind the last row below i."""
    return next((j for j in range(i + 1, len(rows)) if rows[j][1] <= rows[i][1]), len(rows))


def _ordered(rows: list[Row], start: int, end: int, depth: int, page: int) -> int:
    """Where a row comes among those of a depth from start to end: before the first of a later page, else at the end."""
    return next((j for j in range(start, end) if rows[j][1] == depth and rows[j][3] > page), end)


def _added(rows: list[Row], node, parent, page: int) -> list[Row]:
    p = -1 if parent is None else _at(rows, parent)
    if p >= 0:
        at, depth = _ordered(rows, p + 1, _end(rows, p), rows[p][1] + 1, page), rows[p][1] + 1
    else:
        anchor = max((i for i, r in enumerate(rows) if r[3] <= page), default=-1) if parent is None else -1
        at, depth = (_end(rows, anchor), rows[anchor][1]) if anchor >= 0 else (_ordered(rows, 0, len(rows), 0, page), 0)
    return [*rows[:at], (node, depth, NEW_TITLE, page), *rows[at:]]


def _moved(rows: list[Row], node, target, action: str) -> list[Row] | None:
    i = _at(rows, node)
    t = _at(rows, target)
    if i < 0 or t < 0 or i <= t < _end(rows, i):
        return None
    block, rest = rows[i : _end(rows, i)], rows[:i] + rows[_end(rows, i) :]
    t = _at(rest, target)
    at = t if action == "before" else _end(rest, t)
    shift = rest[t][1] + (action == "inside") - block[0][1]
    return rest[:at] + [(a, depth + shift, b, c) for a, depth, b, c in block] + rest[at:]


def _next(rows: list[Row], i: int):
    """What is chosen when row i goes: the next sibling, else the one before, else the parent."""
    depth, end = rows[i][1], _end(rows, i)
    if end < len(rows) and rows[end][1] == depth:
        return rows[end][0]
    return next((r[0] for r in reversed(rows[:i]) if r[1] <= depth), None)


class Session:
    """One document while its edits are replayed."""

    def __init__(self, rows: list[Row]):
        self.rows, self.undo, self.redo = rows, [], []
        self.page, self.selected, self.chosen = 1, None, False

    def change(self, rows: list[Row] | None) -> bool:
        self.undo = [*self.undo[-UNDO_LIMIT + 1 :], self.rows]
        self.redo = []
        if rows is None:
            self.undo.pop()
            return False
        self.rows = rows
        return True

    def edit(self, seq: int, action: str, node, target, title, page) -> None:
        if action == "add":
            self.change(_added(self.rows, -1 - seq, self.selected if self.chosen else None, self.page))
            self.selected, self.chosen = -1 - seq, True
        elif action == "delete" and self.selected is not None:
            i = _at(self.rows, self.selected)
            after = _next(self.rows, i) if i >= 0 else None
            if self.change(None if i < 0 else self.rows[:i] + self.rows[_end(self.rows, i) :]):
                self.selected, self.chosen = after, after is not None
        elif action in ("before", "after", "inside") and node is not None and target is not None and node != target:
            self.change(_moved(self.rows, node, target, action))
        elif action == "rename" and title and title.strip(_BLANK):
            self.rows = [(r[0], r[1], title.strip(_BLANK), r[3]) if r[0] == node else r for r in self.rows]
        elif action == "select" and node is not None:
            self.selected, self.chosen = node, True
        elif action == "page" and page is not None:
            self.page = max(1, page)
            self.selected, self.chosen = next((r[0] for r in reversed(self.rows) if r[3] <= self.page), None), False
        elif action == "undo" and self.undo:
            self.redo = [*self.redo[-UNDO_LIMIT + 1 :], self.rows]
            self.rows, self.selected = self.undo.pop(), None
        elif action == "redo" and self.redo:
            self.undo.append(self.rows)
            self.rows, self.selected = self.redo.pop(), None


_INPUT = ["doc", "kind", "k", "action", "node", "target", "title", "page"]
TREE = "doc long, rn long, id long, eff long, title string, page long"
STATE = "doc long, current_page long, selected long, chosen boolean, undo long, redo long, n long"


def _sessions(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Session]]:
    doc, s, rows = None, None, []
    for b in batches:
        b = b.astype(object).where(b.notna(), None)
        for d, kind, k, action, node, target, title, page in b[_INPUT].itertuples(index=False, name=None):
            if d != doc:
                if doc is not None:
                    yield doc, s or Session(rows)
                doc, s, rows = d, None, []
            if kind == 0:
                rows.append((int(k), int(node), title, int(page)))
            else:
                s = s or Session(rows)
                s.edit(int(k), action, *(None if x is None else int(x) for x in (node, target)), title, None if page is None else int(page))
    if doc is not None:
        yield doc, s or Session(rows)


def _trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for doc, s in _sessions(batches):
        if s.rows:
            out = pd.DataFrame(s.rows, columns=["id", "eff", "title", "page"])
            yield out.assign(doc=doc, rn=range(len(out)))[["doc", "rn", "id", "eff", "title", "page"]]


def _states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for doc, s in _sessions(batches):
        one = pd.DataFrame([(doc, s.page, s.selected, s.chosen, len(s.undo), len(s.redo), len(s.rows))], columns=[c.split()[0] for c in STATE.split(", ")])
        yield one.astype({"selected": "Int64"})


def _dealt(tree: DataFrame, edits: DataFrame) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    long = lambda c: F.col(c).cast("long").alias(c)
    rows = tree.where("doc is not null").select(long("doc"), F.lit(0).alias("kind"), F.col("rn").cast("long").alias("k"), null("string").alias("action"), F.col("eff").cast("long").alias("node"), null("long").alias("target"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("page", F.lit(1)).cast("long").alias("page"))
    log = edits.where("doc is not null and seq is not null").select(long("doc"), F.lit(1).alias("kind"), F.col("seq").cast("long").alias("k"), "action", long("node"), long("target"), "title", long("page"))
    return rows.unionByName(log).repartition("doc").sortWithinPartitions("doc", "kind", "k", "action", "node", "target", "title", "page")


def replay(tree: DataFrame, edits: DataFrame) -> DataFrame:
    """doc, rn, id, eff, title, page of outlines (doc, rn, eff, title, page) after their edits (doc, seq, action, node, target, title, page) in order of seq. Rows are known by the rn they had, added ones by -1 - seq. Documents without edits stay as they are, those with edits alone begin empty; rows without a document or edits without a seq are left out."""
    return _dealt(tree, edits).mapInPandas(_trees, TREE)


def sessions(tree: DataFrame, edits: DataFrame) -> DataFrame:
    """doc, current_page, selected, chosen, undo, redo (sizes), n (rows) after all edits; see replay()."""
    return _dealt(tree, edits).mapInPandas(_states, STATE)
