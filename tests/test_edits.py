"""Replayed edit logs against a version with nested nodes."""

import copy

import numpy as np
import pytest

from outlinelake.operators import edits


class Nested:
    """The same rules, plainly: nodes are [id, title, page, children]."""

    def __init__(self, rows):
        self.roots, path = [], []
        for i, depth, title, page in rows:
            node = [i, title, page, []]
            path = path[:depth]
            (path[-1][3] if path else self.roots).append(node)
            path.append(node)
        self.undo, self.redo, self.page, self.selected, self.chosen = [], [], 1, None, False

    def walk(self, nodes=None, depth=0, parent=None):
        for n in self.roots if nodes is None else nodes:
            yield n, depth, parent, self.roots if nodes is None else nodes
            yield from self.walk(n[3], depth + 1, n)

    def find(self, i):
        return next((x for x in self.walk() if x[0][0] == i), None)

    def push(self):
        if len(self.undo) >= 20:
            self.undo.pop(0)
        self.undo.append(copy.deepcopy(self.roots))
        self.redo = []

    @staticmethod
    def ordered(siblings, node):
        siblings.insert(next((k for k, s in enumerate(siblings) if s[2] > node[2]), len(siblings)), node)

    def edit(self, seq, action, node, target, title, page):
        if action == "add":
            self.push()
            new = [-1 - seq, "새 북마크", self.page, []]
            if self.chosen and self.selected is not None:
                at = self.find(self.selected)
                self.ordered(at[0][3] if at else self.roots, new)
            else:
                anchors = [x for x in self.walk() if x[0][2] <= self.page]
                if anchors:
                    siblings = anchors[-1][3]
                    siblings.insert(siblings.index(anchors[-1][0]) + 1, new)
                else:
                    self.ordered(self.roots, new)
            self.selected, self.chosen = new[0], True
        elif action == "delete" and self.selected is not None:
            at = self.find(self.selected)
            self.push()
            if at is None:
                self.undo.pop()
                return
            n, _, parent, siblings = at
            k = siblings.index(n)
            other = siblings[k + 1] if k + 1 < len(siblings) else siblings[k - 1] if k else parent
            siblings.remove(n)
            self.selected = other[0] if other else None
            self.chosen = other is not None
        elif action in ("before", "after", "inside") and None not in (node, target) and node != target:
            self.push()
            m, t = self.find(node), self.find(target)
            if m is None or t is None or any(x[0][0] == target for x in self.walk([m[0]])):
                self.undo.pop()
                return
            m[3].remove(m[0])
            t = self.find(target)
            k = t[3].index(t[0])
            if action == "inside":
                t[0][3].append(m[0])
            else:
                t[3].insert(k + (action == "after"), m[0])
        elif action == "rename" and title and title.strip():
            if at := self.find(node):
                at[0][1] = title.strip()
        elif action == "select" and node is not None:
            self.selected, self.chosen = node, True
        elif action == "page" and page is not None:
            self.page = max(1, page)
            found = [x[0][0] for x in self.walk() if x[0][2] <= self.page]
            self.selected, self.chosen = (found[-1] if found else None), False
        elif action == "undo" and self.undo:
            if len(self.redo) >= 20:
                self.redo.pop(0)
            self.redo.append(self.roots)
            self.roots, self.selected = self.undo.pop(), None
        elif action == "redo" and self.redo:
            self.undo.append(self.roots)
            self.roots, self.selected = self.redo.pop(), None

    def rows(self):
        return [(n[0], d, n[1], n[2]) for n, d, _, _ in self.walk()]


TREE = "doc long, rn long, eff long, title string, page long, id string"
LOG = "doc long, seq long, action string, node long, target long, title string, page long"
ACTIONS = ["add", "add", "delete", "before", "after", "inside", "rename", "select", "select", "page", "undo", "redo", "nothing"]


def test_replay(spark):
    rng, rows, log, want, states = np.random.default_rng(1), [], [], {}, {}
    for doc in range(60):
        tree, depth = [], -1
        for rn in range(int(rng.integers(0, 12))):
            depth = int(rng.integers(0, depth + 2))
            tree.append((rn, depth, f"t{rn}", int(rng.integers(1, 9))))
        rows += [(doc, rn, d, t, p, "own") for rn, d, t, p in tree]
        s = Nested(tree)
        for seq in range(int(rng.integers(0, 90)) if doc else 60):
            action = str(rng.choice(ACTIONS)) if doc else ["add", "undo", "redo"][seq // 25]  # more than the limit
            node, target = (None if rng.random() < 0.05 else int(rng.integers(-seq - 1, 12)) for _ in range(2))
            e = (action, node, target, str(rng.choice(["", "  ", " x "])), None if rng.random() < 0.1 else int(rng.integers(-1, 10)))
            log.append((doc, seq, *e))
            s.edit(seq, *e)
        want[doc] = s.rows()
        states[doc] = (s.page, s.selected, s.chosen, len(s.undo), len(s.redo), len(want[doc]))
    assert states[0][3:5] == (10, 10) or states[0][4] > 0
    rows.append((None, 0, 0, "lost", 1, "own"))
    log += [(None, 0, "add", None, None, None, None), (3, None, "add", None, None, None, None)]
    tree, edit = spark.createDataFrame(rows, TREE).repartition(4), spark.createDataFrame(log, LOG).repartition(5)
    got = {}
    for r in edits.replay(tree, edit).orderBy("doc", "rn").collect():
        got.setdefault(r.doc, []).append((r.id, r.eff, r.title, r.page))
    assert got == {d: r for d, r in want.items() if r}
    known = {r[0] for r in rows} | {r[0] for r in log}
    assert {r.doc: tuple(r)[1:] for r in edits.sessions(tree, edit).collect()} == {d: s for d, s in states.items() if d in known}
    assert edits.replay(tree.limit(0), edit.limit(0)).count() == 0


def test_undo_keeps_twenty_trees():
    s = edits.Session([])
    for seq in range(30):
        s.edit(seq, "add", None, None, None, None)
    for _ in range(25):
        s.edit(99, "undo", None, None, None, None)
    assert (len(s.rows), len(s.undo), len(s.redo)) == (10, 0, 20)
    s.edit(99, "redo", None, None, None, None)
    assert (len(s.rows), len(s.undo), len(s.redo)) == (11, 1, 19)


def test_sql_of_session_folds_with_equal_times(spark):
    from pyspark.sql import functions as F

    from outlinelake.streaming import session

    rows = [(1, 5, k, a, p) for k, (a, p) in enumerate([("go", 9), ("go", 3), ("back", 0), ("go", 9), ("go", 12), ("go", 0)])]
    df = spark.createDataFrame(rows, "session long, ts long, seq long, action string, page long")
    assert tuple(session.page_history(df).first()) == (1, 0, "1,9,12", "")
    assert tuple(session.page_history(df.withColumn("total", F.lit(10))).first()) == (1, 1, "1,9,10", "")
