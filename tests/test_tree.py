"""Tree operators against a model of nested lists, and the fixtures of FIXTURES.md."""

import random

from pyspark.sql import functions as F

from outlinelake.operators import tree

SCHEMA = "doc long, ord long, depth long, title string, page long"


def built(spark, docs):
    rows = [(d, i, depth, f"{d}.{i}", page) for d, doc in enumerate(docs) for i, (depth, page) in enumerate(doc)]
    return tree.build(spark.createDataFrame(rows, SCHEMA))


def effs(depths):
    out, last = [], -1
    for d in depths:
        last = min(d, last + 1)
        out.append(last)
    return out


def model(doc):
    """(title, page, children) nodes of depth-encoded rows."""
    roots, stack = [], []
    for title, depth, page in doc:
        node = (title, page, [])
        del stack[depth:]
        (stack[-1][2] if stack else roots).append(node)
        stack.append(node)
    return roots


def flat(nodes, level=0):
    return [x for t, p, kids in nodes for x in [(level, t, p), *flat(kids, level + 1)]]


def got(df):
    out = {}
    for r in df.orderBy("doc", "rn").collect():
        out.setdefault(r.doc, []).append((r.eff, r.title, r.page))
    return out


def forests(n=60, seed=3):
    rng = random.Random(seed)
    return [[(rng.randint(0, 4), rng.randint(1, 12)) for _ in range(rng.randint(1, 9))] for _ in range(n)]


def test_build_is_the_stack_algorithm(spark):
    docs = [*forests(), [(0, 1), (2, 1), (2, 1)], [(3, 1)]]
    found = got(built(spark, docs))
    for d, doc in enumerate(docs):
        e = effs([x for x, _ in doc])
        assert [x[0] for x in found[d]] == e
        assert found[d] == flat(model([(f"{d}.{i}", e[i], p) for i, (_, p) in enumerate(doc)]))
    assert [x[0] for x in found[len(docs) - 2]] == [0, 1, 2]


def test_paths_and_neighbours(spark):
    docs = forests(30, 5)
    t = built(spark, docs)
    selected = {(r.doc, r.rn): r.selected for r in tree.next_selection(t).collect()}
    for r in t.withColumn("up", tree.parent()).collect():
        e = effs([x for x, _ in docs[r.doc]])
        path = [max(j for j in range(r.rn + 1) if e[j] == k and all(e[m] > k or m == j for m in range(j, r.rn + 1))) for k in range(e[r.rn] + 1)]
        assert r.path == path and r.up == (path[-2] if len(path) > 1 else None)
        same = [x.rn for x in t.where((F.col("doc") == r.doc)).collect() if x.path[:-1] == r.path[:-1]] if r.doc < 4 else None
        if same:
            i = same.index(r.rn)
            assert selected[r.doc, r.rn] == (same[i + 1] if i + 1 < len(same) else same[i - 1] if i else r.up)


def find(nodes, title):
    for i, n in enumerate(nodes):
        if n[0] == title:
            return nodes, i
        if hit := find(n[2], title):
            return hit
    return None


def test_moves(spark):
    docs = forests(80, 7)
    t = built(spark, docs).cache()
    rng = random.Random(1)
    asked = [(d, rng.randint(0, len(doc)), rng.randint(0, len(doc))) for d, doc in enumerate(docs)]
    moves = spark.createDataFrame(asked, "doc long, moving long, target long")
    errors = {r.doc: r.error for r in tree.check_moves(t, moves).collect()}
    for position in ("Before", "After", "Inside"):
        found = got(tree.move(t, moves, position))
        for d, moving, target in asked:
            e = effs([x for x, _ in docs[d]])
            nodes = model([(f"{d}.{i}", e[i], p) for i, (_, p) in enumerate(docs[d])])
            m, g = find(nodes, f"{d}.{moving}"), find(nodes, f"{d}.{target}")
            error = "InvalidMoveIntoDescendant" if moving == target or (m and find([m[0][m[1]]], f"{d}.{target}")) else None if m and g else "TargetNotFound"
            assert errors[d] == error
            if not error:
                node = m[0].pop(m[1])
                at, i = find(nodes, f"{d}.{target}")
                if position == "Inside":
                    at[i][2].append(node)
                else:
                    at.insert(i + (position == "After"), node)
            assert found[d] == flat(nodes)


def test_inserts_and_removal(spark):
    docs = forests(80, 11)
    t = built(spark, docs).cache()
    rng = random.Random(2)
    asked = [(d, rng.choice([None, rng.randint(0, len(doc))]), "new", rng.randint(0, 13)) for d, doc in enumerate(docs)]
    asked.append((len(docs), None, "new", 4))
    probes = spark.createDataFrame(asked, "doc long, at long, title string, page long")
    plain, paged = got(tree.insert(t, probes, by_page=False)), got(tree.insert(t, probes, by_page=True))
    gone = got(tree.remove(t, probes.select("doc", F.col("at").alias("victim"))))
    for d, at, title, page in asked[:-1]:
        def fresh(d=d):
            e = effs([x for x, _ in docs[d]])
            return model([(f"{d}.{i}", e[i], p) for i, (_, p) in enumerate(docs[d])])

        def by_page(kids, page=page):
            i = next((i for i, n in enumerate(kids) if n[1] > page), len(kids))
            kids.insert(i, (title, page, []))

        nodes = fresh()
        spot = find(nodes, f"{d}.{at}") if at is not None else None
        (spot[0][spot[1]][2] if spot else nodes).append((title, page, []))
        assert plain[d] == flat(nodes)
        nodes = fresh()
        spot = find(nodes, f"{d}.{at}") if at is not None else None
        anchor = [x[1] for x in flat(nodes) if x[2] <= page]
        if spot:
            by_page(spot[0][spot[1]][2])
        elif at is None and anchor:
            kids, i = find(nodes, anchor[-1])
            kids.insert(i + 1, (title, page, []))
        else:
            by_page(nodes)
        assert paged[d] == flat(nodes)
        nodes = fresh()
        if at is not None and (spot := find(nodes, f"{d}.{at}")):
            spot[0].pop(spot[1])
        assert gone.get(d, []) == flat(nodes)
    assert plain[len(docs)] == paged[len(docs)] == [(0, "new", 4)]


def test_active_is_last_in_order_not_nearest_page(spark):
    docs = forests(40, 13)
    probes = spark.createDataFrame([(d, p, p) for d in range(len(docs)) for p in range(14)], "doc long, probe long, page long")
    for r in tree.active(built(spark, docs), probes).collect():
        assert r.active == max((i for i, (_, p) in enumerate(docs[r.doc]) if p <= r.page), default=None)


def test_import_rows(spark):
    rows = spark.createDataFrame([(1, 3, "test", "셋째", 1), (1, 1, "test", "첫째", 2), (1, 2, "other", "남의 것", 3), (1, 2, "test", "둘째", 4)], "doc long, ord long, filename string, title string, src_row long")
    found = tree.prepare_import(rows, F.lit("test"), "src_row").orderBy("rn").collect()
    assert [r.title for r in found] == ["첫째", "둘째", "셋째"] and {r.skipped for r in found} == {1}


def test_page_fallback(spark):
    t = built(spark, [[(0, 5)], [(0, 2)]])
    pages = spark.createDataFrame([(0, 1)], "doc long, page long")
    assert {r.doc: r.target for r in tree.resolve_pages(t, pages).collect()} == {0: 1, 1: 0}
