"""Every query against its SQL on the small tables."""

import compare
import pytest

from outlinelake.plans import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, SF)
    sql = oracles.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare.differs(df, sql, con) == ""


def test_entry_has_no_llm_needs(spark):
    import __spark_entry__ as e

    assert set(oracles.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc", "rn", "eff", "clamped"]


def test_every_character_has_a_quad(spark, con):
    n, last = con.execute("SELECT sum(length(text)), max(length(text)) - 1 FROM documents").fetchone()
    q = queries.queries()["char_quads"](spark, SF)
    assert (q.count(), q.agg({"idx": "max"}).first()[0]) == (n, last) and last >= 50


BOXES = "doc long, page long, chars array<string>, left array<double>, right array<double>, bottom array<double>, top array<double>"


def test_ranges_and_breaks_by_page(spark):
    from pyspark.sql import functions as F

    from outlinelake.functions import text

    chars = ["a", "b", None, "c", "d", "e", "f"]
    left, top, bottom = [0.0, 6.0, 100.0, None, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, None, -40.0, -60.0, -61.0], [-10.0, -10.0, -10.0, None, -50.0, -60.5, -61.5]
    pages = spark.createDataFrame([(1, p, chars, left, left, bottom, top) for p in (1, 2)] + [(2, 1, [], [], [], [], []), (3, 1, None, None, None, None, None)], BOXES)
    page = F.struct("chars", "left", "top", "bottom")
    got = pages.select("doc", "page", text.broken(page).alias("text")).collect()
    assert sorted((r.doc, r.page, r.text) for r in got if r.doc < 3) == [(1, 1, "ab\ncd\nef"), (1, 2, "ab\ncd\nef"), (2, 1, "")] and [r.text for r in got if r.doc == 3] == [None]
    # a range breaks anew at its first character
    ranges = spark.createDataFrame([(1, 1, 1, 3), (1, 1, 2, 5), (1, 2, 5, 6), (1, 1, 3, 7), (1, 1, -1, 2), (1, 1, None, 2), (2, 1, 0, 0), (3, 1, 0, 0)], "doc long, page long, first long, last long")
    assert sorted((r.doc, r.page, r.text) for r in text.extract(pages, ranges).collect()) == [(1, 1, "b\nc"), (1, 1, "cd\ne"), (1, 2, "ef")]
    rows = [(1, p, i, c, x, t, b) for p in (1, 2) for i, (c, x, t, b) in enumerate(zip(chars, left, top, bottom))]
    by_row = text.broken_text(spark.createDataFrame(rows, "doc long, page long, idx long, ch string, left double, top double, bottom double"))
    assert sorted((r.doc, r.page, r.text) for r in by_row.collect()) == [(1, p, "ab\ncd\nef") for p in (1, 2)]


def test_hits_equal_those_of_all_pairs(spark):
    import numpy as np

    from outlinelake.functions import text

    rng = np.random.default_rng(3)
    pages, points, want = [], [], {}
    for d in range(4):
        n = 300
        x, y = rng.integers(-200, 200, n).astype(float), rng.integers(-200, 200, n).astype(float)
        w, h = rng.integers(0, 9, n).astype(float), rng.integers(0, 9, n).astype(float)
        w[0], h[0] = 900.0, 0.0  # a box of many cells
        box = [x, x + w, y, y + h]
        pages.append((d, 1, [], *([None if i == 5 else float(v) for i, v in enumerate(b)] for b in box)))
        for p in range(60):
            px, py = (float(v) for v in rng.uniform(-230, 230, 2)) if p % 2 else (float(v) for v in rng.integers(-230, 230, 2))
            points.append((d, 1, p, px, py))
            dx, dy = np.maximum(np.maximum(box[0] - px, px - box[1]), 0), np.maximum(np.maximum(box[2] - py, py - box[3]), 0)
            near = [(dx[i] ** 2 + dy[i] ** 2, i) for i in range(n) if i != 5 and dx[i] <= 6 and dy[i] <= 6]
            if near:
                want[d, p] = min(near)[1]
    points += [(0, 1, 900, None, 1.0), (0, 1, 901, float("nan"), 1.0), (9, 1, 902, 0.0, 0.0)]
    got = text.hit_test(spark.createDataFrame(pages, BOXES), spark.createDataFrame(points, "doc long, page long, probe long, x double, y double"), at_once=7)
    assert {(r.doc, r.probe): r.idx for r in got.collect()} == want


def test_a_grid_compares_few_boxes():
    import numpy as np

    from outlinelake.functions import text

    n = 100_000
    left, top = (np.arange(n) % 80) * 6.0, np.arange(n) // 80 * -12.0
    g = text.Grid(left, left + 6, top - 10, top, 6.0)
    sizes = np.diff(np.flatnonzero(np.concatenate([[True], g.keys[1:] != g.keys[:-1], [True]])))
    assert sizes.max() < 40 and not len(g.large) and g.nearest(13.0, -1205.0) == 80 * 100 + 2


def test_links_of_all_sizes(spark):
    import numpy as np

    from outlinelake.functions import text

    rng, links, points, want = np.random.default_rng(4), [], [], {}
    for k in range(200):
        size = float(10 ** rng.uniform(-1, 7))
        x, y = (float(v) for v in rng.uniform(-2000, 2000, 2))
        links.append((1, k % 3, k, x, y, x + size * (-1) ** k, y - size / 3, "own"))
    for p in range(150):
        x, y = (float(v) for v in rng.uniform(-2500, 2500, 2))
        points.append((1, p % 3, p, x, y))
        held = [k for _, page, k, a, b, c, d, _ in links if page == p % 3 and min(a, c) <= x <= max(a, c) and min(b, d) <= y <= max(b, d)]
        if held:
            want[p] = max(held)
    links += [(1, 0, 900, float("nan"), 0.0, 1.0, 1.0, "own"), (1, 0, 901, float("-inf"), 0.0, float("inf"), 1.0, "own")]
    got = text.links_at(spark.createDataFrame(links, "doc long, page long, link_no long, left double, bottom double, right double, top double, `a.b` string"), spark.createDataFrame(points, "doc long, page long, probe long, x double, y double"))
    assert {r.probe: r.link_no for r in got.collect()} == want and "a.b" in got.columns


def test_pages_at_places(spark):
    from outlinelake.functions import layout

    laid = layout.offsets(spark.createDataFrame([(1, p, 20.0 if p == 3 else 1.0) for p in range(1, 9)], "doc long, page long, aspect double"), 600.0)
    rows = laid.collect()
    probes = [(1, float(y), x, k) for k, (y, x) in enumerate([(0, 0), (600, 600), (604, 1), (608, -1), (608, 1), (9000, 601), (9000, 3), (5, 5), (5, 5), (1e9, 1), (-1, 1)])] + [(2, 1.0, 1, 99)]
    got = {r.k: r.page for r in layout.page_at(laid, spark.createDataFrame([(d, y, float(x), k) for d, y, x, k in probes], "doc long, y double, x double, k long"), 600.0).collect()}
    assert got == {k: next((r.page for r in rows if d == 1 and r.top <= y <= r.bottom and 0 <= x <= 600), None) for d, y, x, k in probes}
