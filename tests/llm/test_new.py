"""Operators 11 to 13 against brute force, on tables with awkward rows, ties and empty tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from outlinelake.llm import centroids, prefix_trie, wu_manber


def brute_clusters(rows, k=8, rounds=10, dim=64):
    x = [(i, [math.floor(1024 * v) if abs(v) < 1e300 else int(v) * 1024 for v in e]) for i, e in rows if e and len(e) == dim and all(v is not None and math.isfinite(v) for v in e)]
    sha = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    c = [v for _, v in sorted(x, key=lambda r: (r[0] is None, sha(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in x]
        c = [[sum(col) // at.count(j) for col in zip(*(v for (_, v), a in zip(x, at) if a == j))] if j in at else m for j, m in enumerate(c)]
    found = [(i, *near(v)) for i, v in x]
    fit = lambda v: v if v < 1 << 63 else None
    every = fit(sum(d for _, d, _ in found))
    return sorted(((i, j, fit(d), fit(sum(e for _, e, m in found if m == j)), every, ",".join(map(str, c[j]))) for i, d, j in found), key=str)


@pytest.mark.parametrize("kind", ["plain", "wide", "huge", "few"])
def test_clusters(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 64).tolist()) for i in range(5 if kind == "few" else 150)]
    if kind != "few":
        rows += [(500 + i, rows[0][1]) for i in range(40)] + [(7, rows[3][1]), (None, rows[9][1])]
    if kind in ("wide", "huge"):  # beyond 2^53 in squares, then beyond 64 bits
        rows += [(900 + i, [float(v) * (2.0**18 if kind == "wide" else 1e30 if i % 2 else 1e307) for v in rng.normal(0, 1, 64)]) for i in range(9)]
    bad = [(700, None), (701, []), (702, [1.0] * 63), (703, [1.0] * 65), (704, [None] + [1.0] * 63), (705, [math.inf] + [1.0] * 63), (706, [math.nan] * 64)]
    df = spark.createDataFrame([(i, e, 1, "own") for i, e in rows + bad], "vec_id long, embedding array<double>, cluster int, `a.b` string").repartition(3)
    got = centroids.cluster(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows)
    assert centroids.cluster(df.where("vec_id < -1")).count() == 0


def test_squares_are_exact_at_the_bounds():
    rng = np.random.default_rng(2)
    for top in (1000, 1 << 22, 1 << 23, 1 << 24, 1 << 27, 1 << 29, 1 << 40):
        x, c = rng.integers(-top, top + 1, (40, 64)), rng.integers(-top, top + 1, (5, 64))
        x[::7] //= 1000
        labels, d = centroids.nearest(x, c)
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for v in x]
        assert [(int(a), int(b)) for a, b in zip(d, labels)] == want


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_hits(docs, items, size=10):
    out = []
    for i, t in docs:
        w, hit, names, any_ = item_words(t), set(), set(), False
        for name, item in items:
            v = item_words(item)
            m = min(len(v), size)
            windows = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if m else ()
            for s in range(len(w) - m + 1) if m else ():
                if tuple(w[s : s + m]) in windows:
                    hit |= set(range(s, s + m))
                    names |= {name} - {None}
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_benchmark_hits(spark, monkeypatch):
    rng = np.random.default_rng(5)
    make = lambda n, top=30: " ".join(f"w{k}" for k in rng.integers(0, top, n))
    items = [(i, make(int(n))) for i, n in enumerate(rng.integers(1, 60, 60))] + [(100, None), (101, " .,"), (102, "W1"), (None, make(12)), (3, make(20)), (103, "naïve Σας, 漢字"), (104, make(9000, 9999))]
    items += [(105, items[5][1]), (106, "a b c d e f g h i j")]
    docs = [(i, make(int(n))) for i, n in enumerate(rng.integers(0, 300, 80))]
    for i in range(60):
        w = items[int(rng.integers(0, 60))][1].split()
        docs.append((200 + i, f"{make(20, 500)}-{', '.join(w[int(rng.integers(0, 5)):]).upper()}! {make(15, 500)}"))
    docs += [(300, None), (301, ""), (302, " \n"), (303, items[-3][1] + " tail " + " ".join(make(40000, 9999).split())), (None, "w1"), (304, "Naïve Σας"), (304, "naïve.Σας.漢字"), (305, "a b c d e"), (306, "f g h i j"), (307, "xa b c d e f g h i j")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, `a.b` string, items int").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    want = brute_hits(docs, items)
    assert sorted(map(tuple, wu_manber.digests(wu_manber.find(df, b)).collect()), key=str) == want
    for piece, group in ((20, 300), (4096, 500)):  # items in pieces and groups
        monkeypatch.setattr(wu_manber, "PIECE", piece)
        monkeypatch.setattr(wu_manber, "GROUP", group)
        folder, groups = wu_manber.compiled(b)
        assert groups > 20
        texts = pa.array([t for _, t in docs])
        at, hit, found = wu_manber.search(texts, folder, groups, 10)
        rows = [(i, int(at[k + 1] - at[k]), int(hit[at[k] : at[k + 1]].sum()), len(found.get(k, ()))) for k, (i, _) in enumerate(docs)]
        assert sorted(rows, key=str) == sorted((r[:4] for r in want), key=str)
    left = wu_manber.clean(df, b)
    assert left.columns == df.columns and left.count() == sum(not r[5] for r in want)
    assert wu_manber.find(df.where("doc_id < -1"), b).count() == 0
    none = wu_manber.digests(wu_manber.find(df, b.where("item_id < -1"))).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)


def test_spans_of_hits(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten y short item z"), (2, "short item short item")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "One two three, four five six seven eight nine ten!"), (8, "short item")], "item_id long, text string")
    got = {r.doc_id: ([tuple(s) for s in r.spans], r["items"]) for r in wu_manber.find(docs, items).collect()}
    assert got == {1: ([(1, 10), (12, 2)], [7, 8]), 2: ([(0, 4)], [8])}


def test_shift_table_skips():
    rng = np.random.default_rng(1)
    t = wu_manber.Table(np.unique(rng.integers(0, 1000, (50, 10)), axis=0).astype(np.int32))
    text = np.full(100_000, -1, np.int32)
    text[5000:5010], text[99_990:] = t.patterns[3], t.patterns[4]
    starts, which = t.search(text)
    assert sorted(zip(starts.tolist(), which.tolist())) == [(5000, int(t.order[3])), (99_990, int(t.order[4]))]
    looked = []
    slot = t.slot
    t.slot = lambda block: (looked.append(len(block[0])), slot(block))[1]
    t.ends(text)
    assert sum(looked) < len(text) / 7


def brute_trie(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:])
    nodes = {}
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            nodes.setdefault(made[c][:d], []).append(c)
    kids = {k: sum(len(m) == len(k) + 1 and m[: len(k)] == k for m in nodes) for k in nodes}
    out = []
    for k, members in nodes.items():
        below = [m for m in nodes if m[: len(k)] == k]
        saved = sum((len(nodes[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(str(c) for c in members if len(made[c]) == len(k))
        out.append((members[0], len(k), nodes[k[:-1]][0] if k else None, len(members), kids[k], sum(not kids[m] for m in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def the_trie(df):
    return prefix_trie.rebuilt_trie(df, F.col("conv") - F.col("conv") % 5, 8, F.crc32(F.col("conv").cast("string")) % 9)


TURNS = "conv_id long, turn long, role string, text string, conv long, depth string, `a.b` int"


@pytest.mark.parametrize("parts", [1, 5])
def test_trie(spark, parts, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rng = np.random.default_rng(parts)
    rows = []
    for c in range(-7, 60):
        if c % 11:
            for t in range(int(rng.integers(1, 12))):
                rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "", None]), rng.choice(["a", "é" * 9, None, ""]) if t > 2 else "same", 1, "own", 1))
    rows += [(c, t, "u", f"turn {t}", 1, "own", 1) for c in range(100, 140) for t in range(12)]  # copies
    rows += [(200, t // 3, "u", "x" * 200_000 if t == 50 else "x", 1, "own", 1) for t in range(150)]  # long, with ties and repeats
    rows += [(None, 1, "u", "no id", 1, "own", 1), (300, None, None, None, None, None, None)]
    rows += [(400 + i, t, "u", f"{t}", 1, "own", 1) for i in range(12) for t in range(i + 1)]  # each goes on where the one before ends
    got = the_trie(spark.createDataFrame(rows, TURNS).repartition(parts)).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)
    assert the_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_trie_with_few_hot_prefixes(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HOT", 3)
    rows = [(c, t, "u", "first" if t == 0 else f"{c // 4} {t}", 1, "own", 1) for c in range(40) for t in range(5)]
    assert sorted(map(tuple, the_trie(spark.createDataFrame(rows, TURNS)).collect()), key=str) == brute_trie(rows)


def test_running_sums_over_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that eight ranges stay
        rng = np.random.default_rng(1)
        rows = [(1, i, int(x)) for i, x in enumerate(rng.integers(-(1 << 62), 1 << 62, 3000))] + [(k, i, 1) for k in range(2, 40) for i in range(7)]
        found, stored = prefix_trie.running(spark.createDataFrame(rows, "k long, i long, x long").repartition(3), "k", [F.desc("i")], ["x"], "test")
        assert stored.select("part").distinct().count() > 4 and stored.where("k = 1").select("part").distinct().count() > 3
        got, want = {(r.k, r.i): r.x for r in found.collect()}, {}
        sums = {}
        for k, i, x in sorted(rows, key=lambda r: -r[1]):
            sums[k] = (sums.get(k, 0) + x + (1 << 63)) % (1 << 64) - (1 << 63)
            want[k, i] = sums[k]
        assert got == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
