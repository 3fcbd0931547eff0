"""The operators for training text against brute force, round trips, libraries and held-out accuracy, on small tables with awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import compare
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from outlinelake.llm import bpe_automaton, byte_bpe, components, exact_dedup, hamming, minhash, packing, pitman_yor, quality, queries, suffix_dedup, token_files, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid string, digest string"
LONG = "the quick brown fox jumps over a lazy dog, éà " * 3000
AWKWARD = [None, "", " \t\n", "a", "one two three", "One TWO three", LONG, LONG, LONG + "!", "<|endoftext|> a<|startoftext|>", "x\x0b y  z q", "naïve Σας ﬁ 漢字 😀", "aaaa" * 100, "don't I'LL"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "own", "own") for i, t in enumerate(AWKWARD)]
    rows += [(3, "a", "en", "s", 1, "own", "own"), (None, "null id", None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    docs.repartition(3, "source").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, stored):
    return stored.where("doc_id < -1")


@pytest.fixture(scope="module")
def real(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer(name))


def test_bpe_equals_the_library(stored, none, real, spark):
    path = queries.tokenizer("word_bpe_49k.json")
    lib = library("word_bpe_49k.json")
    for r in stored.join(bpe_automaton.encode(stored, path).withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d")).where("doc_id <> 3").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r for r in queries.op1_bpe_automaton(spark, SF).collect()}
    for i, t in real[::9]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[i].n_tokens == len(ids)
    again = bpe_automaton.decode(bpe_automaton.encode(stored, path).select("doc_id", "ids"), path)
    assert again.count() == stored.count() and bpe_automaton.digests(none, path).count() == 0


def test_automaton_on_random_words():
    c = bpe_automaton.Codec(queries.tokenizer("word_bpe_49k.json"))
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("aabnhetsi "), 40)) for _ in range(300)]
    starts, ids = c.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == c.library.encode(t, add_special_tokens=False).ids


def test_transitions_are_those_of_merging():
    def merged(word, merges):
        parts = list(word)
        for u, v in merges:
            at, out = 0, []
            while at < len(parts):
                two = parts[at : at + 2] == [u, v]
                out.append(u + v if two else parts[at])
                at += 2 if two else 1
            parts = out
        return parts

    rng, tried = np.random.default_rng(11), 0
    for _ in range(12):
        labels, merges = list("abc"), []
        while len(merges) < 25:
            u, v = (labels[i] for i in rng.integers(0, len(labels), 2))
            if u + v not in labels and len(u + v) < 12:
                merges.append((u, v))
                labels.append(u + v)
        # labels that merging their own letters gives otherwise can't be reached; the library has none of them
        good = [t for t in labels if merged(t, merges) == [t]]
        merges = [(u, v) for u, v in merges if u + v in good]
        good = [t for t in labels if merged(t, merges) == [t]]
        if any(u + v not in good for u, v in merges):
            continue
        tried += 1
        vocab = {t: i for i, t in enumerate(good)}
        made = bpe_automaton.Automaton(vocab, merges, "")
        for a in good:
            for b in good:
                assert made.next(vocab[a], vocab[b]) == (merged(a + b, merges) == [a, b])
        for _ in range(200):
            word = "".join(rng.choice(list("abc"), rng.integers(0, 30)))
            assert [made.label(i) for i in made.encode(word)] == merged(word, merges)
            # at each position one arc goes on, so no step is taken back
            states = [None] + [vocab[merged(word[:i], merges)[-1]] for i in range(1, len(word) + 1)]
            for to in range(1, len(word) + 1):
                on = [t for t in good if word[:to].endswith(t) and (len(t) == to or made.next(states[to - len(t)], vocab[t]))]
                assert on == [made.label(states[to])]
    assert tried >= 6


def test_byte_ids_equal_the_library():
    e = byte_bpe.Encoder(queries.tokenizer("byte_bpe_50k.json"))
    texts = [t or "" for t in AWKWARD if t != LONG] + ["a  b", " \n x", "x\n\n y ", "'s a's", "<|endoftext|>"]
    starts, ids = e.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == e.library.encode(t, add_special_tokens=False).ids


def test_language_model(spark, stored, none, real):
    got = {r.doc_id: r for r in queries.op2_pitman_yor(spark, SF).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in real}
    tokens = {i: [*words_of(t), ""] for i, t in real}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    test = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test) and all(r.score < 0 for r in got.values())
    p = {r.held_out: r for r in pitman_yor.perplexity(spark.createDataFrame(list(got.values()))).collect()}[True]
    assert p.perplexity < p.base_perplexity
    odd = pitman_yor.score(stored, pitman_yor.held_out()).collect()
    assert len(odd) == len(AWKWARD) + 2 and all(r.score < 0 for r in odd)
    assert pitman_yor.score(none, pitman_yor.held_out()).count() == 0
    assert all(r.n_known == 0 and r.base_score == 0 for r in pitman_yor.score(stored, F.lit(True)).collect())


def test_scores_do_not_depend_on_partitions(spark, stored):
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (2, 8, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted((r.doc_id or -1, r.n_tokens, r.score) for r in pitman_yor.score(stored, pitman_yor.held_out()).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_scores_do_not_depend_on_the_session(spark, stored, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 150_000)  # several blocks a partition
    before, found = spark.conf.get(name), []
    try:
        for made, read in (("20000", "20000"), ("20000", "9000000"), ("9000000", "20000")):
            spark.conf.set(name, made)
            scores = pitman_yor.score(stored, pitman_yor.held_out())
            spark.conf.set(name, read)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
            found.append(sorted((r.doc_id or -1, r.n_tokens, r.score) for r in scores.collect()))
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    finally:
        spark.conf.set(name, before)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == found[2]


def test_blocks_do_not_depend_on_batches():
    rng = np.random.default_rng(2)
    texts = ["x" * int(n) for n in rng.choice([0, 0, 3, 10, 40, 90, 250], 400)]
    whole = pa.record_batch({"text": texts})
    of = lambda batches: [t["text"].to_pylist() for t in pitman_yor.steady(batches, 100)]
    want = of([whole])
    assert sum(want, []) == texts and all(len(b) == 1 or sum(map(len, b)) <= 100 for b in want)
    for _ in range(20):
        cuts = [0, *sorted(rng.integers(0, 401, 30).tolist()), 400]
        assert of(whole.slice(a, z - a) for a, z in zip(cuts[:-1], cuts[1:])) == want


def test_stages_keep_odd_columns(spark, stored, none):
    import corpus_pipeline

    odd = lambda df: df.withColumnRenamed("rid", "a.b").withColumnRenamed("digest", "row").withColumn("c`d", F.lit(1))
    for docs in (odd(stored), odd(none)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= docs.count(), name
            rows = {tuple(r)[2:4] + tuple(r)[5:] for r in out.collect()}
            assert rows <= {tuple(r)[2:4] + tuple(r)[5:] for r in docs.collect()}, name


def test_contexts_of_the_language_model(spark, tmp_path):
    import inspect

    pairs = [("end.", "comma,"), ("seven7", "zoo-"), ("back", "zoo-"), ("war", "dog")]  # each pair's last bytes have classes of their own
    rows = [(i, f"{a} x{k}" if i % 2 else f"{b} y{k}") for i in range(200) for k, (a, b) in enumerate(pairs)]
    asked = [(1000 + 2 * k + j, f"{a} {'xy'[j]}{k}") for k, (a, _) in enumerate(pairs) for j in range(2)]
    spark.createDataFrame(rows + asked, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r.score for r in pitman_yor.score(spark.read.parquet(str(tmp_path / "d")), F.col("doc_id") >= 1000).where("doc_id >= 1000").collect()}
    assert [k for k in range(len(pairs)) if got[1000 + 2 * k] < got[1001 + 2 * k] + 0.5] == []
    assert inspect.signature(pitman_yor.score).parameters["burn"].default == 2


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    c = rng.integers(0, 9, (50, pitman_yor.CLASSES)) + (np.arange(50) == 0)[:, None] * 500
    c = c[c.sum(axis=1) > 0]
    t = np.minimum(c, 1)
    r = pitman_yor.Restaurants(np.full(pitman_yor.CLASSES, 0.5), np.full(pitman_yor.CLASSES, 10.0), c.sum(axis=0).astype(float), t.sum(axis=0).astype(float), 0.6, 10.0, len(c))
    for j in range(pitman_yor.CLASSES):
        t[:, j] = pitman_yor.seat(c[:, j], t.sum(axis=1) - t[:, j], j, r, pitman_yor.Draws(rng.integers(0, 1 << 62, len(c)).astype(np.uint64), 0, j))
    assert ((t <= c) & ((t > 0) == (c > 0))).all()
    r.tables = t.sum(axis=0).astype(float)
    assert np.allclose(r.known(c, t).sum(axis=0) + r.unknown(), 1)


def test_words_before_have_contexts_of_their_own(spark, tmp_path):
    # both words before have one last letter, so one class
    rows = [(i, f"{'bat' if i % 2 else 'cat'} {'xy'[i % 2]}") for i in range(200)]
    asked = [(1000, "bat y"), (1001, "bat x"), (1002, "cat x"), (1003, "cat y")]
    spark.createDataFrame(rows + asked, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r.score for r in pitman_yor.score(spark.read.parquet(str(tmp_path / "d")), F.col("doc_id") >= 1000).where("doc_id >= 1000").collect()}
    assert got[1000] > got[1001] + 1 and got[1002] > got[1003] + 1


def test_probabilities_after_a_word_sum_to_one():
    rng, n, m = np.random.default_rng(4), 60, 25
    c = rng.poisson(0.6, (n, m)) + (rng.random((n, m)) < 0.01) * 3000
    c[c.sum(axis=1) == 0, 0] = 1
    c[:, 3] = 0  # a context without customers
    words = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
    before = np.sort(rng.integers(0, 1 << 59, m).astype(np.uint64) << np.uint64(4) | (np.arange(m) % pitman_yor.CLASSES).astype(np.uint64))
    u4 = lambda x: pitman_yor.packed(np.ravel(x).astype("<u4"))
    row = {"p": 0, "words": pitman_yor.gaps(words, "<u8"), "runs": u4(np.full(n, m)), "contexts": pitman_yor.gaps(before, "<u8"), "context": u4(np.tile(np.arange(m), n)), "c": u4(c), "t": u4(np.minimum(c, 1)), "tables": b"", "prob": b""}
    b, seen = pitman_yor.Bucket(row).load(), c.sum(axis=1) > 0
    for k in range(4):
        (sent,) = pitman_yor.batched(b.sent(1), pitman_yor._SUMS)
        customers, tables = b.received(pa.Table.from_batches(pitman_yor._totals(iter([sent]))), 1)
        assert (customers.reshape(n, m) == c.sum(axis=0)).all() and (tables.reshape(n, m) == b.t.reshape(n, m).sum(axis=0)).all()
        r = pitman_yor.Restaurants(np.full(pitman_yor.CLASSES, 0.5), np.full(pitman_yor.CLASSES, 10.0), b.counts.sum(axis=0).astype(float), b.tables.sum(axis=0).astype(float), 0.6, 10.0, int(seen.sum()), 0.7, 1.0)
        p = b.probabilities(r, customers, tables).reshape(n, m)[seen].sum(axis=0)
        new = (1.0 + 0.7 * tables[:m]) * r.unknown()[b.k[:m]] / (customers[:m] + 1.0)
        assert np.allclose(p + new, 1)
        b.seat(r, k, tables)
        assert ((b.t <= b.c) & ((b.t > 0) == (b.c > 0))).all() and ((b.tables <= b.counts) & ((b.tables > 0) == (b.counts > 0))).all()
    assert (b.t > 1).any() and (b.tables.sum() > (b.counts > 0).sum())


def test_tables_of_a_word_follow_their_conditional():
    """Of 3 customers in a context restaurant whose dish its class has from elsewhere, against the formula."""
    n, d, theta, above, others, mass = 40_000, 0.5, 1.0, 2, 5, 0.25
    k = pitman_yor.CLASSES
    r = pitman_yor.Restaurants(np.full(k, 0.4), np.full(k, 10.0), np.full(k, 90.0), np.full(k, 30.0), 0.6, 10.0, 9, d, theta)
    full = lambda x: np.full(n, x)
    draws = pitman_yor.Draws(np.arange(n).astype(np.uint64), 0, k)
    t = pitman_yor.seat_word(full(3), full(7.0), full(others), full(above), full(mass), full(0), r, draws)
    new = [(others + i - 0.4 * above + mass) / 100 for i in range(3)]
    weight = np.array([s * (theta + d * 7) ** i * np.prod(new[:i]) for i, s in ((1, 0.75), (2, 1.5), (3, 1))])
    assert np.allclose(np.bincount(t, minlength=4)[1:] / n, weight / weight.sum(), atol=0.01)


def test_a_dish_is_seated_with_one_random_number_until_it_has_many_customers():
    class Counted(pitman_yor.Draws):
        drawn = 0

        def uniform(self, rows, number):
            out = super().uniform(rows, number)
            Counted.drawn += out.size
            return out

    k, c = pitman_yor.CLASSES, np.append(np.full(2000, 30), [49, 5000])
    n, full = len(c), lambda x: np.full(len(c), x)
    r = pitman_yor.Restaurants(np.full(k, 0.4), np.full(k, 10.0), np.full(k, 90.0), np.full(k, 30.0), 0.6, 10.0, 9, 0.5, 1.0)
    names = np.arange(n).astype(np.uint64)
    t = pitman_yor.seat_word(c, full(7.0), full(5), full(2), full(0.25), full(0), r, Counted(names, 0, k))
    # runs of the largest only: 3 numbers each, about ln(5000 / 48) / ln(17 / 16) of them
    assert ((t >= 1) & (t <= c)).all() and Counted.drawn < n + 3 * 100
    Counted.drawn = 0
    t = pitman_yor.seat(c, full(5), 0, r, Counted(names, 0, 0))
    assert ((t >= 1) & (t <= c)).all() and Counted.drawn < n + 3 * 100


def test_tables_of_a_class_follow_their_conditional():
    """Of few and of many customers, whose dish has others in the root or none, against sums over Stirling numbers."""
    n, k = 40_000, pitman_yor.CLASSES
    r = pitman_yor.Restaurants(np.full(k, 0.4), np.full(k, 10.0), np.full(k, 90.0), np.full(k, 30.0), 0.6, 10.0, 9)
    a, root = math.log(10 + 0.4 * 30), math.log(r.root_customers + 10)
    for c, others in ((2, 0), (3, 4), (17, 0), (40, 3)):
        t = pitman_yor.seat(np.full(n, c), np.full(n, others), 0, r, pitman_yor.Draws(np.arange(n).astype(np.uint64), c, others))
        logs = [pitman_yor.stirling(0.4)[c, i] + i * (a - root) + math.lgamma(others - 0.6 + i) for i in range(1, c + 1)]
        weight = np.exp(np.array(logs) - max(logs))
        assert np.allclose(np.bincount(t, minlength=c + 1)[1:] / n, weight / weight.sum(), atol=0.01), (c, others)


def test_base_counts_are_by_words_when_hashes_collide(monkeypatch):
    """A block's words travel with its pairs, so a bucket counts them without another reading of the texts."""
    monkeypatch.setattr(pitman_yor, "hashed", lambda strings: np.full(len(strings), 7 << 40, np.uint64))
    texts = [["b a a", "held a c"], ["a d", "", "é b"]]
    held, rows = [[False, True], [False, False, False]], []
    for p, (mine, out) in enumerate(zip(texts, held)):
        monkeypatch.setattr(pitman_yor.TaskContext, "get", lambda p=p: type("Task", (), {"partitionId": lambda self: p})())
        rows += pitman_yor._pairs(3, iter([pa.record_batch({"doc_id": list(range(len(mine))), "text": mine, "held": out})]))
    (state,) = pitman_yor._gather(iter(rows))
    (state,) = state.to_pylist()
    learnt = Counter(w for mine, out in zip(texts, held) for t, h in zip(mine, out) if not h for w in [*t.split(), ""])
    for totals, mine in zip(state["totals"], texts):
        words = {w for t in mine for w in [*t.split(), ""]}
        assert sorted(pitman_yor.unpacked(totals, "<u8").tolist()) == sorted(learnt[w] for w in words)
    assert state["sums"][-2:] == [len(learnt), sum(learnt.values())]


def test_packed_numbers():
    rng = np.random.default_rng(5)
    for kind, tops in (("<u4", (1, 2, 256, 257, 1 << 32)), ("<u8", (1, 1 << 40, (1 << 64) - 1))):
        for n in (0, 1, 1000):
            for top in tops:
                x = rng.integers(0, top, n, dtype=np.uint64).astype(kind)
                assert (pitman_yor.unpacked(pitman_yor.packed(x), kind) == x).all()
    x = rng.normal(size=1000).astype("<f4")
    assert (pitman_yor.unpacked(pitman_yor.packed(x), "<f4") == x).all()


def test_stirling_numbers():
    s = np.exp(pitman_yor.stirling(0.5))
    assert np.allclose([s[1, 1], s[2, 1], s[2, 2], s[3, 1], s[3, 2], s[3, 3]], [1, 0.5, 1, 0.75, 1.5, 1])


def test_blocks():
    rng = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 5000):
        for top in (1, 2, 300, 1 << 32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            raw = token_files.segment(ids, [None, 7], np.array([n, 0]))
            back, names, lens = token_files.read_segment(raw)
            assert (back == ids).all() and names == [None, 7] and lens.tolist() == [n, 0]
            if n:
                assert (token_files.read_block(raw, (n - 1) // 512) == ids[(n - 1) // 512 * 512 :]).all()


def id_rows(rows, end):
    lib = library("byte_bpe_50k.json")
    return [(i, np.array([*lib.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for i, t in rows]


def test_token_files(spark, stored, none, real):
    at = 0
    got = {r.doc_id: r for r in queries.op3_token_files(spark, SF).collect()}
    for i, ids in id_rows(real, 0):
        assert tuple(got[i]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = queries.tokenizer("byte_bpe_50k.json")
    rows = sorted(map(tuple, token_files.read(token_files.write(stored, path)).collect()), key=lambda r: r[1])
    assert rows[0][0] is None and [r[1] for r in rows[1:]] == np.cumsum([r[2] for r in rows])[:-1].tolist()
    assert token_files.read(token_files.write(none, path)).count() == 0


def test_packing(spark, stored, none, real):
    rows = queries.op10_packing(spark, SF).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and {r.offset for r in rows} == {0}
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, ids in id_rows(real, 1):
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length & (r.length - 1) == 0 and r.length <= 2048
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    path = queries.tokenizer("byte_bpe_50k.json")
    assert packing.pack(stored, path).select("doc_id").distinct().count() == len(AWKWARD) + 1 and packing.pack(none, path).count() == 0


def test_warc(spark, tmp_path):
    html = ["x" * 200, "x" * 200, "short", "short", None, "é" * 100, "x" * 200, "y" * 100]
    rows = [(i, f"http://Www.B{i % 2}.org:80/P?q#f" if i != 3 else None, h, "own") for i, h in enumerate(html)]
    rows += [(None, "u", "x" * 200, "own"), (None, "u", "z" * 150, "own"), (None, "u", "z" * 150, "own")]
    spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(4).write.parquet(str(tmp_path / "p"))
    runs = warc.write(spark.read.parquet(str(tmp_path / "p")))
    history = warc.merge(runs, ranges=3)
    keys = [(r.key, r.stamp) for r in history.orderBy("part", "at").collect()]
    assert keys == sorted(keys) and len(keys) == len(rows)
    got = warc.read(history).collect()
    of = {r.page_id: r for r in got if r.page_id is not None}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        first = html.index(h) if len(raw) >= 100 else i
        assert (of[i].payload_bytes, of[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (of[i].record_type, of[i].refers_to) == (("response", None) if first == i else ("revisit", first))
    assert sorted((r.record_type, r.payload_bytes, r.refers_to) for r in got if r.page_id is None if r.payload_bytes == 200) == [("revisit", 200, 0)]
    assert sorted(r.record_type for r in got if r.payload_bytes == 150) == ["response", "revisit"]
    empty = spark.read.parquet(str(tmp_path / "p")).where("page_id < -1")
    assert warc.read(warc.merge(warc.write(empty))).count() == 0


def test_loser_tree():
    rng = np.random.default_rng(2)
    for k in range(6):
        runs = [sorted((int(x),) for x in rng.integers(0, 9, rng.integers(0, 6))) for _ in range(k)]
        assert [x for x, _ in warc.LoserTree([iter(r) for r in runs])] == sorted(x for r in runs for x in r)
    assert warc.url_key("https://A.b.org:443/X?Y#z") == "org,b,a)/x?y" and warc.url_key("http://a:x/") == "http://a:x/"


def brute_repeats(texts, size=200):
    seen = Counter(b[k : k + size] for b in texts for k in range(len(b) - size + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        spans = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_suffixes(spark, stored, none, real, tmp_path):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op5_suffix_dedup(spark, SF).collect()}
    assert [got[i] for i, _ in real] == brute_repeats([t.encode() for _, t in real])
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdé "), 900))
    texts = [base[int(a) : int(a) + int(n)] + "".join(rng.choice(list("xyz"), int(n) % 90)) for a, n in zip(rng.integers(0, 700, 40), rng.integers(0, 500, 40))] + ["ab" * 300, "q" * 199, "q" * 200, "q" * 201]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "t"))
    found = suffix_dedup.dedup(spark.read.parquet(str(tmp_path / "t"))).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    assert [tuple(r)[1:] for r in found.orderBy("doc_id").collect()] == brute_repeats([t.encode() for t in texts])
    for bits in (1, 6, 12):  # fingerprints that stand for many strings
        found = suffix_dedup.dedup(spark.read.parquet(str(tmp_path / "t")), bits).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
        assert [tuple(r)[1:] for r in found.orderBy("doc_id").collect()] == brute_repeats([t.encode() for t in texts])
    clean = suffix_dedup.clean(stored)
    assert clean.columns == stored.columns and clean.count() == stored.count() and suffix_dedup.clean(none).count() == 0


def test_entries_in_parts():
    rng = np.random.default_rng(3)
    raw, offsets = rng.integers(97, 100, 5000, dtype=np.uint8), np.array([0, 0, 250, 3333, 3333, 5000])
    windows = lambda found: sorted((d, s + k) for _, _, d, s, n in zip(*(x.tolist() for x in found)) for k in range(n))
    whole = suffix_dedup.entries(raw, offsets)
    for most in (301, 1000, 4999):
        parts = suffix_dedup.entries(raw, offsets, most)
        assert windows(parts) == windows(whole) and (most == 4999 or len(parts[0]) > len(whole[0]))
    assert windows(whole) == [(d, s) for d in range(5) for s in range(offsets[d + 1] - offsets[d] - 199)]


def test_differing_windows():
    rng = np.random.default_rng(8)
    a, n = rng.integers(0, 256, 4000, dtype=np.uint8), np.array([50, 1, 7, 300, 40])
    at = np.array([0, 50, 51, 1200, 2000])
    b = np.concatenate([a[1000:], a[:1000]])
    to = (at + 3000) % 4000
    for changed in ([], [3000], [3255, 500], [int(x) for x in rng.integers(0, 4000, 9)]):
        c = b.copy()
        c[changed] ^= 1
        differ, found = suffix_dedup._differing(a, at, c, to, n)
        want = [[k for k in range(n[i]) if (a[at[i] + k : at[i] + k + 200] != c[to[i] + k : to[i] + k + 200]).any()] for i in range(5)]
        assert {i: x.tolist() for i, x in found} == {i: x for i, x in enumerate(want) if x} and differ.tolist() == [bool(x) for x in want]


def test_multikey_sort():
    rng = np.random.default_rng(6)
    keys = [rng.integers(0, 4, 300) for _ in range(4)]
    order = suffix_dedup.multikey(keys)
    assert sorted(order.tolist()) == list(range(300))
    assert [tuple(k[i] for k in keys) for i in order] == sorted(zip(*keys))


def test_perfect_hash():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 3000):
        digests = rng.integers(0, 256, (n, 32), dtype=np.uint8)
        assert sorted(exact_dedup.PerfectHash.build(digests).slots(digests).tolist()) == list(range(n))


@pytest.mark.parametrize("history", ["doc_id % 2 = 0", "true", "false", "doc_id > 4"])
def test_exact(stored, none, history):
    got = exact_dedup.dedup(stored, F.expr(history)).collect()
    text = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in enumerate(AWKWARD)} | {None: "nullid"}
    size = Counter(text.values())
    size["a"] += 1
    for r in got:
        same = [i for i, t in text.items() if t == text[r.doc_id] and i is not None]
        keep = min(same, key=lambda i: (-len(AWKWARD[i] or ""), i)) if same else None
        assert (r.keep_id, r.group_size) == (keep, size[text[r.doc_id]])
    assert sum(r.kept for r in got) == len(size) and len(got) == len(AWKWARD) + 2
    assert exact_dedup.dedup(none, F.expr(history)).count() == 0


def test_search(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.choice([-1, 1], 64, p=[0.3, 0.7])]) for i in range(400)] + [(400, None), (401, []), (402, [None] * 64), (403, [1.0] * 70), (20, [1.0] * 64)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in hamming.top_k(v, F.col("vec_id") % 20 == 0, k=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.vec_id))
    bits = [(i, [x is not None and x > 0 for x in (e + [0] * 64)[:64]]) for i, e in rows if e is not None]
    q = {i: b for i, b in bits if i % 20 == 0 and i != 20}
    for i, b in q.items():
        best = sorted((sum(x != y for x, y in zip(b, c)), j) for j, c in bits)[:7]
        assert [x[1:] for x in sorted(got[i])] == best
    assert 400 not in got
    assert hamming.top_k(v.where("vec_id < 0"), F.lit(True)).count() == 0


def test_search_of_wide_vectors(spark, tmp_path):
    rng = np.random.default_rng(10)
    rows = [(i, [1.0] * 64 + [float(x) for x in rng.choice([-1, 1], 86)]) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for x in queries.op7_hamming(spark, str(tmp_path)).orderBy("rank").collect():
        got.setdefault(x.query_id, []).append((x.distance, x.vec_id))
    assert got == {i: sorted((sum(x != y for x, y in zip(a, b)), j) for j, b in rows)[:10] for i, a in rows if i % 20 == 0}


def test_classifier(spark, stored, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.predict(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)
    m = quality.train(docs, labels)
    odd = quality.score(stored, m).collect()
    assert len(odd) == len(AWKWARD) + 2 and all(0 <= r.score <= 1 for r in odd)
    assert quality.keep(stored, m, 0.0).count() == len(odd) and quality.keep(none, m).count() == 0
    assert quality.score(stored, quality.train(none, labels)).count() == len(odd)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = quality.Machine(w0=0.3, w=rng.standard_normal(quality.SIZE).astype(np.float32), v=rng.standard_normal((quality.SIZE, quality.FACTORS)).astype(np.float32))
    index, x = np.array([4, 9, 77, 900]), rng.standard_normal(4).astype(np.float32)
    z, _ = m.raw(np.zeros(4, int), index, x, 1)
    pairs = sum(float(m.v[index[i]] @ m.v[index[j]] * x[i] * x[j]) for i in range(4) for j in range(i))
    assert z[0] == pytest.approx(0.3 + float((m.w[index] * x).sum()) + pairs, rel=1e-4)


def brute_near(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = words_of(t or "")
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    names = sorted(sets)
    for a in names:
        for b in names:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in names}


def test_near_copies(spark, stored, none, real, tmp_path):
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(300)]
    rows = list(real)
    for i in range(400):  # one group whose members are linked, nearly linked and not linked
        w = list(base)
        for k in rng.choice(300, int(rng.integers(0, 14)), replace=False):
            w[k] = f"x{rng.integers(0, 40)}"
        rows.append((100_000 + i, " ".join(w)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "n"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.read.parquet(str(tmp_path / "n"))).collect()}
    assert got == brute_near(rows)
    odd = minhash.near_duplicates(stored).collect()
    assert len(odd) == len(AWKWARD) + 2 and {r.component_id for r in odd if r.doc_id in (0, 1, 2)} == {0, 1, 2}
    assert {r.component_id for r in odd if r.doc_id in (4, 5)} == {4} and {r.component_id for r in odd if r.doc_id in (6, 7, 8)} == {6}
    assert minhash.near_duplicates(none).count() == 0
    # of rows that repeat a doc_id all have the component's, one is first
    assert sorted((r.kept, r.first) for r in odd if r.doc_id == 3) == [(True, False), (True, True)]


def test_blocks_of_lists(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng, rows = np.random.default_rng(6), []
    for key, sizes in [(1, [40, 30, 9, 3, 1, 1]), (2, [60, 1]), (3, [2, 1, 1]), (-4, [1] * 25)]:
        comps = [c for c, n in enumerate(sizes) for _ in range(n)]
        rows += [(key, int(cid), comp) for cid, comp in zip(rng.choice(1000, len(comps), replace=False), comps, strict=True)]
    placed = minhash._placed(spark.createDataFrame(rows, "key long, cid long, comp long")).collect()
    groups = {}
    for r in placed:
        groups.setdefault((r.key, r.lo, r.hi), []).append(r)
    met = Counter()
    for (key, lo, hi), members in groups.items():
        for a in members:
            for b in members:
                if a.cid < b.cid and {a.block, b.block} == {lo, hi}:
                    met[key, a.cid, b.cid] += 1
                    assert a.comp != b.comp or sum((k, c) == (key, a.comp) for k, _, c in rows) < 8
    wanted = {(k, a, b) for k, a, c in rows for j, b, d in rows if k == j and a < b and c != d}
    assert wanted <= set(met) and set(met.values()) == {1}
    # a large component costs a row for each block outside it, not for each of its own
    assert sum(r.key == 2 for r in placed) == 60 + 8 + 1


def test_a_missing_side_file_is_an_error(spark, tmp_path):
    import shutil

    text = "".join(np.random.default_rng(2).choice(list("abcdef "), 700))
    spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    folder = suffix_dedup.find(docs)
    shutil.rmtree(folder.removeprefix("file://"))
    rows = suffix_dedup.numbered(docs).select("rid", "doc_id", "text")
    with pytest.raises(Exception, match="No such file"):
        rows.mapInArrow(suffix_dedup.partial(suffix_dedup._remove, folder), "rid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary").collect()


def test_stage_of_near_copies(spark, tmp_path):
    import corpus_pipeline

    rng, rows = np.random.default_rng(4), []
    for g in range(60):  # pairs of 0.81 (four of 200 words changed), then families around 0.8
        w = [f"g{g}w{k}" for k in range(200)]
        rows += [(10 * g, " ".join(w)), (10 * g + 1, " ".join("x" if k in (30, 70, 110, 150) else x for k, x in enumerate(w)))]
        for i in range(2, 8 if g >= 40 else 2):
            changed = set(rng.choice(200, int(rng.integers(2, 8)), replace=False).tolist())
            rows.append((10 * g + i, " ".join(f"y{i}" if k in changed else x for k, x in enumerate(w))))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "n"))
    kept = {r.doc_id for r in corpus_pipeline.apart(spark, spark.read.parquet(str(tmp_path / "n")), SF).collect()}
    assert kept == {i for i, r in root.items() if i == r} and not kept & {10 * g + 1 for g in range(60)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (41, 50), (60, 61)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(31)} | {40: 40, 41: 40, 50: 40, 60: 60, 61: 60}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert compare.differs(queries.queries()[name](spark, SF), queries.oracle_sql()[name], compare.connect(SF)) == ""


def test_the_pipeline_leaves_its_result_only(spark):
    import corpus_pipeline
    from outlinelake.llm.common import scratch
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(scratch(spark, "x").rpartition("/")[0])
    names = lambda: {f.base_name for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True))}
    before = names()
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n.rpartition("-")[0] for n in names() - before] == ["pipeline-packing"]


def test_pipeline(spark):
    import corpus_pipeline

    docs = corpus_pipeline.documents(spark, SF)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialise(stage(spark, docs, SF), "test")
        if name != "packing":
            assert docs.columns == before.columns
            kept[name] = {r.doc_id: r.text or "" for r in docs.collect()}
    every = {r.doc_id: r.text or "" for r in corpus_pipeline.documents(spark, SF).collect()}
    machine = quality.train(corpus_pipeline.documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet").where(~quality.held_out()))
    good = {r.doc_id for r in quality.score(corpus_pipeline.documents(spark, SF), machine).collect() if r.score >= quality.THRESHOLD}
    assert set(kept["quality"]) == good
    groups = {}
    for i, t in sorted(kept["quality"].items(), key=lambda x: (-len(x[1]), x[0])):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), i)
    assert set(kept["exact_dedup"]) == set(groups.values())
    near = brute_near([(i, every[i]) for i in kept["exact_dedup"]], percent=80)
    assert set(kept["near_dedup"]) == {i for i, x in near.items() if x[2]}
    names = sorted(kept["near_dedup"])
    raw = [every[i].encode() for i in names]
    seen = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    for i, b in zip(names, raw):
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        assert kept["suffix_dedup"][i] == bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    lib = library("byte_bpe_50k.json")
    pieces = {}
    for r in docs.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for i, t in kept["suffix_dedup"].items():
        assert [x for _, p in sorted(pieces[i]) for x in p] == [*lib.encode(t, add_special_tokens=False).ids, 1]
