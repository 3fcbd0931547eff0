"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata (operator 8).

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]); the sum-of-squares identity
makes it linear in the features a text has. Features: words as they stand, hashed to BUCKETS, valued by the root of
their count over the text's norm; statistics of the whole text (STATS); the stored length as metadata. Ids, language,
source and labels are no features.

Training takes at most `most` labelled rows (a bounded sample, those lowest by a hash of doc_id; a documented
parameter), so the model's size and the driver's work are bounded. Scoring reads every whole text.

Defined results: null texts count as empty; an empty text has only its bias and statistics, so a finite score. Labels
that are null are left out; of repeated labels of a document the largest counts. With no labels at all, or of one
class only, the score is the share of ones, 0.5 without labels. Texts of any length are scored whole. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, flat, gathered, hashed, sliced, tallied, texts, tidied, words
from .side_files import quoted

BUCKETS, FACTORS, THRESHOLD = 1 << 15, 8, 0.3
STATS = ["upper", "lower", "digits", "spaces", "marks", "symbols", "bars", "bangs", "line_ends", "distinct", "commonest", "word_length", "lone", "long_words", "log_words", "log_stored"]
SIZE = BUCKETS + len(STATS)


def statistics(column: pa.Array, stored: np.ndarray, offsets: np.ndarray, rows: np.ndarray, counts: np.ndarray, word_lens: np.ndarray) -> np.ndarray:
    """(texts, STATS) shares and logarithms, each about 0 to 1."""
    n = len(column)
    count = lambda pattern: pc.count_substring_regex(column, pattern).to_numpy(zero_copy_only=False).astype(float)
    chars = np.maximum(pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(float), 1)
    total = np.diff(offsets)
    each = np.maximum(total, 1)
    owner = np.repeat(np.arange(n), total)
    distinct, top = np.bincount(rows, minlength=n), np.zeros(n)
    np.maximum.at(top, rows, counts)
    letters = np.bincount(owner, weights=word_lens, minlength=n)
    out = [
        count(r"\p{Lu}") / chars, count(r"\p{Ll}") / chars, count(r"[0-9]") / chars, count(r" ") / chars, count(r"[.,;:?'\"-]") / chars,
        count(r"[#$%&*@^~=+<>\\/{}\[\]_]") / chars, count(r"\|") / chars * 4, count(r"!") / chars * 4, count(r"\n") / chars * 8,
        distinct / each, top / each, letters / each / 16, np.bincount(owner, weights=word_lens == 1, minlength=n) / each,
        np.bincount(owner, weights=word_lens > 20, minlength=n) / each, np.log1p(total) / 12, np.log1p(stored) / 14,
    ]
    return np.stack(out, axis=1).astype(np.float32)


def features(column: pa.Array, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: row and bucket and value of each hashed word, and the statistics."""
    column = column.cast(pa.large_string())
    offsets, codes, dictionary = words(column, lower=False)
    rows, code, counts = tallied(offsets, codes, len(dictionary))
    lens = pc.utf8_length(dictionary).to_numpy(zero_copy_only=False).astype(float)
    buckets = (hashed(dictionary) >> np.uint64(49)).astype(np.int64)
    stats = statistics(column, stored, offsets, rows, counts, lens[codes])
    values = np.sqrt(counts.astype(np.float32))
    norm = np.sqrt(np.bincount(rows, weights=counts, minlength=len(column)))
    return rows, buckets[code], (values / np.maximum(norm, 1)[rows]).astype(np.float32), stats


class Machine:
    """A factorisation machine: w0, w (SIZE), v (SIZE, FACTORS), and the statistics' means and spreads."""

    def __init__(self, w0: float = 0.0, w: np.ndarray | None = None, v: np.ndarray | None = None, mean: np.ndarray | None = None, spread: np.ndarray | None = None):
        rng = np.random.default_rng(8)
        self.w0 = w0
        self.w = np.zeros(SIZE, np.float32) if w is None else w
        self.v = (rng.standard_normal((SIZE, FACTORS)) * 0.05).astype(np.float32) if v is None else v
        self.mean = np.zeros(len(STATS), np.float32) if mean is None else mean
        self.spread = np.ones(len(STATS), np.float32) if spread is None else spread

    def joined(self, rows: np.ndarray, index: np.ndarray, values: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and scaled statistics as one sparse list, sorted by row."""
        n = len(stats)
        scaled = np.clip((stats - self.mean) / self.spread, -4, 4).astype(np.float32)
        rows = np.concatenate([rows, np.repeat(np.arange(n), len(STATS))])
        order = np.argsort(rows, kind="stable")
        return rows[order], np.concatenate([index, np.tile(np.arange(BUCKETS, SIZE), n)])[order], np.concatenate([values, scaled.reshape(-1)])[order]

    def raw(self, rows: np.ndarray, index: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid and sum_i v_if x_i; every row has features."""
        starts = np.searchsorted(rows, np.arange(n))
        vx = self.v[index] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * ((sums * sums).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
        return self.w0 + np.add.reduceat(self.w[index] * x, starts) + pairs, sums

    def score(self, rows: np.ndarray, index: np.ndarray, values: np.ndarray, stats: np.ndarray) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        z, _ = self.raw(*self.joined(rows, index, values, stats), len(stats))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def fit(self, texts_: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, y: np.ndarray, epochs: int, rate: float, decay: float) -> Machine:
        """Adagrad on the logistic loss over mini-batches, in a fixed random order."""
        share = float(y.mean()) if len(y) else 0.5
        if share in (0.0, 1.0) or not len(y):
            self.w0, self.w[:], self.v[:] = float(np.log((share + 1e-6) / (1 - share + 1e-6))), 0, 0
            return self
        self.mean, self.spread = stats.mean(axis=0), stats.std(axis=0) + np.float32(0.01)
        self.w0 = float(np.log(share / (1 - share)))
        g0, gw, gv = 1e-2, np.full(SIZE, 1e-2, np.float32), np.full((SIZE, FACTORS), 1e-2, np.float32)
        rng, step = np.random.default_rng(17), 128
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), step):
                mine = order[at : at + step]
                lens = [len(texts_[i][0]) for i in mine]
                rows, index, x = self.joined(np.repeat(np.arange(len(mine)), lens), np.concatenate([texts_[i][0] for i in mine]).astype(np.int64), np.concatenate([texts_[i][1] for i in mine]), stats[mine])
                z, sums = self.raw(rows, index, x, len(mine))
                d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[mine]) / len(mine)).astype(np.float32)
                used, back = np.unique(index, return_inverse=True)
                dx = d[rows] * x
                dw = np.bincount(back, weights=dx, minlength=len(used)).astype(np.float32) + decay * self.w[used]
                full = dx[:, None] * (sums[rows] - self.v[index] * x[:, None])
                dv = np.stack([np.bincount(back, weights=full[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1).astype(np.float32) + decay * self.v[used]
                g0 += float(d.sum()) ** 2
                self.w0 -= rate * float(d.sum()) / g0**0.5
                gw[used] += dw * dw
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                gv[used] += dv * dv
                self.v[used] -= rate * dv / np.sqrt(gv[used])
        return self


def _stored(t: pa.Table) -> np.ndarray:
    return np.maximum(pc.fill_null(t["n_chars"], 0).to_numpy().astype(float), 0)


@tidied
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in gathered(batches, limit=3 << 20):
        rows, index, values, stats = features(flat(t["text"]), _stored(t))
        ends = pa.array(np.searchsorted(rows, np.arange(len(stats) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(index, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(values, pa.float32()))]
        yield pa.RecordBatch.from_arrays([flat(t["quality"]), *lists, pa.array(stats.tolist(), pa.list_(pa.float32()))], ["quality", "index", "x", "stats"])


def train(docs: DataFrame, labels: DataFrame, most: int = 8_000, epochs: int = 6, rate: float = 0.15, decay: float = 1e-6) -> Machine:
    """A machine fitted to `labels` (doc_id, quality) of documents: at most `most` of them."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.max("quality") > 0).cast("int").alias("quality"))
    sample = F.broadcast(known.orderBy(F.xxhash64("label_id"), "label_id").limit(most))  # at most `most` rows of 12 bytes
    got = _with_length(bounded(docs)).join(sample, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "n_chars", "quality")
    rows = got.mapInArrow(_features, "quality int, index array<int>, x array<float>, stats array<float>").toArrow()
    y = rows["quality"].to_numpy().astype(np.float32) if rows.num_rows else np.zeros(0, np.float32)
    stats = np.array(rows["stats"].to_pylist(), np.float32).reshape(-1, len(STATS))
    lists = [(np.asarray(a.values), np.asarray(b.values)) for a, b in zip(rows["index"], rows["x"], strict=True)]
    # the same order however the rows came, as far as they differ
    order = np.lexsort([*stats.T, [len(a) for a, _ in lists], y]) if len(y) else np.zeros(0, int)
    return Machine().fit([lists[i] for i in order], stats[order], y[order], epochs, rate, decay)


def _with_length(docs: DataFrame) -> DataFrame:
    return texts(docs, (F.col("n_chars") if "n_chars" in docs.columns else F.lit(0)).cast("long").alias("n_chars"))


@tidied
def _score(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = Machine(*model.value)
    for t in gathered(batches, limit=3 << 20):
        scores = machine.score(*features(flat(t["text"]), _stored(t)))
        yield pa.RecordBatch.from_arrays([flat(t[c]) for c in t.column_names if c not in ("text", "n_chars")] + [pa.array(scores, pa.float64())], [c for c in t.column_names if c not in ("text", "n_chars")] + ["score"])


def score(docs: DataFrame, machine: Machine, *more: str) -> DataFrame:
    """doc_id, the columns named, and score of every document."""
    rows = texts(bounded(docs), *more, *([] if "n_chars" in more else [(F.col("n_chars") if "n_chars" in docs.columns else F.lit(0)).cast("long").alias("n_chars")]))
    model = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v, machine.mean, machine.spread))  # about 1.2 MB, whatever the input
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("text", "n_chars")) + ", score double"
    return rows.mapInArrow(partial(_score, model), schema)


def held_out() -> Column:
    """The fold whose labels are not learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learnt from labels outside the held-out fold."""
    machine = train(docs, labels.where(~held_out()))
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@tidied
def _keep(model, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = Machine(*model.value)
    for b in sliced(batches, limit=3 << 20):
        stored = pc.fill_null(b.column("n_chars"), 0).to_numpy(zero_copy_only=False).astype(float)
        good = machine.score(*features(b.column("text"), np.maximum(stored, 0))) >= least if b.num_rows else []
        yield b.select(["row"]).filter(pa.array(good, pa.bool_()))


def keep(docs: DataFrame, machine: Machine, least: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is `least` at least, with all their columns, whatever their names."""
    model = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v, machine.mean, machine.spread))  # about 1.2 MB
    n_chars = (F.col("n_chars") if "n_chars" in docs.columns else F.lit(0)).cast("long").alias("n_chars")
    rows = bounded(docs).select(F.coalesce("text", F.lit("")).alias("text"), n_chars, F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"))
    return rows.mapInArrow(partial(_keep, model, least), rows.select("row").schema).select("row.*")
