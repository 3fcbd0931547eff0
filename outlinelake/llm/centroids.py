"""Centroid clustering in exact integers (operator 12).

Vectors become integers floor(scale * x). Squared distances are |x|^2 - 2 x.c + |c|^2 of whole blocks, by BLAS in
float64, for every vector whose bound says that no term or sum of that leaves 2^53, so all of it is exact; the other
vectors are compared in integers, of 64 bits where these hold them and of any size beyond. Blocks of vectors are stored
once in the shared folder; a round is one treeAggregate over them, of each cluster's count, sums and inertia, so what
reaches the driver is k rows, however many vectors there are.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left out. Of
vectors that repeat an id each counts, and the smaller vector comes first as a start; a null id is kept and comes last.
With fewer vectors than k there are as many centroids as vectors, without vectors no rows. A distance or inertia
beyond 64 bits is null. Extra columns are ignored. A vector's work is the same wherever it lies, so there are no hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, tidied

#: Vectors of a block, and the largest integers that float64 and int64 hold.
ROWS, EXACT, LONG = 2048, 1 << 53, (1 << 63) - 1


def kept(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, x (doubles) of the vectors that have `dim` components, all finite."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return vectors.where((F.size("embedding") == dim) & fine).select(F.col("vec_id").cast("long"), x.alias("x"))


@tidied
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and components (little-endian doubles) of up to ROWS vectors a row."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id"))
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype("<f8")
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], ["ids", "x"])


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: int64 where that holds all of it, else Python's integers."""
    with np.errstate(over="ignore"):
        f = np.floor(x * scale)
    if not f.size or np.abs(f).max() < 1 << 62:
        return f.astype(np.int64)
    whole = [int(v) if np.isfinite(v) else int(u) * scale for u, v in zip(x.ravel().tolist(), f.ravel().tolist(), strict=True)]
    return np.array(whole, object).reshape(x.shape)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of integer vectors the number of the nearest centroid (the smaller of equals) and the squared distance to it."""
    n, dim = x.shape
    most = int(np.abs(c).max())
    labels, distances = np.zeros(n, np.int64), np.zeros(n, np.int64)
    size = np.abs(x).max(axis=1)

    def within(limit: int) -> np.ndarray:
        """Vectors with dim * (largest component + largest of a centroid)^2 below the limit."""
        root = 0
        for bit in reversed(range(40)):
            root += (1 << bit) * (dim * (root + (1 << bit)) ** 2 < limit)
        return np.asarray(size <= root - most, bool)

    blas = within(EXACT)
    if blas.any():
        a, b = x[blas].astype(float), c.astype(float)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
        labels[blas] = d.argmin(axis=1)
        distances[blas] = d.min(axis=1).astype(np.int64)
    for rows, kind in ((within(LONG) & ~blas, np.int64), (~within(LONG) & ~blas, object)):
        if rows.any():
            a, b = x[rows].astype(kind), c.astype(kind)
            d = np.stack([((a - v) ** 2).sum(axis=1) for v in b], axis=1)
            labels[rows] = d.argmin(axis=1)
            if kind is object:
                distances = distances.astype(object)
            distances[rows] = d.min(axis=1)
    return labels, distances


@dataclass
class Totals:
    """Of each cluster the number of vectors, the sums of their components and their inertia; most: no sum is larger."""

    counts: np.ndarray
    sums: np.ndarray
    inertia: np.ndarray
    most: int

    def plus(self, other: Totals) -> Totals:
        most = self.most + other.most
        kind = np.int64 if most < LONG else object
        return Totals(self.counts + other.counts, self.sums.astype(kind) + other.sums.astype(kind), self.inertia + other.inertia, most)


def totals(x: np.ndarray, c: np.ndarray) -> Totals:
    """What one block adds."""
    labels, distances = nearest(x, c)
    own = labels == np.arange(len(c))[:, None]
    most = len(x) * int(np.abs(x).max())
    kind = float if most < EXACT else np.int64 if most < LONG else object
    sums = own.astype(kind) @ x.astype(kind)
    inertia = np.array([sum(distances[rows].tolist()) for rows in own], object)
    return Totals(own.sum(axis=1), sums.astype(np.int64) if kind is float else sums, inertia, most)


def centroid_means(c: np.ndarray, t: Totals) -> np.ndarray:
    """The floors of the clusters' means; a centroid without vectors stays."""
    rows = [[int(s) // int(n) for s in sums] if n else list(old) for old, sums, n in zip(c.tolist(), t.sums, t.counts.tolist(), strict=True)]
    big = max(abs(v) for r in rows for v in r) >= 1 << 62
    return np.array(rows, object if big else np.int64)


@tidied
def _assign(c: np.ndarray, inertia: list[int], dim: int, scale: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = lambda v: v if v <= LONG else None
    per, texts = pa.array([held(v) for v in inertia], pa.int64()), pa.array([",".join(map(str, v)) for v in c.tolist()])
    every = held(sum(inertia))
    for b in batches:
        for ids, raw in zip(b.column("ids"), b.column("x"), strict=True):
            labels, d = nearest(integers(np.frombuffer(raw.as_py(), "<f8").reshape(-1, dim), scale), c)
            k = pa.array(labels)
            distance = pa.array([held(v) for v in d.tolist()] if d.dtype == object else d, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.values, k.cast(pa.int32()), distance, per.take(k), pa.array([every] * len(d), pa.int64()), texts.take(k)], ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"])


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid string"


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (its integers, joined by commas) of every vector that is kept. Centroids start as the k vectors with the smallest sha256 of `seed:vec_id`; a round assigns all vectors and moves the centroids; after the last round vectors are assigned once more."""
    spark, good = vectors.sparkSession, kept(vectors, dim)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = good.orderBy(rank.asc_nulls_last(), "x").limit(k).select("x").collect()
    if not starts:
        return spark.createDataFrame([], RESULT)
    c = integers(np.array([r.x for r in starts]), scale)
    blocks = materialise(good.mapInArrow(_blocks, "ids array<bigint>, x binary"), "vector-blocks")
    rows = blocks.select("x").rdd.map(lambda r: bytes(r.x))

    def passed(c: np.ndarray) -> Totals:
        none = Totals(np.zeros(len(c), np.int64), np.zeros((len(c), dim), np.int64), np.array([0] * len(c), object), 0)
        return rows.treeAggregate(none, lambda t, raw: t.plus(totals(integers(np.frombuffer(raw, "<f8").reshape(-1, dim), scale), c)), Totals.plus)

    for _ in range(rounds):
        c = centroid_means(c, passed(c))
    inertia = [int(v) for v in passed(c).inertia]
    found = materialise(blocks.mapInArrow(partial(_assign, c, inertia, dim, scale), RESULT), "clusters")
    discard(blocks)
    return found
