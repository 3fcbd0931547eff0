"""Exact top-k search over binary codes by incremental multi-index hashing (operator 7).

A vector's code has a bit for each element, set where the element is above 0. Index rows are dealt into shards of
bounded size, each one file in the shared folder. Queries meet every shard in blocks. In a shard the code is cut into
segments of SEGMENT bits with a table each; a query probes segment after segment at radius 0, then 1, and so on. After
segment s at radius r every code within m * r + s (m segments, s from 0) has been seen, so the search ends when the
k-th verified distance is no larger. Shards' results are merged by distance and id.

Defined results: null vectors have no code: they are in no result and, as queries, have none. Null elements count as
0; elements after the first `bits` are ignored (width() is that of all) and missing ones count as 0. A query finds itself too. Ties go to the
smallest id; fewer than k codes give fewer rows. Repeated rows are found as often as they are there. Null ids are left
out. Extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, scan_parts, scratch, spread, tidied
from .side_files import get, put

SEGMENT, SHARD, BLOCK = 16, 1 << 16, 256


def width(vectors: DataFrame) -> int:
    """Elements of the longest vector."""
    return max(1, vectors.agg(F.max(F.size("embedding"))).first()[0] or 0)


def code(vector: Column, bits: int = 64) -> Column:
    """Signs of the first `bits` elements, 64 a long; null for null vectors."""
    return F.when(vector.isNotNull(), F.array(*(_long(F.slice(vector, at + 1, min(64, bits - at))) for at in range(0, bits, 64))))


def _long(vector: Column) -> Column:
    signs = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(signs, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _shard(folder: str, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    ids, codes = rows["id"].to_numpy("<i8"), np.stack(rows["code"].to_list()).astype("<i8")
    order = np.lexsort([*codes.T[::-1], ids])
    uri = put(folder, f"{key[0]}.codes", ids[order].tobytes() + codes[order].tobytes())
    return pd.DataFrame({"shard": [key[0]], "uri": [uri]})


@lru_cache(maxsize=1)
def masks() -> list[np.ndarray]:
    """Of each radius the SEGMENT-bit values with so many bits set."""
    values = np.arange(1 << SEGMENT)
    ones = np.bitwise_count(values.astype(np.uint32))
    return [values[ones == r] for r in range(SEGMENT + 1)]


class Index:
    """The segment tables of one shard."""

    def __init__(self, raw: bytes, bits: int):
        longs = -(-bits // 64)
        n = len(raw) // (8 + 8 * longs)
        self.ids, self.codes = np.frombuffer(raw[: 8 * n], "<i8"), np.frombuffer(raw[8 * n :], "<u8").reshape(n, longs)
        self.m = -(-bits // SEGMENT)
        self.tables = []
        for s in range(self.m):
            part = ((self.codes[:, SEGMENT * s // 64] >> np.uint64(SEGMENT * s % 64)) & np.uint64((1 << SEGMENT) - 1)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            self.tables.append((np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << SEGMENT))]), order))

    def search(self, query: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest codes, by distance and id."""
        q, seen = np.array(query, np.int64).view(np.uint64), np.zeros(len(self.codes), bool)
        rows, distances, k = [], [], min(k, len(self.codes))
        within = np.zeros(64 * len(q) + 1, np.int64)
        for r in range(SEGMENT + 1):
            for s, (offsets, order) in enumerate(self.tables):
                probes = masks()[r] ^ int((q[SEGMENT * s // 64] >> np.uint64(SEGMENT * s % 64)) & np.uint64((1 << SEGMENT) - 1))
                found = order[spread(offsets[probes], offsets[probes + 1] - offsets[probes])]
                found = found[~seen[found]]
                seen[found] = True
                d = np.bitwise_count(self.codes[found] ^ q).sum(axis=1, dtype=np.int64)
                rows.append(found)
                distances.append(d)
                within += np.bincount(d, minlength=len(within))
                if within[: self.m * r + s + 1].sum() >= k:
                    row, d = np.concatenate(rows), np.concatenate(distances)
                    best = np.lexsort([self.ids[row], d])[:k]
                    return self.ids[row[best]], d[best]
        raise AssertionError("all codes are within the last radius")


@tidied
def _search(k: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uri, index = None, None
    for b in batches:
        out: list[tuple] = []
        for to, query, q in zip(*(b.column(c).to_pylist() for c in ("uri", "query", "query_code")), strict=True):
            if to != uri:
                uri, index = to, Index(get(to), bits)
            ids, d = index.search(q, k)
            out += zip([query] * len(ids), ids.tolist(), d.tolist(), strict=True)
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["query", "id", "distance"])


def top_k(vectors: DataFrame, queries: Column, k: int = 10, bits: int = 64) -> DataFrame:
    """query_id, rank, vec_id, distance: of rows where `queries` is true the k nearest of all rows. vectors: vec_id, embedding."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), code(F.col("embedding"), bits).alias("code"), F.coalesce(queries, F.lit(False)).alias("asked")).where("id is not null and code is not null")
    rows = materialise(rows, "codes")
    shards = max(1, -(-rows.count() // (SHARD // 2)))
    dealt = rows.select("id", "code", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
    folder = scratch(spark, "code-shards")
    files = materialise(dealt.groupBy("shard").applyInPandas(partial(_shard, folder), "shard long, uri string"), "code-index")
    asked = rows.where("asked").select(F.col("id").alias("query"), F.col("code").alias("query_code")).distinct()
    pairs = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).join(files, "shard")
    blocks = max(1, -(-asked.count() // BLOCK))
    met = pairs.repartition(max(scan_parts(rows), shards * blocks), "shard", F.pmod(F.xxhash64("query"), F.lit(blocks))).sortWithinPartitions("uri", "query")
    found = met.select("uri", "query", "query_code").mapInArrow(partial(_search, k, bits), "query long, id long, distance long")
    # each task cuts its own rows to k a query before they are shuffled, so a query has k rows a task and not k a shard
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id")).cast("long")
    best = found.select(F.col("query").alias("query_id"), rank.alias("rank"), F.col("id").alias("vec_id"), "distance").where(F.col("rank") <= k)
    best = materialise(best, "nearest")
    discard(rows, files, folder)
    return best
