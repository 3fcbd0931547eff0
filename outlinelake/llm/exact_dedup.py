"""Exact deduplication with a minimal perfect hash over historical digests (operator 6).

Digests, lengths and pre-aggregates are made by the JVM. The historical distinct digests are dealt into shards of
bounded size by a hash of the digest; each shard gets a minimal perfect hash (displacements found bucket by
bucket, largest first), whose slots hold the full digest, the winner's locator (code points, doc_id) and the group's
size. The index is a table of shards. Distinct digests of the batch are looked up in their shard: a slot counts only
if its full digest is equal byte for byte. Members join the group of their slot; nonmembers form groups of their own.

A row's decision depends on its digest alone, so rows meet decisions in a join on the digest whose large partitions
Spark may split; a group of copies of any size is counted before it is shuffled.

Defined results: null counts as empty text; all texts of white space are equal to it. Ties in code points go to the
smallest doc_id, null doc_ids last. Texts of any length are hashed whole. Extra columns are ignored; an empty table gives no rows; repeated rows count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, few_shuffle_files, materialise, numbered

SHARD = 32_768
BUCKET = 4


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def digested(docs: DataFrame, history: Column) -> DataFrame:
    """rid, doc_id, digest (32 bytes), points (code points of the original text), old (whether historical) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return numbered(docs).select("rid", F.col("doc_id").cast("long"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), F.char_length(text).cast("long").alias("points"), F.coalesce(history, F.lit(False)).alias("old"))


def winners(rows: DataFrame) -> DataFrame:
    """digest, points, doc_id, rid of each digest's best row (most points, then smallest doc_id, then first row), and n, its rows."""
    best = F.max(F.struct("points", F.col("doc_id").isNotNull().alias("known"), (-F.coalesce("doc_id", F.lit(0))).alias("low"), (-F.col("rid")).alias("first")))
    found = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    return found.select("digest", F.col("best.points").alias("points"), F.expr("if(best.known, -best.low, null)").alias("doc_id"), (-F.col("best.first")).alias("rid"), "n")


def _mix(a: np.ndarray, seed) -> np.ndarray:
    x = a ^ (np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed, np.uint64) + np.uint64(1)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests: n keys to the slots 0..n-1."""

    def __init__(self, n: int, seeds: np.ndarray):
        self.n, self.seeds = n, seeds

    @staticmethod
    def halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
        return words[:, 1].copy(), words[:, 2] ^ words[:, 3]

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        n = len(digests)
        place, key = cls.halves(digests)
        m = max(1, n // BUCKET)
        bucket = (place % np.uint64(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=m)
        starts = np.cumsum(sizes) - sizes
        seeds, taken = np.zeros(m, np.uint32), np.zeros(n, bool)
        for b in np.argsort(-sizes, kind="stable").tolist():
            if not sizes[b]:
                break
            mine = key[order[starts[b] : starts[b] + sizes[b]]]
            first = 0
            while True:
                tried = np.arange(first, first + 64, dtype=np.uint64)
                slots = (_mix(mine[None, :], tried[:, None]) % np.uint64(n)).astype(np.int64)
                free = ~taken[slots].any(axis=1)
                if len(mine) > 1:
                    s = np.sort(slots, axis=1)
                    free &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                hits = np.flatnonzero(free)
                if len(hits):
                    seeds[b] = first + hits[0]
                    taken[slots[hits[0]]] = True
                    break
                first += 64
                if first > 1 << 26:
                    raise ValueError("equal digests can't be told apart")
        return cls(n, seeds)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        place, key = self.halves(digests)
        seeds = self.seeds[(place % np.uint64(len(self.seeds))).astype(np.int64)].astype(np.uint64)
        return (_mix(key, seeds) % np.uint64(max(1, self.n))).astype(np.int64)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)


HELD = {"points": np.int64, "known": np.uint8, "doc_ids": np.int64, "rids": np.int64, "counts": np.int64}


def _build(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(rows["digest"])
    h = PerfectHash.build(digests)
    slot = np.empty(len(rows), np.int64)
    slot[h.slots(digests)] = np.arange(len(rows))
    columns = {"points": rows["points"], "known": rows["doc_id"].notna(), "doc_ids": rows["doc_id"].fillna(0), "rids": rows["rid"], "counts": rows["n"]}
    held = {k: [columns[k].to_numpy()[slot].astype(kind).tobytes()] for k, kind in HELD.items()}
    return pd.DataFrame({"shard": [shard[0]], "n": [len(rows)], "seeds": [h.seeds.tobytes()], "digests": [digests[slot].tobytes()], **held})


INDEX = "shard int, n long, seeds binary, digests binary, points binary, known binary, doc_ids binary, rids binary, counts binary"


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """The index of winners() of historical rows: one row per shard."""
    return history.select("*", shard_of(shards)).groupBy("shard").applyInPandas(_build, INDEX)


def _lookup(batch: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """winners() of the batch in one shard, each with the better of its own row and its slot's row and the sum of both counts where the slot's full digest is equal (member), else as it is."""
    member = np.zeros(len(batch), bool)
    points, rids, counts = (batch[c].to_numpy().copy() for c in ("points", "rid", "n"))
    known, ids = batch["doc_id"].notna().to_numpy().copy(), batch["doc_id"].fillna(0).astype("int64").to_numpy().copy()
    if len(index) and len(batch):
        x = index.iloc[0]
        mine = _matrix(batch["digest"])
        slot = PerfectHash(int(x["n"]), np.frombuffer(x["seeds"], np.uint32)).slots(mine)
        member = (np.frombuffer(x["digests"], np.uint8).reshape(-1, 32)[slot] == mine).all(axis=1)
        held = {k: np.frombuffer(x[k], kind)[slot] for k, kind in HELD.items()}
        counts += np.where(member, held["counts"], 0)
        old = np.stack([held["points"], held["known"].astype(np.int64), -held["doc_ids"], -held["rids"]])
        own = np.stack([points, known.astype(np.int64), -ids, -rids])
        better, open_ = np.zeros(len(batch), bool), member.copy()
        for a, b in zip(old, own, strict=True):
            better |= open_ & (a > b)
            open_ &= a == b
        points, known, ids, rids = np.where(better, held["points"], points), np.where(better, held["known"] > 0, known), np.where(better, held["doc_ids"], ids), np.where(better, held["rids"], rids)
    doc_id = pd.array(ids, "Int64")
    doc_id[~known] = pd.NA
    return pd.DataFrame({"digest": batch["digest"], "member": member, "doc_id": doc_id, "rid": rids, "n": counts})


def lookup(batch: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """digest, member, doc_id, rid, n: winners() of the batch after their look-up."""
    return batch.select("*", shard_of(shards)).groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_lookup, "digest binary, member boolean, doc_id long, rid long, n long")


def dedup(docs: DataFrame, history: Column) -> DataFrame:
    """rid, doc_id, digest, keep_id, group_size, kept of each row (rid: see numbered()). `history` says over which rows the index is built; the others are the batch that is looked up. That choice doesn't change the result."""
    rows = materialise(digested(docs, history), "digests")
    old = materialise(winners(rows.where("old")), "history")
    with few_shuffle_files(docs.sparkSession):
        shards = max(1, -(-old.count() // SHARD))
    index = materialise(build_index(old, shards), "index")
    found = materialise(lookup(winners(rows.where("not old")), index, shards), "found")
    only_old = old.join(found.where("member").select("digest"), "digest", "left_anti")
    decided = materialise(found.select("digest", "doc_id", "rid", "n").unionByName(only_old.select("digest", "doc_id", "rid", "n")), "decided")
    to = decided.select("digest", F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid"), F.col("n").alias("group_size"))
    out = materialise(rows.join(to, "digest").select("rid", "doc_id", "digest", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept")), "exact-duplicates")
    discard(rows, old, index, found, decided)
    return out
