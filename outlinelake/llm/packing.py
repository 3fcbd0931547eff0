"""Packing by power-of-two decomposition (operator 10).

A document of n ids is cut into pieces whose lengths are powers of two: as many of the largest length as fit, then
the binary digits of what is left, in falling order. Pieces of one length form a bucket; each piece is a sequence of
its own, so no sequence crosses documents and none needs padding. The pieces are written once, bucket by bucket, with
their ids; sequence_id numbers them densely, bucket after bucket.

Defined results: null and empty texts have the end id only, one piece of length 1. Equal rows give equal pieces under
sequence_ids of their own. Texts of any length are cut whole. Null doc_ids stay null. Extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .common import bounded, flat, gathered, materialise, scratch, texts, tidied

LONGEST = 2048
SCHEMA = "doc_id long, start long, length int, doc_tokens long, part int, place long, ids binary"


def lengths(n: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Of documents of n ids: the owner and the length of every piece, in order."""
    bits = longest.bit_length() - 1
    counts = np.empty((len(n), bits + 1), np.int64)
    counts[:, 0] = n // longest
    for k in range(bits):
        counts[:, k + 1] = (n >> (bits - 1 - k)) & 1
    sizes = longest >> np.arange(bits + 1)
    per = counts.reshape(-1)
    return np.repeat(np.repeat(np.arange(len(n)), bits + 1), per), np.repeat(np.tile(sizes, len(n)), per)


@tidied
def _pieces(tokenizer: str, end: int, longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    e, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), {}
    for t in gathered(batches, limit=1 << 20):
        starts, ids = e.encode(flat(t["text"]))
        ids = np.insert(ids, starts[1:], np.uint32(end))
        n = np.diff(starts) + 1
        owner, size = lengths(n, longest)
        ends = np.cumsum(size)
        inside = (ends - size) - (np.cumsum(n) - n)[owner]
        place = np.empty(len(size), np.int64)
        for s in np.unique(size).tolist():
            mine = np.flatnonzero(size == s)
            place[mine] = seen.get(s, 0) + np.arange(len(mine))
            seen[s] = seen.get(s, 0) + len(mine)
        raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((4 * np.concatenate([[0], ends])).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
        columns = [flat(t["doc_id"]).take(pa.array(owner)), pa.array(inside, pa.int64()), pa.array(size, pa.int32()), pa.array(n[owner], pa.int64()), pa.array(np.full(len(size), part), pa.int32()), pa.array(place), raw]
        yield from pa.Table.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "part", "place", "ids"]).to_batches(max_chunksize=20_000)


def pack(docs: DataFrame, tokenizer: str, end: int = 1, longest: int = LONGEST) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian uint32) of every piece."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "packed")
    made = texts(bounded(docs)).mapInArrow(partial(_pieces, tokenizer, end, longest), SCHEMA)
    made.write.partitionBy("length").parquet(path)
    pieces = spark.read.schema(made.schema).parquet(path)
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("length", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("length").alias("b_length"), F.col("part").alias("b_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # stored, so that the join is planned by the size of its files: pieces are shuffled only where that is too much to broadcast
    bases = materialise(bases, "piece-bases")
    joined = pieces.join(bases, (F.col("length") == F.col("b_length")) & (F.col("part") == F.col("b_part")))
    return joined.select("doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", (F.col("base") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
