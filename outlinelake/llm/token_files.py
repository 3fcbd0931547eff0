"""Token ids as binary files of patched frame-of-reference blocks (operator 3).

Documents are range-partitioned and sorted by doc_id; each task encodes its documents and writes segments of whole
documents. In a segment the ids are cut into blocks of BLOCK; of each block the minimum is subtracted, the rest is
packed at the bit width that holds the PERCENTILE of its values, and larger values go to the block's exception list
(positions and values). An index has every block's start, so any block can be read alone.

Segment file: payload of all blocks | block index | document index | JSON footer | footer length (u32) | MAGIC.
Files get their name by a move after they are complete, and only files of committed tasks are in the manifest, so a
task that runs again leaves nothing half-written to be read.

Defined results: null and empty texts have the end id only. Null doc_ids sort first; rows with equal doc_id are
in input order. Extra columns are ignored. An empty table gives no documents. A document is never split over
segments, whatever its length.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import encoder
from .common import bounded, flat, gathered, materialise, scan_parts, scratch, texts, tidied
from .side_files import get, put

BLOCK, PERCENTILE, SEGMENT_IDS, MAGIC = 512, 95, 4 << 20, b"PFORSEG1"
#: Blocks that are packed or unpacked at once, which bounds the memory that takes.
RUN = 1_024
#: Files that a reading task opens, one after the other.
SEGMENTS = 4
INDEX = np.dtype([("start", "<u8"), ("min", "<u4"), ("width", "u1"), ("exceptions", "<u2")])


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values below 2**width as (blocks, BLOCK * width / 64) words."""
    g = np.ascontiguousarray(values.reshape(-1, 64).T.astype(np.uint64))
    out = np.zeros((width, g.shape[1]), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[word] |= g[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= g[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(len(values), -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of pack()."""
    g = np.ascontiguousarray(words.reshape(-1, width).T)
    out, mask = np.empty((64, g.shape[1]), np.uint32), np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        x = g[word] >> np.uint64(shift)
        if shift + width > 64:
            x |= g[word + 1] << np.uint64(64 - shift)
        out[j] = x & mask
    return np.ascontiguousarray(out.T).reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload and block index of uint32 ids; the last block is filled up with its first id."""
    payloads, indexes, start = [b""], [np.zeros(0, INDEX)], 0
    for at in range(0, len(ids), RUN * BLOCK):
        payload, index = _encode_run(ids[at : at + RUN * BLOCK])
        index["start"] += start
        start += len(payload)
        payloads.append(payload)
        indexes.append(index)
    return b"".join(payloads), np.concatenate(indexes)


def _encode_run(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[(n - 1) * BLOCK]
    rows = full.reshape(n, BLOCK)
    low = rows.min(axis=1)
    rows = rows - low[:, None]
    typical = np.partition(rows, (BLOCK * PERCENTILE) // 100, axis=1)[:, (BLOCK * PERCENTILE) // 100].astype(np.uint64)
    width = np.where(typical > 0, np.floor(np.log2(np.maximum(typical, 1))).astype(np.int64) + 1, 0)
    over = rows.astype(np.uint64) >> width[:, None].astype(np.uint64) != 0
    count = over.sum(axis=1)
    sizes = BLOCK // 8 * width + 6 * count
    index = np.zeros(n, INDEX)
    index["start"], index["min"], index["width"], index["exceptions"] = np.cumsum(sizes) - sizes, low, width, count
    parts: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        bits = pack(np.where(over[mine], 0, rows[mine]), w).astype("<u8") if w else np.zeros((len(mine), 0), "<u8")
        for k, i in enumerate(mine.tolist()):
            at = np.flatnonzero(over[i]) if count[i] else None
            parts[i] = bits[k].tobytes() + (at.astype("<u2").tobytes() + rows[i, at].astype("<u4").tobytes() if at is not None else b"")
    return b"".join(parts), index


def decode_blocks(payload: memoryview, index: np.ndarray, n_ids: int) -> np.ndarray:
    out = np.zeros((len(index), BLOCK), np.uint32)
    for first in range(0, len(index), RUN):
        rows = index[first : first + RUN]
        for w in np.unique(rows["width"]).tolist():
            mine = np.flatnonzero(rows["width"] == w)
            if w:
                size, starts = BLOCK // 8 * w, rows["start"][mine].tolist()
                out[first + mine] = unpack(np.frombuffer(b"".join([payload[a : a + size] for a in starts]), "<u8").reshape(len(mine), -1), w)
    for i in np.flatnonzero(index["exceptions"]).tolist():
        n, at = int(index["exceptions"][i]), int(index["start"][i]) + BLOCK // 8 * int(index["width"][i])
        out[i, np.frombuffer(payload[at : at + 2 * n], "<u2")] = np.frombuffer(payload[at + 2 * n : at + 6 * n], "<u4")
    out += index["min"][:, None]
    return out.reshape(-1)[:n_ids]


def segment(ids: np.ndarray, doc_ids: list[int | None], lens: np.ndarray) -> bytes:
    payload, index = encode_blocks(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + lens.astype("<i8").tobytes()
    footer = json.dumps({"ids": len(ids), "block": BLOCK, "blocks": len(index), "docs": len(doc_ids), "payload": len(payload)}).encode()
    return b"".join([payload, index.tobytes(), docs, footer, struct.pack("<I", len(footer)), MAGIC])


def read_segment(raw: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """Ids, doc_ids and lengths of a segment file."""
    if raw[-8:] != MAGIC:
        raise ValueError("not a complete segment file")
    view = memoryview(raw)
    (size,) = struct.unpack("<I", view[-12:-8])
    f = json.loads(bytes(view[-12 - size : -12]))
    at = f["payload"]
    index = np.frombuffer(view[at : at + f["blocks"] * INDEX.itemsize], INDEX)
    at += index.nbytes
    n = f["docs"]
    known = np.frombuffer(view[at : at + n], np.uint8)
    docs, lens = (np.frombuffer(view[at + n + 8 * n * k : at + n + 8 * n * (k + 1)], "<i8") for k in (0, 1))
    return decode_blocks(view[: f["payload"]], index, f["ids"]), [d if k else None for d, k in zip(docs.tolist(), known, strict=True)], lens


def read_block(raw: bytes, k: int) -> np.ndarray:
    """Block k alone, found by the index of block starts."""
    view = memoryview(raw)
    (size,) = struct.unpack("<I", view[-12:-8])
    f = json.loads(bytes(view[-12 - size : -12]))
    index = np.frombuffer(view[f["payload"] : f["payload"] + f["blocks"] * INDEX.itemsize], INDEX)
    return decode_blocks(view[: f["payload"]], index[k : k + 1], min(BLOCK, f["ids"] - k * BLOCK))


@tidied
def _write(tokenizer: str, folder: str, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    e, task = encoder(tokenizer), TaskContext.get()
    held, docs, lens, total, k = [], [], [], 0, 0

    def close():
        nonlocal held, docs, lens, total, k
        uri = put(folder, f"{task.partitionId():06d}-{k:05d}-{uuid.uuid4().hex[:8]}.pfor", segment(np.concatenate(held), docs, np.concatenate(lens)))
        row = pa.RecordBatch.from_pydict({"part": [task.partitionId()], "segment": [k], "uri": [uri], "n_docs": [len(docs)], "n_ids": [total]}, schema=MANIFEST)
        held, docs, lens, total, k = [], [], [], 0, k + 1
        return row

    for t in gathered(batches, limit=1 << 20):
        starts, ids = e.encode(flat(t["text"]))
        n = np.diff(starts)
        ended = np.insert(ids, starts[1:], np.uint32(end))
        held.append(ended)
        docs += t["doc_id"].to_pylist()
        lens.append(n + 1)
        total += len(ended)
        if total >= SEGMENT_IDS:
            yield close()
    if docs:
        yield close()


MANIFEST = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """Encode and write all documents in ascending doc_id order; the manifest of files: part, segment, uri, n_docs, n_ids."""
    rows = texts(bounded(docs), F.monotonically_increasing_id().alias("rid"))
    n, folder = scan_parts(rows), scratch(docs.sparkSession, "token-files")
    # the row number splits a doc_id of many rows, and null, over ranges
    ordered = rows.repartitionByRange(n, "doc_id", "rid").sortWithinPartitions("doc_id", "rid")
    return materialise(ordered.mapInArrow(partial(_write, tokenizer, folder, end), "part int, segment int, uri string, n_docs long, n_ids long"), "token-manifest")


@tidied
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri, base in zip(b.column("uri").to_pylist(), b.column("start").to_pylist(), strict=True):
            ids, docs, lens = read_segment(get(uri))
            raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lens)
            starts = ends - lens
            sums = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base + starts, pa.int64()), pa.array(lens, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    # sums over the parts, one row a part, and over the segments inside each
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids")).withColumn("base", F.coalesce(F.sum("ids").over(before("part")), F.lit(0)))
    inside = manifest.withColumn("inside", F.coalesce(F.sum("n_ids").over(before("part", "segment")), F.lit(0)))
    files = inside.join(parts.select("part", "base"), "part").select("uri", (F.col("base") + F.col("inside")).cast("long").alias("start"))
    return files.repartition(max(1, -(-manifest.count() // SEGMENTS))).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
