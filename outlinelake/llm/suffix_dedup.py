"""Removal of repeated byte strings by sorting suffixes in ranges (operator 5).

A byte goes if a string of LENGTH bytes that covers it starts anywhere else too. The suffixes that are sorted are
those at anchors: of each window of LENGTH bytes the leftmost smallest GRAM-byte token is its anchor, so equal windows
have equal anchors at equal places, and neighbouring windows with one anchor form one entry (about 1.2 % of all
suffixes). An entry's leading token is its anchor's fingerprint, its second key that of all its bytes.

Entries are dealt by ranges of (leading token, bytes, place) with sampled splitters, each bucket is sorted locally by a
multikey quicksort and neighbours are compared; first and last entries of buckets are compared across boundaries.
Entries with equal bytes are repeated as a whole. Where one leading token stands before different bytes, one entry of
each kind is taken apart into its windows, whose own fingerprints are compared in buckets by value, equal ones
of a batch having become one row before. No group of equal keys has to fit into a bucket: ties of entries are dealt by
place, and a window's value has a row per batch at most.

Fingerprints only propose: each entry and each window has the first one of its group as its twin, and the bytes of both
are compared before anything goes. Twins' bytes travel once to each input partition that asks for them, neighbouring
ones as one span; all other bytes stay. Where a comparison fails, groups are made anew by the bytes of their windows.

What is found is written per input partition to the shared folder and met again by the partition's own scan, so whole
texts are not shuffled. Docs must be a scan of stored files (see numbered()).

Defined results: null counts as empty text; texts under LENGTH bytes are kept whole; repeats inside one text and
overlapping ones count; texts of any length are taken whole; repeated rows repeat each other. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import side_files
from .common import bounded, discard, flat, gathered, materialise, mixed, numbered, powers, raw_bytes, scan_parts, spread, tidied
from .side_files import Side, get, keyed_file, keyed_files, quoted

LENGTH, GRAM = 200, 32
BASE = np.uint64(0x9FB21C651E98DF25)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE = np.uint64((1 << 28) - 1)
ENTRY = pa.schema([("h", pa.int64()), ("cls", pa.int64()), ("rid", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
_tables: list[np.ndarray] = []


def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, n of each at least."""
    if not _tables or len(_tables[0]) < n:
        _tables[:] = [powers(max(n, 1 << 20), BASE), powers(max(n, 1 << 20), INVERSE)]
    return _tables[0], _tables[1]


class Prints:
    """Fingerprints of any byte strings of a buffer."""

    def __init__(self, raw: np.ndarray):
        up, self.down = tables(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.down[:n]


def texts_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each starts (and the end of all)."""
    column = flat(t["text"]).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def entries(raw: np.ndarray, offsets: np.ndarray, most: int = 1 << 26) -> tuple[np.ndarray, ...]:
    """Leading token, bytes' print, text number, start in the text and number of windows of each entry. More than `most` bytes are taken in parts that overlap by a window; an entry that is cut there is one of another kind of bytes, whose windows are compared one by one."""
    if len(raw) > most:
        found = []
        for at in range(0, len(raw), most):
            to = min(at + most + LENGTH - 1, len(raw))
            here = np.clip(offsets, at, to)
            h, cls, doc, start, n = entries(raw[at:to], here - at, most + LENGTH)
            found.append((h, cls, doc, start + here[doc] - offsets[doc], n))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    if len(raw) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    p = Prints(raw)
    grams = mixed(p.every(GRAM))
    low = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    wide, size = LENGTH - GRAM + 1, 1
    while 2 * size <= wide:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
    anchor = (low & PLACE).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    good = np.arange(len(anchor)) + LENGTH <= offsets[doc + 1]
    first = good.copy()
    first[1:] &= ~good[:-1] | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    last = good.copy()
    last[:-1] &= ~good[1:] | first[1:]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    n, a = e - s + 1, anchor[s]
    shape = ((a - s).astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64)
    cls = mixed(p.of(s, e + LENGTH) ^ mixed(shape + np.uint64(1)))
    return grams[a].view(np.int64), cls.view(np.int64), doc[s], s - offsets[doc[s]], n


def cut_to(prints: np.ndarray, bits: int) -> np.ndarray:
    return prints & np.int64((1 << bits) - 1) if bits < 64 else prints


@tidied
def _entries(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in gathered(batches, limit=1 << 19):
        h, cls, doc, start, n = entries(*texts_of(t))
        h, cls = cut_to(h, bits), cut_to(cls, bits)
        rids = t["rid"].to_numpy()[doc]
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(cls), pa.array(rids), pa.array(start, pa.int32()), pa.array(n, pa.int32())], schema=ENTRY)


def multikey(keys: list[np.ndarray]) -> np.ndarray:
    """The order by several keys: a quicksort by the first, and within its ties by the others."""
    order = np.argsort(keys[0])
    if len(keys) == 1 or len(order) < 2:
        return order
    tied = keys[0][order][1:] == keys[0][order][:-1]
    inside = np.concatenate([[False], tied]) | np.concatenate([tied, [False]])
    if inside.any():
        # all runs of ties together, run after run, so that each stays in its place
        run = np.cumsum(~np.concatenate([[False], tied]))[inside]
        rows = order[inside]
        by = multikey([k[rows] for k in keys[1:]])
        order[inside] = rows[by[np.argsort(run[by], kind="stable")]]
    return order


KINDS = "kind int, part int, h long, cls long, rid long, start int, n int, twin_rid long, twin_start int"
PAIR = "rid long, start int, n int, twin_rid long, twin_start int"
FULL, APART, EDGE = 0, 1, 2
#: The twin of what was compared with an equal before.
SURE = -1


@tidied
def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]  # one range of the entries
    if not held:
        return
    t = pa.Table.from_batches(held)
    h, cls, rid, start, n = (t[c].to_numpy() for c in ("h", "cls", "rid", "start", "n"))
    order = multikey([h, cls, n.astype(np.int64), rid, start.astype(np.int64)])
    h, cls, rid, start, n = (x[order] for x in (h, cls, rid, start, n))
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new = new_h | np.concatenate([[True], (cls[1:] != cls[:-1]) | (n[1:] != n[:-1])])
    run, group = np.cumsum(new) - 1, np.cumsum(new_h) - 1
    full = np.bincount(run)[run] > 1
    apart = new & (np.bincount(group[new])[group] > 1)
    twin = np.flatnonzero(new)[run]
    part = TaskContext.get().partitionId()
    for kind, rows in ((FULL, np.flatnonzero(full)), (APART, np.flatnonzero(apart)), (EDGE, np.unique([0, len(h) - 1]))):
        for at in range(0, len(rows), 50_000):
            r = rows[at : at + 50_000]
            columns = [h[r], cls[r], rid[r], start[r], n[r], rid[twin[r]], start[twin[r]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), kind), pa.int32()), pa.array(np.full(len(r), part), pa.int32()), *map(pa.array, columns)], ["kind", "part", "h", "cls", "rid", "start", "n", "twin_rid", "twin_start"])


def sorted_ranges(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of stored entries: those whose keys are repeated, each with its twin, and one of each kind of keys behind a leading token that stands before several; and the table that both read. A range's first entry of a kind is the twin of the range's others, and has that of the first range as its own."""
    ranges = 2 * scan_parts(rows)
    out = materialise(rows.repartitionByRange(ranges, "h", "cls", "n", "rid", "start").mapInArrow(_bucket, KINDS), "buckets")
    edge = out.where(F.col("kind") == EDGE)
    crossing = edge.groupBy("h").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.min(F.struct("cls", "n")).alias("c0"), F.max(F.struct("cls", "n")).alias("c1")).where("p0 < p1 and c0 < c1").select(F.col("h").alias("at_h"))
    same = edge.groupBy("h", "cls", "n").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.min(F.struct("part", "twin_rid", "twin_start")).alias("first")).where("p0 < p1").select(F.col("h").alias("at_h"), F.col("cls").alias("at_cls"), F.col("n").alias("at_n"), "first")
    heads = edge.join(same, (F.col("h") == F.col("at_h")) & (F.col("cls") == F.col("at_cls")) & (F.col("n") == F.col("at_n")))
    heads = heads.select(F.col("twin_rid").alias("rid"), F.col("twin_start").alias("start"), "n", F.col("first.twin_rid").alias("twin_rid"), F.col("first.twin_start").alias("twin_start")).distinct()
    full = out.where(F.col("kind") == FULL).select("rid", "start", "n", "twin_rid", "twin_start").unionAll(heads)
    apart = out.where(F.col("kind") == APART).select("rid", "start", "n").unionAll(edge.join(crossing, F.col("h") == F.col("at_h")).select("rid", "start", "n"))
    return full, apart.distinct(), out


def _runs(t: pa.Table) -> pa.Table:
    """Pairs of spans and their twins, those that go on one from the other made one; sorted by text."""
    rid, start, n, twin, at = (t[c].to_numpy() for c in ("rid", "start", "n", "twin_rid", "twin_start"))
    apart = at.astype(np.int64) - start
    order = np.lexsort((start, apart, twin, rid))
    rid, start, n, twin, apart = rid[order], start[order].astype(np.int64), n[order], twin[order], apart[order]
    new = np.concatenate([[True], (rid[1:] != rid[:-1]) | (twin[1:] != twin[:-1]) | (apart[1:] != apart[:-1])])
    step, lane = np.int64(1 << 33), np.cumsum(new)
    reach = np.maximum.accumulate(start + n + lane * step)
    first = np.flatnonzero(np.concatenate([[True], (start + lane * step)[1:] > reach[:-1]]))
    last = np.concatenate([first[1:], [len(rid)]]) - 1
    size = reach[last] - lane[first] * step - start[first]
    return pa.table({"rid": rid[first], "start": start[first].astype(np.int32), "n": size.astype(np.int32), "twin_rid": twin[first], "twin_start": (start + apart)[first].astype(np.int32)})


def _merged(t: pa.Table) -> pa.Table:
    """Spans of windows sorted by text and start, with those that meet or overlap made one."""
    rid, start, n = (t[c].to_numpy() for c in ("rid", "start", "n"))
    end = start + n - 1 + LENGTH
    step = np.int64(1 << 33)  # no text has so many bytes: the running maximum starts anew with each text
    text = np.cumsum(np.concatenate([[0], (rid[1:] != rid[:-1]).astype(np.int64)]))
    reach = np.maximum.accumulate(end + text * step)
    first = np.concatenate([[True], (start + text * step)[1:] > reach[:-1]])
    at = np.flatnonzero(first)
    last = np.concatenate([at[1:], [len(rid)]]) - 1
    size = reach[last] - text[at] * step - start[at]
    return pa.table({"rid": rid[at], "start": start[at].astype(np.int32), "n": (size - LENGTH + 1).astype(np.int32)})


@tidied
def _windows(folder: str, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    side = Side(folder)
    for t in gathered(batches, limit=1 << 19):
        rids = t["rid"].to_numpy()
        doc, start, n = side.of(rids, "start", "n")
        if len(doc):
            raw, offsets = texts_of(t)
            p = Prints(raw)
            owner = np.repeat(np.arange(len(doc)), n)
            inside = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            at = offsets[doc[owner]] + inside
            w = cut_to(mixed(p.of(at, at + LENGTH)).view(np.int64), bits)
            # windows equal to the first one of their value in the batch are repeated; that one stands for all in the shuffle
            _, first, back = np.unique(w, return_index=True, return_inverse=True)
            twin = first[back]
            known = (twin != np.arange(len(w))) & ~_differing(raw, at, raw, at[twin], np.ones(len(w), np.int64))[0]
            twice = np.zeros(len(w), np.int32)
            twice[twin[known]] = 1
            own, rid = np.flatnonzero(~known), rids[doc[owner]]
            yield from pa.table({"w": w[own], "rid": rid[own], "start": inside[own].astype(np.int32), "n": np.ones(len(own), np.int32), "known": twice[own]}).to_batches(max_chunksize=50_000)
            # the others need no comparison; they go by their place, neighbours as one row
            again = np.flatnonzero(known)
            at, rid, start = at[again], rid[again], inside[again]
            first = np.flatnonzero(np.concatenate([[True], (rid[1:] != rid[:-1]) | (start[1:] != start[:-1] + 1)])) if len(again) else again
            n = np.diff(np.append(first, len(again)))
            yield from pa.table({"w": mixed(at[first].astype(np.uint64)).view(np.int64), "rid": rid[first], "start": start[first].astype(np.int32), "n": n.astype(np.int32), "known": np.full(len(first), 2, np.int32)}).to_batches(max_chunksize=50_000)


@tidied
def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows whose value stands in several rows, each with the first of them, and those known before."""
    held = [b for b in batches if b.num_rows]
    if held:
        w, rid, start, n, known = (pa.Table.from_batches(held)[c].to_numpy() for c in ("w", "rid", "start", "n", "known"))
        own = np.flatnonzero(known < 2)
        order = own[multikey([w[own], rid[own], start[own].astype(np.int64)])]
        new = np.concatenate([[True], w[order][1:] != w[order][:-1]])[: len(order)]
        run = np.cumsum(new) - 1
        several = np.bincount(run)[run] > 1 if len(order) else new
        rows, twin = order[several], order[np.flatnonzero(new)[run]][several] if len(order) else order
        yield from pa.table({"rid": rid[rows], "start": start[rows], "n": n[rows], "twin_rid": rid[twin], "twin_start": start[twin]}).to_batches(max_chunksize=50_000)
        rows = np.flatnonzero(known > 0)
        yield from pa.table({"rid": rid[rows], "start": start[rows], "n": n[rows], "twin_rid": np.full(len(rows), SURE), "twin_start": np.zeros(len(rows), np.int32)}).to_batches(max_chunksize=50_000)


def _spans(raw: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of spans one after the other."""
    return raw[at[0] : at[0] + sizes[0]] if len(at) == 1 else raw[spread(at, sizes)]


def _differing(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Whether spans of n windows at `at` of a and at `to` of b differ in any byte; and of those that do, number and the windows that differ."""
    out, found = np.zeros(len(at), bool), []
    # spans that go on where the one before ended, on both sides, are compared as one
    new = np.concatenate([[True], (at[1:] != at[:-1] + n[:-1]) | (to[1:] != to[:-1] + n[:-1])])[: len(at)]
    first = np.flatnonzero(new)
    total = np.add.reduceat(n, first) if len(first) else first
    sizes = total + LENGTH - 1
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 20))) + 1).tolist(), len(first)]
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        if x == y:
            continue
        wrong = _spans(a, at[first[x:y]], sizes[x:y]) != _spans(b, to[first[x:y]], sizes[x:y])
        if wrong.any():
            ends = np.cumsum(sizes[x:y])
            sums = np.concatenate([[0], np.cumsum(wrong)])
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(wrong), "right")).tolist():
                lo = int(ends[k] - sizes[x + k])
                bad = sums[lo + LENGTH : lo + sizes[x + k] + 1] > sums[lo : lo + total[x + k]]
                inside = np.arange(first[x + k], first[x + k + 1] if x + k + 1 < len(first) else len(at))
                begin = np.cumsum(n[inside]) - n[inside]
                for i, s in zip(inside.tolist(), begin.tolist(), strict=True):
                    here = np.flatnonzero(bad[s : s + n[i]])
                    if len(here):
                        out[i] = True
                        found.append((i, here))
    return out, found


def _asked(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of twins that an input partition has to see."""
    for b in batches:
        for p in b.column("id").to_pylist():
            t = pa.ipc.open_stream(get(f"{folder}/{p}.arrow")).read_all()
            if not t.num_rows:
                continue
            rid, start, n, twin, at = (t[c].to_numpy() for c in ("rid", "start", "n", "twin_rid", "twin_start"))
            far = np.flatnonzero((twin != SURE) & ((twin != rid) | (at != start)))
            far = far[np.lexsort((at[far], twin[far]))]
            if len(far):
                t = _merged(pa.table({"rid": twin[far], "start": at[far], "n": n[far]}))
                yield from t.append_column("to", pa.array(np.full(len(t), p))).to_batches(max_chunksize=50_000)


@tidied
def _cut(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of spans, for the partitions that asked for them."""
    side = Side(folder)
    for t in gathered(batches, limit=1 << 19):
        rids = t["rid"].to_numpy()
        doc, start, n, to = side.of(rids, "start", "n", "to")
        raw, offsets = texts_of(t)
        sizes = n + LENGTH - 1
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 20))) + 1).tolist(), len(doc)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x < y:
                ends = np.concatenate([[0], np.cumsum(sizes[x:y])]).astype(np.int32)
                kept = _spans(raw, offsets[doc[x:y]] + start[x:y], sizes[x:y]).tobytes()
                column = pa.Array.from_buffers(pa.binary(), y - x, [None, pa.py_buffer(ends), pa.py_buffer(kept)])
                yield pa.RecordBatch.from_arrays([pa.array(to[x:y]), pa.array(rids[doc[x:y]]), pa.array(start[x:y], pa.int32()), column], ["p", "rid", "start", "raw"])


class Twins:
    """The bytes of twins that _cut() made for an input partition."""

    def __init__(self, folder: str, p: int):
        t = keyed_file(folder, p)
        if t is None:
            raise FileNotFoundError(f"no bytes of twins for input partition {p}")
        self.raw, self.offsets = raw_bytes(flat(t["raw"]))
        self.rid, self.row = np.unique(t["rid"].to_numpy(), return_inverse=True)
        self.start = t["start"].to_numpy().astype(np.int64)
        self.key = self.row * np.int64(1 << 33) + self.start

    def at(self, rid: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Where in raw the spans start."""
        place = np.minimum(np.searchsorted(self.rid, rid), len(self.rid) - 1)
        k = np.maximum(np.searchsorted(self.key, place * np.int64(1 << 33) + start, "right") - 1, 0)
        out = self.offsets[k] + start - self.start[k]
        if (self.rid[self.row[k]] != rid).any() or (out + n + LENGTH - 1 > self.offsets[k + 1]).any():
            raise RuntimeError("bytes of a twin are missing")
        return out


WRONG = "rid long, start int, twin_rid long, twin_start int"


@tidied
def _compare(pairs: str, bytes_: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that differ from their twins."""
    side, twins, held = Side(pairs), None, None
    for t in gathered(batches, limit=1 << 19):
        rids = t["rid"].to_numpy()
        doc, start, n, twin, at = side.of(rids, "start", "n", "twin_rid", "twin_start")
        far = np.flatnonzero((twin != SURE) & ((twin != rids[doc]) | (at != start)))
        doc, start, n, twin, at = (x[far] for x in (doc, start, n, twin, at))
        if not len(doc):
            continue
        raw, offsets = texts_of(t)
        p = rids[doc] >> 33
        for q in np.unique(p).tolist():
            if held != q:
                twins, held = Twins(bytes_, q), q
            r = np.flatnonzero(p == q)
            _, wrong = _differing(raw, offsets[doc[r]] + start[r], twins.raw, twins.at(twin[r], at[r], n[r]), n[r])
            for i, here in wrong:
                i, size = r[i], len(here)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, rids[doc[i]])), pa.array(start[i] + here, pa.int32()), pa.array(np.full(size, twin[i])), pa.array(at[i] + here, pa.int32())], ["rid", "start", "twin_rid", "twin_start"])


def compared(rows: DataFrame, docs: DataFrame, pairs: DataFrame) -> tuple[str, DataFrame]:
    """Compare the bytes of spans with those of their twins: the folder of the pairs, a file for each input partition, and the stored WRONG windows."""
    spark, parts = docs.sparkSession, scan_parts(rows)
    folder = side_files.write(pairs, docs, "span-files", "start", change=_runs)
    asked = side_files.write(spark.range(0, parts, 1, parts).mapInArrow(partial(_asked, folder), "rid long, start int, n int, to long"), docs, "asked-files", "start")
    met = keyed_files(rows.mapInArrow(partial(_cut, asked), "p long, rid long, start int, raw binary"), ["rid", "start"], "twin-files", parts)
    wrong = materialise(rows.mapInArrow(partial(_compare, folder, met), WRONG), "wrong")
    discard(asked, met)
    return folder, wrong


def by_bytes(rows: DataFrame, docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Of windows (rid, start), those whose bytes another one of them has, by the bytes themselves."""
    folder = side_files.write(windows.select("rid", "start", F.lit(1).alias("n"), F.lit(0).cast("long").alias("to")), docs, "window-files", "start")
    found = materialise(rows.mapInArrow(partial(_cut, folder), "p long, rid long, start int, raw binary"), "window-bytes")
    again = found.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("raw")
    out = materialise(found.join(again, "raw", "left_semi").select("rid", "start", F.lit(1).alias("n"), F.lit(SURE).cast("long").alias("twin_rid"), F.lit(0).alias("twin_start")), "windows")
    discard(folder, found)
    return out


@tidied
def _remove(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    side = Side(folder)
    for t in gathered(batches, limit=1 << 19):
        rids = t["rid"].to_numpy()
        doc, start, n = side.of(rids, "start", "n")
        raw, offsets = texts_of(t)
        mark = np.zeros(len(raw) + 1, np.int32)
        np.add.at(mark, offsets[doc] + start, 1)
        np.add.at(mark, offsets[doc] + start + n - 1 + LENGTH, -1)
        gone = np.cumsum(mark[:-1]) > 0
        removed = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[offsets[:-1][offsets[:-1] < len(raw)]] = gone[offsets[:-1][offsets[:-1] < len(raw)]]
        spans = np.concatenate([[0], np.cumsum(begins)])
        kept = raw[~gone].tobytes()
        ends = offsets - removed[offsets]
        column = pa.Array.from_buffers(pa.binary(), len(rids), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(kept)])
        sizes = [pa.array(np.diff(x), pa.int64()) for x in (offsets, removed[offsets], spans[offsets])]
        yield pa.RecordBatch.from_arrays([flat(t["rid"]), flat(t["doc_id"]), *sizes, column], ["rid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _of_windows(rows: DataFrame, docs: DataFrame, apart: DataFrame, bits: int) -> DataFrame:
    """The pairs of repeated windows of entries, stored."""
    taken = side_files.write(apart, docs, "apart-files", "start")
    windows = rows.mapInArrow(partial(_windows, taken, bits), "w long, rid long, start int, n int, known int")
    out = materialise(windows.repartition(4 * scan_parts(rows), "w").mapInArrow(_repeated, PAIR), "windows")
    discard(taken)
    return out


def find(docs: DataFrame, bits: int = 64) -> str:
    """Write the spans to remove, for each input partition of docs; their folder. bits: those of fingerprints, fewer make more comparisons fail and give the same spans."""
    rows = numbered(bounded(docs)).select("rid", F.coalesce("text", F.lit("")).alias("text"))
    found = materialise(rows.mapInArrow(partial(_entries, bits), "h long, cls long, rid long, start int, n int"), "entries")
    full, apart, buckets = sorted_ranges(found)
    discard(found)
    repeated = _of_windows(rows, docs, apart, bits)
    spans, wrong = compared(rows, docs, full.unionAll(repeated))
    if not wrong.isEmpty():
        # groups of entries that aren't all equal are taken apart, windows of one value that differ are told apart by their bytes
        at = wrong.select(F.col("twin_rid").alias("at_rid"), F.col("twin_start").alias("at_start")).distinct()
        inside = (F.col("twin_rid") == F.col("at_rid")) & F.col("at_start").between(F.col("twin_start"), F.col("twin_start") + F.col("n") - 1)
        mixed_up = full.join(at, inside, "left_semi")
        discard(spans, repeated)
        repeated = _of_windows(rows, docs, apart.unionAll(mixed_up.select("rid", "start", "n")).distinct(), bits)
        full = full.join(at, inside, "left_anti")
        passing, again = compared(rows, docs, repeated)
        twin = again.select("twin_rid", "twin_start").distinct()
        exact = by_bytes(rows, docs, repeated.join(twin, ["twin_rid", "twin_start"], "left_semi").select("rid", "start"))
        good = repeated.join(twin, ["twin_rid", "twin_start"], "left_anti").select(*repeated.columns)
        spans = side_files.write(full.unionAll(good).unionAll(exact).select("rid", "start", "n"), docs, "span-files", "start", change=_merged)
        discard(passing, again, exact)
    discard(buckets, repeated, wrong)
    return spans


def dedup(docs: DataFrame, bits: int = 64) -> DataFrame:
    """rid, doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of each row. bits: see find()."""
    rows = numbered(docs).select("rid", F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_remove, find(docs, bits)), "rid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


@tidied
def _clean(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = pa.Table.from_batches([b])
        plain = t.select(["rid", "text"]).append_column("doc_id", pa.nulls(len(t), pa.int64()))
        kept = [x for out in _remove(folder, iter(plain.to_batches())) for x in out.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()), b.column("row")], ["text", "row"])


def clean(docs: DataFrame) -> DataFrame:
    """docs with the spans removed from text and n_chars as it then is; of a character that a span cuts, the rest goes too."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*(F.col(quoted(c)) for c in docs.columns if c != "text")).alias("row"))
    out = rows.mapInArrow(partial(_clean, find(docs)), rows.select("text", "row").schema)
    now = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long").alias("n_chars")}
    return out.select(*(now.get(c, F.col(f"row.{quoted(c)}")) for c in docs.columns))
