"""Shared helpers: scratch space on the shared folder, Arrow batch slicing, word splitting."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task holds as one unit of vectorised work, and after which it gives freed memory back.
CHUNK_BYTES = 8 << 20


#: The folders that scratch() has named, in order, for those who clear up after others.
made: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; a local temporary one only where that is unset and all runs on this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints/outlinelake"
    made.append(f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return made[-1]


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def few_shuffle_files(spark: SparkSession):
    """Within it, a job's shuffle files go when the job has ended."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there."""
    path = scratch(df.sparkSession, label)
    with few_shuffle_files(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*stored: DataFrame | str) -> None:
    """Delete what materialise() wrote, or folders, once all that is made of it is stored."""
    for x in stored:
        spark = SparkSession.getActiveSession() if isinstance(x, str) else x.sparkSession
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        for folder in [x] if isinstance(x, str) else {f.rpartition("/")[0] for f in x.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), with further columns named, and no others."""
    return df.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def scan_parts(df: DataFrame) -> int:
    """Partitions the input is read in, a measure of its size in units of maxPartitionBytes."""
    return max(1, df.rdd.getNumPartitions())


def bounded(df: DataFrame, n_bytes: int = 4 << 20) -> DataFrame:
    """df; from now on its session sends rows to Python in batches of n_bytes at most (one row at least). Batches are counted by rows otherwise, and long texts then fill the memory of the JVM and of Python; results that are computed later need the setting too, so it stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.sub(r"\D", "", conf.get(name)) or 0) <= n_bytes or not conf.get(name).isdigit():
        conf.set(name, str(n_bytes))
    return df


def give_back() -> None:
    """Return freed memory that allocators keep to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(task: Callable) -> Callable:
    """A function for mapInArrow that gives the memory it freed back at its end: Python workers live on, so what allocators keep would add to what the next stages need."""

    @wraps(task)
    def run(*args):
        try:
            yield from task(*args)
        finally:
            give_back()

    return run


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches of about `limit` bytes of `column` (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield b.slice(at, to - at)
            at = to


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Like sliced(), but small batches are joined to come near `limit`."""
    held, size, done = [], 0, 0
    for b in sliced(batches, column, limit):
        n = pc.sum(pc.binary_length(b.column(column))).as_py() or 0
        if held and size + n > limit:
            yield pa.Table.from_batches(held).combine_chunks()
            done += size
            held, size = [], 0
            if done > CHUNK_BYTES:
                give_back()
                done = 0
        held.append(b)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
    return column


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start..start+len of every run, one run after the other."""
    lens = lens.astype(np.int64)
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts.astype(np.int64) - (ends - lens), lens) + np.arange(total, dtype=np.int64)


def coded(lists: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a list-of-strings array: offsets of each list, dictionary codes of all strings, the dictionary. Empty strings are left out; A-Z are lower-cased if asked."""
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    values = lists.values[int(offsets[0]) : int(offsets[-1])]
    offsets = offsets - offsets[0]
    keep = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    if not keep.all():
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        values = values.filter(pa.array(keep))
    if lower:
        # ascii_lower gives wrong strings for a slice of an array, so it gets one that starts at 0
        values = pc.ascii_lower(values if not values.offset else values.take(pa.array(np.arange(len(values)))))
    d = values.dictionary_encode()
    return offsets, d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words [^\\x20\\x09-\\x0D]+ of each text, A-Z lower-cased if asked: offsets, codes, dictionary."""
    return coded(pc.ascii_split_whitespace(column.cast(pa.large_string())), lower)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PieceIds:
    """Ids of pieces met before; new pieces are given to `encode` at once. An open-addressed table of 64-bit hashes leads to a piece's place, and its bytes are compared before its ids count. At `limit` pieces the half that was used least lately goes."""

    def __init__(self, encode, limit: int = 1_500_000):
        self.encode, self.limit = encode, limit
        self.mask = np.uint64((1 << max(8, (2 * limit).bit_length())) - 1)
        self.now = 0
        self._hold(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _hold(self, hashes, raw, sizes, ids, lens, used) -> None:
        """Hold these pieces only."""
        self.table = np.full(int(self.mask) + 1, -1, np.int32)
        self.n = 0
        self.hashes, self.used = np.zeros(1024, np.uint64), np.zeros(1024, np.int32)
        self.at, self.starts = np.zeros(1025, np.int64), np.zeros(1025, np.int64)
        self.raw, self.ids = np.zeros(1 << 14, np.uint8), np.zeros(1 << 14, np.uint32)
        self._add(hashes, raw, sizes, ids, lens, used)

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros(max(n, len(a) + len(a) // 2), a.dtype)
        out[: len(a)] = a
        return out

    def _add(self, hashes, raw, sizes, ids, lens, used) -> None:
        """Pieces that aren't held: their hashes (all different), bytes, sizes, ids, numbers of ids and last use."""
        n, m = self.n, self.n + len(hashes)
        self.hashes, self.used = self._grown(self.hashes, m), self._grown(self.used, m)
        self.at, self.starts = self._grown(self.at, m + 1), self._grown(self.starts, m + 1)
        self.hashes[n:m], self.used[n:m] = hashes, used
        self.at[n + 1 : m + 1], self.starts[n + 1 : m + 1] = self.at[n] + np.cumsum(sizes), self.starts[n] + np.cumsum(lens)
        self.raw, self.ids = self._grown(self.raw, int(self.at[m])), self._grown(self.ids, int(self.starts[m]))
        self.raw[self.at[n] : self.at[m]], self.ids[self.starts[n] : self.starts[m]] = raw, ids
        self.n = m
        left = np.arange(n, m)
        slot = (hashes & self.mask).astype(np.int64)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & int(self.mask)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it isn't held."""
        out = np.full(len(hashes), -1, np.int64)
        left, slot = np.arange(len(hashes)), (hashes & self.mask).astype(np.int64)
        while len(left):
            place = self.table[slot]
            hit = (place >= 0) & (self.hashes[place] == hashes[left])
            out[left[hit]] = place[hit]
            on = (place >= 0) & ~hit
            left, slot = left[on], (slot[on] + 1) & int(self.mask)
        return out

    def of(self, dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece: where its ids start, how many they are; and the ids."""
        self.now += 1
        raw, offsets = raw_bytes(dictionary)
        sizes, hashes = np.diff(offsets), hashed(dictionary)
        place = self._find(hashes)
        # a hash that stands for other bytes is no hit
        held = np.flatnonzero(place >= 0)
        differ = self.at[place[held] + 1] - self.at[place[held]] != sizes[held]
        place[held[differ]], held = -2, held[~differ]
        for k in range(0, len(held), 50_000):
            some = held[k : k + 50_000]
            wrong = raw[spread(offsets[some], sizes[some])] != self.raw[spread(self.at[place[some]], sizes[some])]
            if wrong.any():
                place[np.unique(np.repeat(some, sizes[some])[wrong])] = -2
        self.used[place[place >= 0]] = self.now
        fresh = np.flatnonzero(place < 0)
        if not len(fresh):
            return self.starts[place], self.starts[place + 1] - self.starts[place], self.ids
        lens, ids = self.encode(dictionary.take(pa.array(fresh)))
        starts = np.cumsum(lens) - lens
        # two new pieces of one hash: the first is held
        own = np.unique(hashes[fresh], return_index=True)[1]
        own = own[place[fresh[own]] == -1]
        new = fresh[own]
        if self.n + len(new) > self.limit:
            kept = np.sort(np.argsort(self.used[: self.n], kind="stable")[self.n - max(0, min(self.n // 2, self.limit - len(new))) :])
            back = np.full(self.n, -1, np.int64)
            back[kept] = np.arange(len(kept))
            known = place >= 0
            gone = known & (back[place] < 0)
            if gone.any():  # pieces of this batch are used now, so only a batch of more than half the limit gets here
                more, sums = self.starts[place[gone]], self.starts[place[gone] + 1] - self.starts[place[gone]]
                lens, ids = np.concatenate([lens, sums]), np.concatenate([ids, self.ids[spread(more, sums)]])
                starts = np.cumsum(lens) - lens
                fresh = np.concatenate([fresh, np.flatnonzero(gone)])
            stay = back >= 0
            sizes_, lens_ = np.diff(self.at[: self.n + 1]), np.diff(self.starts[: self.n + 1])
            raw_, ids_ = self.raw[: self.at[self.n]][np.repeat(stay, sizes_)], self.ids[: self.starts[self.n]][np.repeat(stay, lens_)]
            self._hold(self.hashes[kept], raw_, sizes_[kept], ids_, lens_[kept], self.used[kept])
            place = np.where(known, back[place], -1)
        room = min(len(new), self.limit - self.n)
        new, own = new[:room], own[:room]
        self._add(hashes[new], raw[spread(offsets[new], sizes[new])], sizes[new], ids[spread(starts[own], lens[own])], lens[own], np.full(room, self.now))
        out = np.concatenate([self.ids[: self.starts[self.n]], ids])
        at, n = self.starts[place], self.starts[place + 1] - self.starts[place]
        at[fresh], n[fresh] = self.starts[self.n] + starts, lens
        return at, n, out

    def texts(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of lists of pieces: where each list's ids start (and the end of all), and the ids."""
        offsets, codes, dictionary = coded(lists)
        starts, lens, ids = self.of(dictionary)
        per = lens[codes]
        return np.concatenate([[0], np.cumsum(per)])[offsets].astype(np.int64), ids[spread(starts[codes], per)]


def replaced(starts: np.ndarray, ids: np.ndarray, own: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The same lists of ids, those of the rows in `own` exchanged."""
    if not own:
        return starts, ids
    parts = [own[r] if r in own else ids[starts[r] : starts[r + 1]] for r in range(len(starts) - 1)]
    return np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), np.concatenate(parts)


def numbered(docs: DataFrame) -> DataFrame:
    """docs and a row number `rid`, unique and the same on every reading as long as docs is a scan of stored files, whose order and splits are fixed. Give other inputs to materialise() first."""
    return docs.withColumn("rid", F.monotonically_increasing_id())


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _ODD) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def raw_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings one after the other, and where each starts (and the end of all)."""
    strings = strings.cast(pa.large_binary())
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def hashed(strings: pa.Array, at_once: int = 50_000) -> np.ndarray:
    """A 64-bit hash of each string's bytes."""
    if len(strings) > at_once:
        return np.concatenate([hashed(strings.slice(k, at_once)) for k in range(0, len(strings), at_once)])
    raw, at = raw_bytes(strings)
    lens = np.diff(at)
    inside = np.arange(len(raw)) - np.repeat(at[:-1], lens)
    terms = (raw.astype(np.uint64) + np.uint64(1)) * powers(int(lens.max(initial=0)))[inside]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    return mixed(sums[at[1:]] - sums[at[:-1]] + lens.astype(np.uint64) * _ODD)


def tallied(offsets: np.ndarray, codes: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of codes: list number, code and count of each distinct code in each list."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keys, counts = np.unique(rows * max(1, n_codes) + codes, return_counts=True)
    return keys // max(1, n_codes), keys % max(1, n_codes), counts
