"""Benchmark decontamination by Wu-Manber search for many patterns at once (operator 13).

Symbols are words: A-Z lower-cased, runs of letters, digits and bytes beyond ASCII. Patterns are the windows of `size`
consecutive words of each item, and whole items of fewer words; each length has its own tables. A shift table says for
every hashed block of two words how far it is at least to the next place where a pattern can end, so most positions are
never looked at; where it says 0, a bucket of the suffix hash (over all the pattern's words, so that common endings
don't share one) names the patterns, and their words are compared one by one. Words are numbers of an exact dictionary
of the items' words, so equal numbers are equal words. Texts are scanned in many lanes side by side.

Items are compiled in groups of bounded size, one file of the shared folder each, and every text is searched for each
group in turn: an evaluation set of any size is searched in bounded memory. Texts aren't shuffled. What is found of a
text is bounded by the text and the items that occur in it.

Defined results: null and empty texts, and texts without words, have no hits. A text of any length is searched as a
whole. Items without words (null, empty) never occur; items that repeat a text all count; those that repeat an id count
once. Words of an item with a null id are hit, but it has no name, so it isn't listed or counted. Repeated rows each
have a row. Extra columns are ignored by find() and kept by clean(), whatever their names. An empty table gives no rows,
empty items no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, flat, gathered, materialise, mixed, raw_bytes, spread, tidied
from .side_files import keyed_file, keyed_files, quoted

#: Words of a window and of a block; words of a piece of an item, and of a group of pieces.
SIZE, BLOCK, PIECE, GROUP = 10, 2, 4096, 1 << 20
_LOWER = np.zeros(256, np.uint8)
for _b in range(256):
    _LOWER[_b] = _b + 32 if 65 <= _b <= 90 else _b if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128 else 0


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each text's words start (and the end of all), and the words (bytes)."""
    raw, at = raw_bytes(pc.fill_null(texts, ""))
    low = _LOWER[raw]
    inside = low > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(raw))]  # a text's end ends its words
    first[edge], last[edge - 1] = inside[edge], inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return np.searchsorted(starts, at), pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])])


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mixed(out + c.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out


class Table:
    """Patterns of one length m (distinct rows of word numbers): the shift table and the buckets."""

    def __init__(self, patterns: np.ndarray):
        m = patterns.shape[1]
        self.m, self.block = m, min(BLOCK, m)
        self.bits = np.uint64(64 - max(10, (4 * patterns.size).bit_length()))
        self.shift = np.full(1 << (64 - int(self.bits)), m - self.block + 1, np.int32)
        for end in range(self.block, m + 1):
            np.minimum.at(self.shift, self.slot([patterns[:, j] for j in range(end - self.block, end)]), m - end)
        hashes = _hash(list(patterns.T))
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.patterns = hashes[self.order], patterns[self.order]

    def slot(self, block: list[np.ndarray]) -> np.ndarray:
        return (_hash(block) >> self.bits).astype(np.int64)

    def ends(self, text: np.ndarray, lane: int = 64) -> np.ndarray:
        """Positions where a pattern may end, by the shift table: lanes of the text are scanned side by side."""
        at = np.arange(self.m - 1, len(text), lane)
        to = np.minimum(at + lane, len(text))
        found = []
        while len(at):
            skip = self.shift[self.slot([text[at - j] for j in reversed(range(self.block))])]
            found.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            on = at < to
            at, to = at[on], to[on]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where patterns start in a text of word numbers, and which."""
        all_ends, starts, which = self.ends(text), [], []
        for k in range(0, len(all_ends), 100_000):
            begin = all_ends[k : k + 100_000] - (self.m - 1)
            window = text[begin[:, None] + np.arange(self.m)]
            hashes = _hash(list(window.T))
            p, stop = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
            open_ = np.flatnonzero(p < stop)
            while len(open_):  # one pattern of each bucket at a time, nearly always its only one
                same = (self.patterns[p[open_]] == window[open_]).all(axis=1)
                starts.append(begin[open_[same]])
                which.append(self.order[p[open_[same]]])
                p[open_] += 1
                open_ = open_[~same & (p[open_] < stop[open_])]
        none = [np.zeros(0, np.int64)]
        return np.concatenate(starts or none), np.concatenate(which or none)


class Patterns:
    """A group of items' pieces, compiled. Of each length: its table, and the items of each pattern."""

    def __init__(self, pieces: pa.Table, size: int):
        at, all_words = words(flat(pieces["words"]))
        coded = all_words.dictionary_encode()
        self.vocabulary, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        lens, items = np.diff(at), pieces["item_id"]
        known, names = items.is_valid().to_numpy(), items.fill_null(0).to_numpy()
        self.tables: list[tuple[Table, np.ndarray, np.ndarray]] = []
        for m in np.unique(np.minimum(lens, size)).tolist():
            own = np.flatnonzero(np.minimum(lens, size) == m)
            if not m:
                continue
            per = lens[own] - m + 1
            rows, back = np.unique(codes[spread(at[own], per)[:, None] + np.arange(m)], axis=0, return_inverse=True)
            item = np.repeat(names[own], per)[ok := np.repeat(known[own], per)]
            pairs = np.unique(np.stack([back.ravel()[ok], item]), axis=1)
            self.tables.append((Table(rows), np.searchsorted(pairs[0], np.arange(len(rows) + 1)), pairs[1]))

    def numbers(self, text: pa.Array) -> np.ndarray:
        """The numbers of a text's words, -1 for words of no item."""
        return pc.fill_null(pc.index_in(text, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int32)


@lru_cache(maxsize=1)
def _compiled(folder: str, group: int, size: int) -> Patterns | None:
    pieces = keyed_file(folder, group)
    return Patterns(pieces, size) if pieces else None


def search(texts: pa.Array, folder: str, groups: int, size: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Where each text's words start (and the end of all), which words are hit, and the items that occur, by text."""
    at, text = words(texts)
    # a place between texts that is no word, so that no window reaches over an end
    place = np.arange(len(text)) + np.repeat(np.arange(len(at) - 1), np.diff(at))
    cover, found = np.zeros(len(text) + 1, np.int64), {}
    for g in range(groups):
        if (p := _compiled(folder, g, size)) is None:
            continue
        stream = np.full(len(text) + len(at), -1, np.int32)
        stream[place] = p.numbers(text)
        for table, starts, items in p.tables:
            begin, which = table.search(stream)
            begin = np.searchsorted(place, begin)
            np.add.at(cover, begin, 1)
            np.add.at(cover, begin + table.m, -1)
            pairs = np.unique(np.stack([np.searchsorted(at, begin, "right") - 1, which]), axis=1)
            for cut in np.split(np.arange(pairs.shape[1]), np.flatnonzero(np.diff(pairs[0])) + 1):
                if len(cut):
                    doc, mine = int(pairs[0, cut[0]]), pairs[1, cut]
                    new = items[spread(starts[mine], starts[mine + 1] - starts[mine])]
                    found[doc] = np.unique(np.concatenate([found.get(doc, new[:0]), new]))
    return at, np.cumsum(cover)[:-1] > 0, found


@tidied
def _pieces(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items' words in pieces that overlap by a word less than a window, so each window lies in one."""
    for t in gathered(batches):
        at, found = words(flat(t["text"]))
        for i, name in enumerate(t["item_id"].to_pylist()):
            own = found.slice(at[i], at[i + 1] - at[i])
            for k in range(0, max(min(1, len(own)), len(own) - size + 1), PIECE):
                part = own.slice(k, PIECE + size - 1)
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([name], pa.int64()), "piece": [k // PIECE], "n": [len(part)], "words": [b" ".join(part.to_pylist()).decode()]})


def compiled(items: DataFrame, size: int = SIZE) -> tuple[str, int]:
    """The folder of the groups of items (item_id, text), and how many groups there are."""
    rows = bounded(items).select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = materialise(rows.mapInArrow(partial(_pieces, size), "item_id long, piece long, n long, words string"), "pieces")
    groups = max(1, math.ceil((pieces.agg(F.sum("n")).first()[0] or 0) / GROUP))
    dealt = pieces.select(F.pmod(F.xxhash64("item_id", "piece"), F.lit(groups)).alias("p"), "item_id", "words")
    folder = keyed_files(dealt, ["item_id"], "patterns", groups)
    discard(pieces)
    return folder, groups


FOUND = "doc_id long, n_words long, spans array<struct<start:bigint,length:bigint>>, items array<bigint>"
_KIND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("items", pa.list_(pa.int64()))])


@tidied
def _find(folder: str, groups: int, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in gathered(batches, limit=4 << 20):
        at, hit, found = search(flat(t["text"]), folder, groups, size)
        docs = np.repeat(np.arange(len(at) - 1), np.diff(at))
        begins = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (docs[1:] != docs[:-1])])) if len(hit) else np.zeros(0, np.int64)
        stops = np.flatnonzero(hit & np.concatenate([~hit[1:] | (docs[1:] != docs[:-1]), [True]])) + 1 if len(hit) else begins
        spans = pa.StructArray.from_arrays([pa.array(begins - at[docs[begins]]), pa.array(stops - begins)], ["start", "length"])
        offsets = pa.array(np.searchsorted(begins, at), pa.int32())
        items = pa.array([found.get(i, ()) for i in range(len(at) - 1)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([flat(t["doc_id"]), pa.array(np.diff(at)), pa.ListArray.from_arrays(offsets, spans), items], schema=_KIND)


def find(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, spans (first word and length of each maximal run of hit words), items (ids of those that occur, ascending) of every text. items: item_id, text."""
    folder, groups = compiled(items, size)
    rows = bounded(docs).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    found = materialise(rows.mapInArrow(partial(_find, folder, groups, size), FOUND), "hits")
    discard(folder)
    return found


@tidied
def _clean(folder: str, groups: int, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in gathered(batches, limit=4 << 20):
        at, hit, _ = search(flat(t["text"]), folder, groups, size)
        sums = np.concatenate([[0], np.cumsum(hit)])
        yield from t.select(["row"]).filter(pa.array(sums[at[1:]] == sums[at[:-1]])).to_batches()


def clean(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of docs, with all their columns, in which no item occurs."""
    folder, groups = compiled(items, size)
    rows = bounded(docs).select(F.coalesce("text", F.lit("")).alias("text"), F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"))
    left = rows.mapInArrow(partial(_clean, folder, groups, size), rows.select("row").schema).select("row.*")
    left = materialise(left, "clean")
    discard(folder)
    return left


def digests(found: DataFrame) -> DataFrame:
    """find()'s rows as counts and a hash of the items."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
