"""Scoring with a hierarchical Pitman-Yor language model (operator 2).

Dishes are words. Each word before has a context restaurant of its own (a text's start is a word too). Their parents
are restaurants of classes of the word before (CLASSES, by its last byte; the start is a class), and these share one
restaurant over all words, whose base measure has no atoms: a new word takes the mass of a new table there.
P(w | u) = (c_uw - d t_uw + (theta + d T_u) P(w | class of u)) / (C_u + theta), and likewise above, where the customers
are the tables below.

Seating is sampled by Gibbs sweeps. In a sweep every dish of every restaurant leaves its tables and is seated again
given the others: the number of tables among its first SMALL customers is drawn from its exact conditional (generalised
Stirling numbers times the parent's factors); later customers sit down by the Chinese-restaurant predictive, in runs of
a sixteenth of those seated. Context restaurants are seated in ROUNDS groups, each given what those before have left;
restaurants' totals are those of the sweep before. Predictive probabilities of a seating with its own totals are
averaged over `samples` sweeps after `burn`.

Pairs of words are counted by block and dealt by their second word, so a bucket has all contexts of its words. The words
themselves travel along, and a bucket adds up their counts for the base. What it lacks are the totals of contexts (C_u,
T_u): before each sweep the sums of all buckets go to the one that adds up that context, and come back. A block's pairs
get their probabilities, and its words their counts, in a file of the shared folder, in the block's own order. docs must be a scan of stored files (see numbered()). In this model words are 64-bit hashes
(60 bits and the class where they are contexts); counts of the base are by the words themselves. Discounts are
n1 / (n1 + 2 n2), one for all context restaurants, else of each restaurant; the random numbers depend on the words
alone, so a task that runs again draws the same.

Defined results: null and empty texts have the end token only. A null doc_id belongs to the training rows. Without
training rows all words are unknown and base_score is 0. Repeated rows count each time; extra columns are ignored; an
empty table gives no rows. A text of any length is one row of one block and is scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, flat, give_back, hashed, materialise, mixed, raw_bytes, scan_parts, tidied, words
from .side_files import keyed_file, keyed_files

BLOCK_BYTES, SMALL, ROUNDS = 32 << 20, 48, 4
GROUPS = [b".!?", b",;:", b"0123456789", b"e", b"n", b"st", b"rl", b"aiou", b"dgh", b"kmpxyzcbfjqvw"]
CLASSES = len(GROUPS) + 2
START, OTHER = len(GROUPS), len(GROUPS) + 1
CLASS_OF = np.full(256, OTHER, np.int64)
for _k, _group in enumerate(GROUPS):
    CLASS_OF[list(_group)] = _k


def last_classes(dictionary: pa.Array) -> np.ndarray:
    """The class that each word gives to the word after it."""
    raw = dictionary.cast(pa.large_binary())
    if not len(raw):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    return CLASS_OF[np.frombuffer(raw.buffers()[2], np.uint8)[offsets[1:] - 1]]


START_HASH = (mixed(np.uint64([1])) & ~np.uint64(15) | np.uint64(START))[0]


def contexts(offsets: np.ndarray, codes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' tokens with an end after each: where each text starts, the codes, and the word before (`end`, which is before no word, where a text starts)."""
    n = len(offsets) - 1
    tokens = np.insert(codes.astype(np.int32), offsets[1:], end)
    starts = offsets + np.arange(n + 1)
    before = np.empty(len(tokens), np.int32)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = end
    return starts, tokens, before


class Pairs:
    """Numbers of a block's pairs of words that are sorted by bucket, hash of the word and hash of the context."""

    def __init__(self, dictionary: pa.Array, parts: int):
        names, self.dictionary = hashed(dictionary), dictionary
        self.m, self.parts = len(names) + 1, parts
        word = np.append(names, hashed(pa.array([""])))
        context = np.append(names & ~np.uint64(15) | last_classes(dictionary).astype(np.uint64), START_HASH)
        self.by_word = by_word = np.lexsort((word, dealt(word, parts)))
        by_context = np.argsort(context, kind="stable")
        self.words, self.contexts = word[by_word], context[by_context]
        self.word_rank, self.context_rank = np.empty(self.m, np.int64), np.empty(self.m, np.int64)
        self.word_rank[by_word] = self.context_rank[by_context] = np.arange(self.m)

    def of(self, tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
        out = self.word_rank[tokens]
        out *= self.m
        out += self.context_rank[before]
        return out

    def cuts(self) -> np.ndarray:
        """Where each bucket's words begin among sorted ones (and the end of all)."""
        return np.searchsorted(dealt(self.words, self.parts), np.arange(self.parts + 1))

    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the sorted words, and where each starts (and the end of all). The end token is the word ''."""
        named = pa.concat_arrays([self.dictionary.cast(pa.large_binary()), pa.array([b""], pa.large_binary())])
        return raw_bytes(named.take(pa.array(self.by_word)))


def dealt(names: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of each hash."""
    return ((names >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Numbers as bytes by significance, as many as the largest needs, compressed."""
    x = np.ascontiguousarray(x).view(f"<u{x.itemsize}")
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    raw = np.empty((width, len(x)), np.uint8)
    for k in range(width):
        raw[k] = x.view(np.uint8)[k :: x.itemsize]
    return len(x).to_bytes(8, "little") + bytes([width]) + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    n, width, size = int.from_bytes(raw[:8], "little"), raw[8], np.dtype(kind).itemsize
    out = np.zeros(n, f"<u{size}")
    if n and width:
        planes = np.frombuffer(pa.decompress(memoryview(raw)[9:], width * n, codec="zstd"), np.uint8).reshape(width, n)
        for k in range(width):
            out.view(np.uint8)[k::size] = planes[k]
    return out.view(kind)


def gaps(x: np.ndarray, kind: str) -> bytes:
    """Ascending numbers, packed."""
    return packed(np.diff(x.astype(kind), prepend=np.zeros(1, kind)))


def summed(raw: bytes, kind: str) -> np.ndarray:
    """What gaps() has packed."""
    return np.cumsum(unpacked(raw, kind), dtype=kind)


def batched(rows: Iterator[dict], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about `limit` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row.values() if isinstance(x, bytes))
        if size > limit or len(held) > 1000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def steady(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows in blocks of up to `limit` bytes of text (one row at least). Where a block ends depends on the rows alone, not on how they come in batches."""
    held, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, base + limit - size, "right"))
            to = max(to, at if held else at + 1)
            if to > at:
                held.append(b.slice(at, to - at))
                size += int(ends[to - 1]) - base
                at = to
            if at < b.num_rows:  # the next row doesn't fit
                whole, held, size = [pa.Table.from_batches(held).combine_chunks()], [], 0
                yield whole.pop()  # only who takes it holds it
                give_back()
    if held:
        whole, held = [pa.Table.from_batches(held).combine_chunks()], []
        yield whole.pop()


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each block of texts its number, rows without the texts, starts, tokens, words before them, and dictionary. A scan gives the same blocks whenever it is read, whatever the size of batches."""
    for k, t in enumerate(steady(batches, BLOCK_BYTES)):
        offsets, codes, dictionary = words(flat(t["text"]))
        t, found = t.drop_columns("text"), contexts(offsets, codes, len(dictionary))
        del codes
        yield (TaskContext.get().partitionId() << 24) | k, t, *found, dictionary


def _learnt(t: pa.Table, starts: np.ndarray) -> np.ndarray:
    """Of each token whether its text is a training row."""
    return np.repeat(~t["held"].to_numpy(zero_copy_only=False), np.diff(starts))


PAIRS = "to int, block long, words binary, sizes binary, letters binary, runs binary, contexts binary, context binary, n binary"
_PAIRS = pa.schema([("to", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("words", "sizes", "letters", "runs", "contexts", "context", "n"))])


def _counted(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for block, t, starts, tokens, before, dictionary in blocks(batches):
        of = Pairs(dictionary, parts)
        both = of.of(tokens, before)
        both *= 2
        both += _learnt(t, starts)
        both.sort()
        learnt = (both & 1).astype(np.uint32)
        both >>= 1
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        pairs, n = both[first], np.add.reduceat(learnt, first).astype("<u4")
        del both, learnt
        word, context = pairs // of.m, pairs % of.m
        (letters, starts), firsts = of.letters(), of.cuts()
        cuts = np.searchsorted(pairs, firsts * of.m).tolist()
        for to, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < z:
                # every word of the dictionary is the second of a pair
                at = np.flatnonzero(np.append(True, word[a + 1 : z] != word[a : z - 1]))
                mine = starts[firsts[to] : firsts[to + 1] + 1]
                own, back = np.unique(context[a:z], return_inverse=True)
                yield {"to": to, "block": block, "words": gaps(of.words[firsts[to] : firsts[to + 1]], "<u8"), "sizes": packed(np.diff(mine).astype("<u4")), "letters": packed(letters[mine[0] : mine[-1]]), "runs": packed(np.diff(np.append(at, z - a)).astype("<u4")), "contexts": gaps(of.contexts[own], "<u8"), "context": packed(back.astype("<u4")), "n": packed(n[a:z])}


@tidied
def _pairs(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block its words, and its pairs with their training counts, a row for each bucket."""
    yield from batched(_counted(parts, batches), _PAIRS)


@dataclass
class Restaurants:
    """What all tasks share of a seating: of each class its discount, strength, customers, tables; of the parent the same; discount and strength of context restaurants."""

    discount: np.ndarray
    strength: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    root_discount: float
    root_strength: float
    root_tables: int
    word_discount: float = 0.5
    word_strength: float = 1.0

    @property
    def root_customers(self) -> float:
        return float(self.tables.sum())

    def back_off(self) -> np.ndarray:
        return (self.strength + self.discount * self.tables) / (self.customers + self.strength)

    def known(self, counts: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """P(w | class) of words with customers and tables (words, CLASSES)."""
        root = (tables.sum(axis=1) - self.root_discount) / (self.root_customers + self.root_strength)
        return (counts - self.discount * tables) / (self.customers + self.strength) + self.back_off() * root[:, None]

    def unknown(self) -> np.ndarray:
        """P(new word | class)."""
        return self.back_off() * (self.root_strength + self.root_discount * self.root_tables) / (self.root_customers + self.root_strength)

    def of_class(self, counts: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """P(w | class) of words, those without customers too."""
        return np.where(tables.sum(axis=1)[:, None] > 0, self.known(counts, tables), self.unknown())

    def of_word(self, c: np.ndarray, t: np.ndarray, customers: np.ndarray, tables: np.ndarray, above: np.ndarray) -> np.ndarray:
        """P(w | word before) of pairs with c customers at t tables, given their contexts' totals and P(w | class)."""
        d, theta = self.word_discount, self.word_strength
        return (c - d * t + (theta + d * tables) * above) / (customers + theta)


@lru_cache(maxsize=64)
def stirling(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S_d(c, t), c and t up to SMALL."""
    s = np.full((SMALL + 1, SMALL + 2), -np.inf)
    s[0, 0] = 0
    for c in range(SMALL):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = s[c, t] + np.log(np.maximum(c - d * t, 1e-300))
        s[c + 1, t] = np.logaddexp(s[c, t - 1], np.where(c >= t, stay, -np.inf))
    return s


class Draws:
    """Random numbers by counter: each depends on its word's hash, the sweep, the context and how many were drawn before, so not on which rows share a batch or a partition."""

    def __init__(self, names: np.ndarray, sweep: int, context: int):
        with np.errstate(over="ignore"):
            self.names = mixed(names ^ mixed(np.uint64([sweep * 256 + context + 1]))[0])

    def uniform(self, rows: np.ndarray, number: np.ndarray) -> np.ndarray:
        """In (0, 1), for each row and number (arrays that broadcast)."""
        with np.errstate(over="ignore"):
            x = mixed(self.names[rows] ^ mixed(number.astype(np.uint64) + np.uint64(0x5851F42D)))
        return ((x >> np.uint64(12)).astype(float) + 0.5) / (1 << 52)


def seat(c: np.ndarray, others: np.ndarray, j: int, r: Restaurants, draws: Draws) -> np.ndarray:
    """Tables of dishes with c customers in context j, given the dishes' customers in the parent from other contexts."""
    t, d, some = np.minimum(c, 1), float(r.discount[j]), np.flatnonzero(c > 1)
    new = (r.strength[j] + d * r.tables[j]) / (r.root_customers + r.root_strength)
    # customers from others: the dish has its parent table; else the first of the tables opens it
    t[some] = tables_of(c[some], d, np.full(len(some), new), others[some] - r.root_discount, draws, some)
    return t


def seat_word(c: np.ndarray, tables: np.ndarray, others: np.ndarray, above: np.ndarray, mass: np.ndarray, k: np.ndarray, r: Restaurants, draws: Draws) -> np.ndarray:
    """Tables of pairs with c >= 2 customers in their context restaurants, which have `tables`; in the class k of each its dish has `others` customers from other contexts at `above` tables, and a new table there has `mass`."""
    d = r.word_discount
    base = others + mass - r.discount[k] * np.maximum(np.minimum(above, others), 1)
    return tables_of(c, d, (r.word_strength + d * tables) / (r.customers + r.strength)[k], base, draws, np.arange(len(c)))


def tables_of(c: np.ndarray, d: float, new: np.ndarray, base: np.ndarray, draws: Draws, rows: np.ndarray) -> np.ndarray:
    """Tables of dishes with c >= 2 customers: a table beside i others of the dish has the factor new * (base + i), the first one's is the same for any number. rows: their numbers for draws."""
    t, first = np.ones(len(c), np.int64), np.minimum(c, SMALL)
    order, u = np.argsort(first, kind="stable"), draws.uniform(rows, np.zeros(1))
    at = np.searchsorted(first[order], np.arange(2, SMALL + 2))
    for n, lo, hi in zip(range(2, SMALL + 1), at[:-1].tolist(), at[1:].tolist(), strict=True):
        i, more = np.arange(1, n), np.exp(np.diff(stirling(round(d, 6))[n, 1 : n + 1]))
        for begin in range(lo, hi, 200_000 // n + 1):
            some = order[begin : min(hi, begin + 200_000 // n + 1)]
            odds = new[some][:, None] * np.maximum(base[some][:, None] + i, 1e-12) * more
            t[some] = drawn(odds, u[some])
    big = np.flatnonzero(c > SMALL)
    if len(big):
        t[big] = later(c[big], t[big], d, new[big], base[big], draws, rows[big])
    return t


def drawn(odds: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A number from 1 for each row, by its place u in the cumulated weights; odds: of i + 1 over i, from i = 1."""
    if odds.shape[1] < 16:
        weight, one = np.cumprod(odds, axis=1), np.ones(len(odds))
    else:  # products of many could overflow
        logs = np.cumsum(np.log(odds), axis=1)
        top = np.maximum(logs.max(axis=1), 0)
        weight, one = np.exp(logs - top[:, None]), np.exp(-top)
    ends = one[:, None] + np.cumsum(weight, axis=1)
    return 1 + (one < u * ends[:, -1]) + (ends[:, :-1] < (u * ends[:, -1])[:, None]).sum(axis=1)


def later(c: np.ndarray, t: np.ndarray, d: float, new: np.ndarray, base: np.ndarray, draws: Draws, rows: np.ndarray) -> np.ndarray:
    """Tables of dishes whose first SMALL customers of c have t, when the others have come."""
    out, on, left, mine = t.copy(), np.arange(len(c)), c - SMALL, t
    seated, number = SMALL, 1000
    while len(on):
        step = np.minimum(left, max(1, seated // 16))
        mass = new * np.maximum(base + mine, 1e-12)
        p = np.clip(mass / (seated - d * mine + mass), 0, 1)
        # a run of customers: the binomial's mean and spread, rounded at random; of one customer exactly its law
        u, v, w = (draws.uniform(rows, np.array([number + i])) for i in range(3))
        spread_ = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v) * np.sqrt(step * p * (1 - p)) * (step > 1)
        mine = mine + np.clip(np.floor(step * p + spread_ + w), 0, step).astype(np.int64)
        number += 3
        seated += max(1, seated // 16)
        left = left - step
        if not left.all():  # some have all theirs
            out[on[left == 0]] = mine[left == 0]
            on, left, mine, new, base, rows = (x[left > 0] for x in (on, left, mine, new, base, rows))
    return out


STATE = "p int, words binary, runs binary, contexts binary, context binary, c binary, t binary, tables binary, prob binary, blocks array<long>, at array<binary>, totals array<binary>, sums array<long>"
_STATE = pa.schema([("p", pa.int32()), *((c, pa.binary()) for c in ("words", "runs", "contexts", "context", "c", "t", "tables", "prob")), ("blocks", pa.list_(pa.int64())), ("at", pa.list_(pa.binary())), ("totals", pa.list_(pa.binary())), ("sums", pa.list_(pa.int64()))])


class Bucket:
    """The pairs of a bucket's words: their contexts, customers c and tables t; and of each word its tables in the classes."""

    def __init__(self, row: dict):
        self.row = row
        self.contexts = summed(row["contexts"], "<u8")
        self.context, self.c, self.t = (unpacked(row[x], "<u4") for x in ("context", "c", "t"))

    def load(self) -> Bucket:
        """What sums of contexts don't need."""
        row = self.row
        self.words = summed(row["words"], "<u8")
        self.k = (self.contexts & np.uint64(15)).astype(np.int8)[self.context]
        self.cell = np.repeat(np.arange(len(self.words)) * CLASSES, unpacked(row["runs"], "<u4"))
        self.cell += self.k
        self.count()
        self.tables = unpacked(row["tables"], "<u4").astype(np.int64).reshape(-1, CLASSES) if row["tables"] else np.minimum(self.counts, 1)
        return self

    def count(self) -> None:
        """Customers of the classes are tables of the contexts."""
        self.counts = np.bincount(self.cell, self.t, len(self.words) * CLASSES).astype(np.int64).reshape(-1, CLASSES)

    def sent(self, parts: int) -> Iterator[dict]:
        """Of each context its customers and tables here, for the bucket that adds them up."""
        n = len(self.contexts)
        c, t = (np.bincount(self.context, x, n).astype("<u8") for x in (self.c, self.t))
        to = dealt(self.contexts, parts)
        for q in np.unique(to).tolist():
            mine = to == q
            yield {"to": q, "p": self.row["p"], "contexts": gaps(self.contexts[mine], "<u8"), "c": packed(c[mine]), "t": packed(t[mine])}

    def received(self, answers: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each pair's context, in all buckets."""
        order = np.argsort(dealt(self.contexts, parts), kind="stable")
        out = []
        for x in ("c", "t"):
            total = np.empty(len(self.contexts))
            total[order] = np.concatenate([unpacked(b, "<u8") for b in answers[x].to_pylist()])
            out.append(total[self.context])
        return out[0], out[1]

    def probabilities(self, r: Restaurants, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return r.of_word(self.c, self.t, customers, tables, r.of_class(self.counts, self.tables).reshape(-1)[self.cell])

    def seat(self, r: Restaurants, number: int, tables: np.ndarray) -> None:
        """One sweep: context restaurants, then classes."""
        share = (r.strength + r.discount * r.tables) / (r.root_customers + r.root_strength)
        counts, under, of_words = self.counts.reshape(-1), self.tables.reshape(-1), self.tables.sum(axis=1)
        several = np.flatnonzero(self.c > 1)
        group = (self.contexts >> np.uint64(20)) % np.uint64(ROUNDS)
        group = group.astype(np.int64)[self.context[several]]
        for g in range(ROUNDS):
            i = several[group == g]
            c, t, k, cell = self.c[i].astype(np.int64), self.t[i].astype(np.int64), self.k[i], self.cell[i]
            w = cell // CLASSES
            mass = share[k] * np.maximum(of_words[w] - r.root_discount, 0)
            draws = Draws(mixed(self.words[w] ^ mixed(self.contexts[self.context[i]])), number, CLASSES)
            new = seat_word(c, tables[i], counts[cell] - t, under[cell], mass, k, r, draws)
            self.t[i] = new
            np.add.at(counts, cell, new - t)
            cell = np.unique(cell[new != t])
            fit = np.maximum(np.minimum(under[cell], counts[cell]), np.minimum(counts[cell], 1))
            np.add.at(of_words, cell // CLASSES, fit - under[cell])
            under[cell] = fit
        customers, under = (np.ascontiguousarray(x.T) for x in (self.counts, self.tables))
        for j in range(CLASSES):
            others = of_words - under[j]
            under[j] = seat(customers[j], others, j, r, Draws(self.words, number, j))
            of_words = others + under[j]
        self.tables = np.ascontiguousarray(under.T)

    def stored(self, prob: np.ndarray | None = None) -> dict:
        of_words = self.tables.sum(axis=1)
        sums = [self.tables.sum(axis=0), self.counts.sum(axis=0), (self.counts == 1).sum(axis=0), (self.counts == 2).sum(axis=0), [(of_words == 1).sum(), (of_words == 2).sum(), (of_words > 0).sum(), (self.c == 1).sum(), (self.c == 2).sum()]]
        more = {} if prob is None else {"prob": packed(prob)}
        return self.row | {"t": packed(self.t), "tables": packed(self.tables.astype("<u4").ravel()), "sums": np.concatenate(sums).tolist()} | more


def _base(rows: list[dict], learnt: np.ndarray) -> tuple[int, int, list[bytes]]:
    """Of blocks' words in a bucket and their training counts there: the sum, how many different words have any, and of each block its words' counts in all blocks. By the words themselves, not their hashes."""
    sizes = [unpacked(x["sizes"], "<u4") for x in rows]
    offsets = np.append(0, np.cumsum(np.concatenate(sizes), dtype=np.int64))
    letters = np.concatenate([unpacked(x["letters"], "<u1") for x in rows])
    names = pa.Array.from_buffers(pa.large_binary(), len(learnt), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    code = names.dictionary_encode().indices.to_numpy()
    total = np.bincount(code, learnt).astype("<u8")
    ends = np.cumsum([len(x) for x in sizes])
    return int(total.sum()), int((total > 0).sum()), [packed(x) for x in np.split(total[code], ends[:-1])]


@tidied
def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket of all blocks' pairs of its words, one table for each dish that a restaurant serves."""
    rows = sorted(rows_of(batches), key=lambda x: x["block"])
    if not rows:
        return
    runs, n = (np.concatenate([unpacked(x[c], "<u4") for x in rows]) for c in ("runs", "n"))
    total, known, totals = _base(rows, np.add.reduceat(n, np.cumsum(runs, dtype=np.int64) - runs, dtype=np.int64))
    words, word = np.unique(np.concatenate([summed(x["words"], "<u8") for x in rows]), return_inverse=True)
    own, context = np.unique(np.concatenate([summed(x["contexts"], "<u8") for x in rows]), return_inverse=True)
    pairs = np.repeat(word * len(own), runs)
    sizes, first, at = [], 0, 0
    for x in rows:
        mine = unpacked(x["context"], "<u4")
        pairs[at : at + len(mine)] += context[first + mine.astype(np.int64)]
        sizes.append(len(mine))
        at, first = at + len(mine), first + int(mine.max()) + 1
    del word, context, runs
    both, back = np.unique(pairs, return_inverse=True)
    del pairs
    n, ends = np.bincount(back, n).astype("<u4"), np.cumsum(sizes)
    row = {"p": rows[0]["to"], "words": gaps(words, "<u8"), "runs": packed(np.bincount(both // len(own), minlength=len(words)).astype("<u4")), "contexts": gaps(own, "<u8"), "context": packed((both % len(own)).astype("<u4")), "c": packed(n), "t": packed(np.minimum(n, 1)), "tables": b"", "prob": b"", "blocks": [x["block"] for x in rows], "at": [gaps(back[z - k : z], "<u4") for k, z in zip(sizes, ends.tolist(), strict=True)], "totals": totals}
    del rows, both, back, n
    row = Bucket(row).load().stored()
    row["sums"] += [known, total]
    yield pa.RecordBatch.from_pylist([row], _STATE)


SUMS = "to int, p int, contexts binary, c binary, t binary"
_SUMS = pa.schema([("to", pa.int32()), ("p", pa.int32()), *((c, pa.binary()) for c in ("contexts", "c", "t"))])
TOTALS = "p int, q int, c binary, t binary"
_TOTALS = pa.schema([("p", pa.int32()), ("q", pa.int32()), ("c", pa.binary()), ("t", pa.binary())])


@tidied
def _sums(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batched((x for row in rows_of(batches) for x in Bucket(row).sent(parts)), _SUMS)


@tidied
def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts' customers and tables in all buckets, for each bucket that has sent some, in its order."""
    rows = list(rows_of(batches))
    if not rows:
        return
    names = [summed(x["contexts"], "<u8") for x in rows]
    ends = np.cumsum([len(x) for x in names])
    _, back = np.unique(np.concatenate(names), return_inverse=True)
    c, t = (np.bincount(back, np.concatenate([unpacked(x[y], "<u8") for x in rows])).astype("<u8")[back] for y in ("c", "t"))
    yield from batched(({"p": x["p"], "q": x["to"], "c": packed(c[z - len(k) : z]), "t": packed(t[z - len(k) : z])} for x, k, z in zip(rows, names, ends.tolist(), strict=True)), _TOTALS)


@tidied
def _sweep(r: Restaurants, number: int, keep: bool, folder: str, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets after one sweep; if `keep`, with the probabilities that they had before it added up."""
    for row in rows_of(batches):
        b = Bucket(row).load()
        customers, tables = b.received(keyed_file(folder, row["p"]), parts)
        prob = None
        if keep:
            prob = b.probabilities(r, customers, tables)
            prob += unpacked(row["prob"], "<f4") if row["prob"] else 0
            prob = prob.astype("<f4")
        del customers
        b.seat(r, number, tables)
        yield pa.RecordBatch.from_pylist([b.stored(prob)], _STATE)


ANSWERS = "p long, q int, logs binary, totals binary"
_ANSWERS = pa.schema([("p", pa.int64()), ("q", pa.int32()), ("logs", pa.binary()), ("totals", pa.binary())])


def _answered(r: Restaurants, samples: int, folder: str, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for row in rows_of(batches):
        b = Bucket(row).load()
        prob = b.probabilities(r, *b.received(keyed_file(folder, row["p"]), parts)) + (unpacked(row["prob"], "<f4") if row["prob"] else 0)
        logs = np.log10(prob / samples).astype("<f4")
        for block, at, totals in zip(row["blocks"], row["at"], row["totals"], strict=True):
            yield {"p": block, "q": row["p"], "logs": packed(logs[summed(at, "<u4")]), "totals": totals}


@tidied
def _answers(r: Restaurants, samples: int, folder: str, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Logarithms of the mean probabilities of each block's pairs and training counts of its words, in its order."""
    yield from batched(_answered(r, samples, folder, parts, batches), _ANSWERS)


@tidied
def _scores(answers: str, parts: int, n: int, v: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of each block's texts with its words' counts and its pairs' probabilities."""
    for block, t, starts, tokens, before, dictionary in blocks(batches):
        found, of = keyed_file(answers, block), Pairs(dictionary, parts)
        pairs = of.of(tokens, before)
        order = np.argsort(pairs)
        pairs = pairs[order]
        number = np.cumsum(np.append(False, pairs[1:] != pairs[:-1]), dtype=np.int32)
        del pairs, before
        logs, total = (np.concatenate([unpacked(x, kind) for x in found[c].to_pylist()]) if found else np.zeros(0) for c, kind in (("logs", "<f4"), ("totals", "<u8")))
        if len(total) != of.m or len(logs) != number[-1] + 1:
            raise ValueError("the input isn't a scan that gives the same blocks again")
        score = np.empty(len(tokens), np.float32)
        score[order] = logs[number]
        del order, number
        total = total[of.word_rank]
        base = np.log10(total + 1) - math.log10(n + v + 1)
        add = lambda x, s=starts: np.add.reduceat(x, s[:-1])  # noqa: E731  every text has its end token
        columns = [flat(t["doc_id"]), flat(t["held"]), pa.array(np.diff(starts), pa.int64()), pa.array(add((total[tokens] > 0).astype(np.int64))), pa.array(add(base[tokens])), pa.array(add(score.astype(float)))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def _rate(one: int, two: int) -> float:
    return float(np.clip(one / max(1.0, one + 2 * two), 0.05, 0.95))


def _sums_of(state: DataFrame, n: int = 4 * CLASSES + 5) -> np.ndarray:
    return np.array([x or 0 for x in state.agg(*(F.sum(F.col("sums")[k]) for k in range(n))).first()], float)


def _exchanged(state: DataFrame, parts: int) -> str:
    """A file for each bucket with its contexts' totals; the folder."""
    sums = state.mapInArrow(partial(_sums, parts), SUMS)
    return keyed_files(sums.repartitionById(parts, "to").mapInArrow(_totals, TOTALS), ["q"], "totals", parts)


def score(docs: DataFrame, held: Column, burn: int = 2, samples: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text; learnt from rows where `held` is false."""
    rows = bounded(docs).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held"))
    parts = scan_parts(rows)
    state = materialise(rows.mapInArrow(partial(_pairs, parts), PAIRS).repartitionById(parts, "to").mapInArrow(_gather, STATE), "seating")
    of = _sums_of(state, 4 * CLASSES + 7)
    tables, customers, ones, twos = of[: 4 * CLASSES].reshape(4, CLASSES)
    r1, r2, words_, p1, p2, v, n = of[4 * CLASSES :]
    r = Restaurants(np.array([_rate(a, b) for a, b in zip(ones, twos, strict=True)]), np.full(CLASSES, 10.0), customers, tables, _rate(r1, r2), 10.0, int(words_), _rate(p1, p2))
    for k in range(burn + samples):
        folder = _exchanged(state, parts)
        # what a sweep finds are the seats of the one before it
        out = materialise(state.mapInArrow(partial(_sweep, r, k, k > burn, folder, parts), STATE), "seating")
        discard(state, folder)
        state, of = out, _sums_of(out)
        r = replace(r, tables=of[:CLASSES], customers=of[CLASSES : 2 * CLASSES])
    folder = _exchanged(state, parts)
    found = state.mapInArrow(partial(_answers, r, samples, folder, parts), ANSWERS)
    # a task has the blocks of one input partition
    answers = keyed_files(found, ["q"], "answers", parts, F.shiftright("p", 24))
    discard(state, folder)
    scored = rows.mapInArrow(partial(_scores, answers, parts, int(n), int(v)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    # stored, as what is read later could be split otherwise
    result = materialise(scored.withColumn("train_tokens", F.lit(int(n)).cast("long")), "scores")
    discard(answers)
    return result


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, perplexity, base_perplexity over all tokens of each side."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))
