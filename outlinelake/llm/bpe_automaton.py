"""BPE encoding and decoding by an automaton (operator 1).

The merge list is compiled once: starting from the one-state automaton over the base symbols, every merge
(u, v) -> w puts in a gadget. It cuts the arc v out of the state that u leads to and adds the arc w, beside every arc u
that is left, to a copy of the state that v leads to. All arcs of one label lead to one state, so states are labels.

Written out, the transition table has a row of 49,000 arcs for each of 49,000 states. It is kept as rows with
default links, complete once compiled: arcs are numbered so that a cut of v takes one run of numbers (v, and the labels
that came to begin with v at or after the cut), and a state's own row lists the runs cut from it with the time of the cut.
A label w = (u, v) has its own row and a link to the row of v, which counts up to the time of w, as the state was
copied then. `Automaton.next(a, b)` looks one transition up.

Encoding reads a word from left to right, once. Each prefix of a word is spelt by exactly one path of arcs, so each
position has one state, the last arc of that path: the one arc ending there that goes on from the state where it begins.
It is set once and never taken back. The word's tokens are the arcs that lead to its end.

Encoding runs on the distinct space-delimited pieces of an Arrow batch; results are gathered by dictionary code.
A text with characters outside the plain ranges of PLAIN takes its normalisation and word split from the
tokenizers library, so Unicode tables never differ; its words go through the automaton as all others.

Defined results: null and empty texts give no ids and an empty decoded text; white space only likewise. A row is
encoded whole whatever its length; repeated rows give repeated results; extra columns are ignored; an empty table
gives an empty table. doc_id may be null.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PieceIds, bounded, byte_symbols, flat, gathered, replaced, texts, tidied

#: Fixed value of the vocabulary file's format.
END = "</w>"
#: What sends a text to the library's splitter. Plain are ASCII without control characters but tab and line ends, Latin letters that are composed already, common punctuation.
PLAIN = r"[^\t\n\r\x20-\x7e\x{a1}-\x{12f}\x{132}-\x{17f}\x{2013}\x{2014}\x{2018}-\x{201d}\x{2022}\x{2026}\x{20ac}]"
CACHE = 200_000
NEVER = 1 << 60


class Automaton:
    """The compiled merges of one vocabulary. encode() follows arcs, label() is what an arc emits."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = END):
        self.labels = {i: t for t, i in vocab.items()}
        self.end = "\0" if end else ""
        self.made: dict[int, tuple[int, int, int]] = {}
        self.arcs: dict[str, int] = {}
        closed = lambda t: t[: -len(end)] + "\0" if end and t.endswith(end) else t
        for t, i in vocab.items():
            if len(closed(t).rstrip("\0")) == 1:
                self.arcs[closed(t)] = i
        begun: dict[int, list[int]] = {}  # the labels made of each label and something after it, in time
        for time, (a, b) in enumerate(merges):
            w = vocab[a + b]
            self.gadget(vocab[a], vocab[b], w, time)
            self.arcs[closed(a + b)] = w
            begun.setdefault(vocab[a], []).append(w)
        self.longest: dict[str, int] = {}
        for t in self.arcs:
            if len(t) > 2:
                self.longest[t[-3:]] = max(self.longest.get(t[-3:], 3), len(t))
        self._number(begun)
        self._rows()

    def gadget(self, u: int, v: int, w: int, time: int) -> None:
        if w in self.made or (w in (u, v)):
            raise ValueError(f"two merges make the token {self.labels[w]!r}")
        for part in (u, v):
            if part in self.made and self.made[part][2] >= time:
                raise ValueError("a merge comes before those that make its parts")
        self.made[w] = (u, v, time)

    def _number(self, begun: dict[int, list[int]]) -> None:
        """Number the arcs: a label stands before those that begin with it, the latest of which come first."""
        self.number: dict[int, int] = {}
        self.after: dict[int, int] = {}  # the number after a label's and those of all that begin with it
        stack = [(i, False) for i in self.labels if i not in self.made]
        while stack:
            i, done = stack.pop()
            if done:
                self.after[i] = len(self.number)
            else:
                self.number[i] = len(self.number)
                stack.append((i, True))
                stack += [(w, False) for w in begun.get(i, ())]

    def _rows(self) -> None:
        """Of each state the runs of arcs cut from it: where runs begin, and until when the arcs of a run were there (NEVER: still are)."""
        cuts: dict[int, list[tuple[int, int, int]]] = {}
        latest = {i: n + 1 for i, n in self.number.items()}  # the end of a label's run: itself and what has come to begin with it since the cut
        for w, (u, v, time) in sorted(self.made.items(), key=lambda x: -x[1][2]):
            latest[u] = max(latest[u], self.after[w])  # w begins with u; the labels made later have been seen before
            cuts.setdefault(u, []).append((self.number[v], latest[v], time))
        self.rows: dict[int, tuple[list[int], list[int]]] = {}
        for u, runs in cuts.items():
            at, until, inside = [0], [NEVER], []  # runs lie one in another or apart
            for lo, hi, time in [*sorted(runs, key=lambda r: (r[0], -r[1])), (NEVER, NEVER, NEVER)]:
                while inside and inside[-1][0] <= lo:
                    at.append(inside.pop()[0])
                    until.append(inside[-1][1] if inside else NEVER)
                inside.append((hi, min(time, inside[-1][1]) if inside else time))
                at.append(lo)
                until.append(inside[-1][1])
            self.rows[u] = at, until
        self.link = {w: (v, time) for w, (_, v, time) in self.made.items()}

    def next(self, state: int, arc: int) -> bool:
        """Whether the arc leaves the state; it leads to the state of its own label."""
        number, counts, rows, link = self.number[arc], NEVER, self.rows, self.link
        while True:
            if state in rows:
                at, until = rows[state]
                if until[bisect_right(at, number) - 1] < counts:
                    return False
            if state not in link:
                return True
            state, counts = link[state]

    def encode(self, word: str) -> list[int]:
        """The labels of the one path that spells the word: a state for each position, left to right, none taken back."""
        s = word + self.end
        n, arcs, longest, leaves = len(s), self.arcs, self.longest, self.next
        if (whole := arcs.get(s)) is not None:
            return [whole]
        states, came = [-1] * (n + 1), [0] * (n + 1)
        for to in range(1, n + 1):
            if to == n - 1 and self.end:
                continue  # no arc begins between the last character and the mark of the end
            for at in range(to - min(longest.get(s[max(to - 3, 0) : to], 2), to), to):
                # one arc at most that ends here goes on from the state where it begins
                if (arc := arcs.get(s[at:to])) is not None and (not at or leaves(states[at], arc)):
                    states[to], came[to] = arc, at
                    break
            else:
                raise ValueError(f"no path spells {word!r}")
        path, at = [], n
        while at:
            path.append(states[at])
            at = came[at]
        return path[::-1]

    def label(self, arc: int) -> str:
        return self.labels[arc]


def split_pattern(spec: dict) -> str:
    """The pattern of words of a file's pre-tokenizer."""
    found = [p["pattern"]["Regex"] for p in spec.get("pretokenizers", [spec]) if p["type"] == "Split"]
    if len(found) != 1:
        raise ValueError(f"one split by a pattern is needed, the file has {len(found)}")
    return found[0]


class Codec:
    """Texts to ids and back with one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = self.automaton.labels | {i: t for t, i in self.special.items()}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.find = regex.compile(split_pattern(spec["pre_tokenizer"])).findall
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.symbols = byte_symbols()
        self.word_ids: dict[str, list[int]] = {}
        self.pieces = PieceIds(self._pieces)
        self.emitted = pa.array([self.names.get(i) for i in range(max(self.names, default=0) + 1)], pa.string())

    def word(self, word: str) -> list[int]:
        """Ids of a word in byte symbols."""
        if (got := self.word_ids.get(word)) is None:
            if len(self.word_ids) >= CACHE:
                self.word_ids.clear()
            got = self.automaton.encode(word)
            if len(word) < 64:
                self.word_ids[word] = got
        return got

    def shown(self, word: str) -> str:
        return word if word.isascii() else "".join([self.symbols[b] for b in word.encode()])

    def ids(self, text: str) -> list[int]:
        """Ids of a whole text of any characters."""
        out, at = [], 0
        for m in [*self.marks.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    out += self.word(w)
            if m:
                out.append(self.special[m.group()])
                at = m.end()
        return out

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of PLAIN without white space or special tokens."""
        got = [[i for w in self.find(p.lower()) for i in self.word(self.shown(w))] for p in pieces.to_pylist()]
        return np.fromiter(map(len, got), np.int64, len(got)), np.array([i for ids in got for i in ids], np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of texts without nulls: where each one's ids start (and the end of all), and the ids."""
        column = column.cast(pa.large_string())
        whole = pc.or_(pc.match_substring_regex(column, PLAIN), pc.match_substring(column, "<|"))
        starts, ids = self.pieces.texts(pc.ascii_split_whitespace(pc.if_else(whole, pa.scalar("", pa.large_string()), column)))
        return replaced(starts, ids, {int(r): np.array(self.ids(column[int(r)].as_py()), np.uint32) for r in np.flatnonzero(whole.to_numpy(zero_copy_only=False))})

    def emit(self, starts: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The decoded texts: the labels that the arcs emit, one space between two."""
        labels = self.emitted.take(pa.array(ids))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), labels), " ")

    def decode(self, ids) -> str:
        """The labels emitted by the arcs, one space between two."""
        return " ".join([self.names[int(i)] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@tidied
def _encode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for t in gathered(batches, limit=8 << 20):
        starts, ids = c.encode(flat(t["text"]))
        decoded = c.emit(starts, ids)
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([flat(t["doc_id"]), lists, decoded], ["doc_id", "ids", "decoded"])


@tidied
def _digest(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for t in gathered(batches, limit=8 << 20):
        starts, ids = c.encode(flat(t["text"]))
        raw, names = memoryview(ids.tobytes()), [hashlib.sha256(s.encode()).hexdigest() for s in c.emit(starts, ids).to_pylist()]
        sums = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([flat(t["doc_id"]), pa.array(np.diff(starts), pa.int64()), pa.array(sums, pa.string()), pa.array(names, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: each text's ids, and the text that they decode to."""
    return texts(bounded(docs)).mapInArrow(partial(_encode, tokenizer), "doc_id long, ids array<int>, decoded string")


@tidied
def _decode(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for b in batches:
        decoded = [c.decode(x or []) for x in b.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(decoded, pa.string())], ["doc_id", "decoded"])


def decode(ids: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the decoded text of an ids array (null: empty)."""
    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(partial(_decode, tokenizer), "doc_id long, decoded string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode()'s ids and decoded texts, without sending those to the JVM."""
    return texts(bounded(docs)).mapInArrow(partial(_digest, tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
