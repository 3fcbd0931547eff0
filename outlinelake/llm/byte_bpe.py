"""Ids of whole texts by the tokenizers library, at the speed of its distinct pieces.

The library's pre-tokeniser never joins characters across the start of a run of white space, nor a line end with what
follows, so a text is cut before each single space that stands between two other characters and round each line end.
Each distinct piece of a batch is encoded once by the library: words and marks, which its pre-tokeniser would leave
whole, by its model alone, many at a time; ids are gathered by dictionary code. Texts for which that cut is not certain
(WHOLE, a special token's first characters) are given to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import PieceIds, byte_symbols, raw_bytes, replaced, spread

#: What sends a text to the library whole: white space beside a space, in runs of three or in runs that end the text, or characters of other than plain ranges.
WHOLE = r"[\s][ ]|[ ][\s]|\s\s\s|\s\s$|[^\t\n\r\x20-\x7e\x{a1}-\x{ac}\x{ae}-\x{17f}\x{2013}\x{2014}\x{2018}-\x{201d}\x{2022}\x{2026}\x{20ac}]"
#: A piece that the library's pre-tokeniser leaves whole, a word, and marks that it cuts off a word's end.
SINGLE, WORD, MARKS = r"^ ?(\pL+|\pN+|[^\s\pL\pN']+)$|^\n$", r"^ ?\pL+$", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Words that the library encodes in one text.
TOGETHER = 2_000


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # the same model for words that are cut already, in the characters that stand for bytes
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.symbols = np.array([list(c.encode()) + [0] * (2 - len(c.encode())) for c in byte_symbols()], np.uint8)
        self.pieces, self.words = PieceIds(self._pieces, 300_000), PieceIds(self._words, 300_000)
        # the vocabulary is spelt with a character for each byte, so a token's length is the bytes it stands for
        vocabulary = self.library.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that the pre-tokeniser leaves whole, many in one text; a word ends where a token does, so ids are counted by the bytes they stand for."""
        raw, offsets = raw_bytes(words)
        ends, found = offsets[1:], []
        for at in range(0, len(words), TOGETHER):
            to = min(at + TOGETHER, len(words))
            some = self.symbols[raw[offsets[at] : offsets[to]]]
            # a space before each word
            cut = np.insert(some, offsets[at:to] - offsets[at], np.array([32, 0], np.uint8), axis=0).reshape(-1)
            (e,) = self.model.encode_batch_fast([cut[cut > 0].tobytes().decode()], add_special_tokens=False)
            found.append(np.array(e.ids, np.uint32))
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        return np.diff(np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, "right"), prepend=0), ids

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, each with its leading space if it has one: of words and marks by themselves, of others by the whole library."""
        single = pc.match_substring_regex(pieces, SINGLE).to_numpy(zero_copy_only=False)
        stems = pc.utf8_rtrim(pieces, MARKS)
        double = pc.match_substring_regex(stems, WORD).to_numpy(zero_copy_only=False) & ~single
        rows, pairs = np.flatnonzero(single), np.flatnonzero(double)
        raw, offsets = raw_bytes(pieces)
        cut = pc.binary_length(stems).to_numpy(zero_copy_only=False).astype(np.int64)[pairs]
        sizes = np.diff(offsets)[pairs] - cut
        marks = pa.Array.from_buffers(pa.large_string(), len(pairs), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(raw[spread(offsets[pairs] + cut, sizes)])])
        parts = pa.concat_arrays([pieces.take(pa.array(rows)), stems.take(pa.array(pairs)), marks]).dictionary_encode()
        starts, sizes, known = self.words.of(parts.dictionary)
        code = parts.indices.to_numpy(zero_copy_only=False)
        starts, sizes = starts[code], sizes[code]
        owner = np.concatenate([rows, pairs, pairs])
        others = [(r, self.whole(pieces[r].as_py())) for r in np.flatnonzero(~single & ~double).tolist()]
        if others:
            owner, sizes = np.concatenate([owner, [r for r, _ in others]]), np.concatenate([sizes, [len(x) for _, x in others]])
            starts = np.concatenate([starts, len(known) + np.cumsum([0, *(len(x) for _, x in others[:-1])])])
            known = np.concatenate([known, *(x for _, x in others)])
        order = np.argsort(owner, kind="stable")  # a word before its marks
        return np.bincount(owner, weights=sizes, minlength=len(pieces)).astype(np.int64), known[spread(starts[order], sizes[order])]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of texts without nulls: where each one's ids start (and the end of all), and the ids as uint32."""
        column = column.cast(pa.large_string())
        whole = pc.or_(pc.match_substring_regex(column, WHOLE), pc.match_substring(column, "<|"))
        plain = pc.if_else(whole, pa.scalar("", pa.large_string()), column)
        # a mark before each space, so that pieces keep their space, and round each line end
        marked = pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0")
        starts, ids = self.pieces.texts(pc.split_pattern(marked, "\0"))
        return replaced(starts, ids, {int(r): self.whole(column[int(r)].as_py()) for r in np.flatnonzero(whole.to_numpy(zero_copy_only=False))})


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
