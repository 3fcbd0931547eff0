"""Which encoding a text's bytes have, and the text.

A UTF-8 mark or valid UTF-8 decides at once. Otherwise the bytes are read in every legacy encoding of CANDIDATES that
takes them all, and a bigram model scores the different words that come out: each character has a class in its encoding (a usual or rare
letter of its script, by where its bytes lie in the encoding's table; ASCII letter; sign; control), neighbours of
classes have weights, and the best sum wins. Latin letters speak against a Cyrillic encoding: its texts are in Cyrillic
but for a few words, and few words hold both. Bytes that no candidate takes are read as EUC-KR with replacements.
"""

from __future__ import annotations

import unicodedata
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encodings by the names they are known by, the one preferred first.
CANDIDATES = {"EUC-KR": "cp949", "windows-1252": "cp1252", "Shift_JIS": "cp932", "EUC-JP": "euc_jp", "GBK": "gb18030", "Big5": "big5", "windows-1251": "cp1251", "KOI8-R": "koi8_r"}
CYRILLIC = ("windows-1251", "KOI8-R")
MARK = b"\xef\xbb\xbf"

#: Where usual letters of an encoding of two bytes lie: first and last lead byte, first trail byte.
_USUAL = {"EUC-KR": [(0xB0, 0xC8, 0xA1)], "Shift_JIS": [(0x88, 0x97, 0x40)], "EUC-JP": [(0xB0, 0xCF, 0xA1)], "GBK": [(0xB0, 0xD7, 0xA1)], "Big5": [(0xA4, 0xC6, 0x40)]}

ASCII, SPACE, CONTROL, USUAL, PHONETIC, RARE, LOWER, UPPER, SIGN = range(9)


@lru_cache(maxsize=16)
def classes(name: str) -> np.ndarray:
    """The class of each character of the basic plane in an encoding."""
    out = np.full(1 << 16, RARE, np.uint8)
    for c in range(128):
        out[c] = ASCII if chr(c).isalpha() else SPACE if c >= 32 or c in (9, 10, 13) else CONTROL
    out[127:160] = CONTROL
    for first, last, trail in _USUAL.get(name, ()):
        for lead in range(first, last + 1):
            for t in range(trail, 255):
                with suppress(UnicodeDecodeError):
                    (x,) = bytes([lead, t]).decode(CANDIDATES[name])
                    out[ord(x)] = PHONETIC if name == "EUC-KR" else USUAL
    if name in ("Shift_JIS", "EUC-JP"):
        out[0x3041:0x30FB] = PHONETIC  # kana
        out[0x30FC] = PHONETIC
    if name in _USUAL:
        out[0x3000:0x3003] = SPACE
    else:
        for b in range(160, 256) if name != "KOI8-R" else range(128, 256):
            x = bytes([b]).decode(CANDIDATES[name], "ignore")
            if x:
                kind = unicodedata.category(x)
                out[ord(x)] = LOWER if kind == "Ll" else UPPER if kind == "Lu" else SIGN
        for b in range(128, 160):
            x = bytes([b]).decode(CANDIDATES[name], "ignore")
            if x and name != "KOI8-R":
                out[ord(x)] = (UPPER if x.isupper() else LOWER) if x.isalpha() else SIGN
    return out


@lru_cache(maxsize=16)
def weights(name: str) -> np.ndarray:
    """The weight of each pair of neighbours' classes in an encoding; the second's own weight is part of it."""
    w = np.zeros((9, 9))
    own = {CONTROL: -20, USUAL: 3, PHONETIC: 4, RARE: -3, LOWER: 1, UPPER: 0, SIGN: -1}
    for k, x in own.items():
        w[:, k] += x
    if name in _USUAL:
        for k in (USUAL, PHONETIC, RARE):  # other scripts' words don't hold single Latin letters
            w[ASCII, k] -= 3
            w[k, ASCII] -= 3
        w[RARE, RARE] -= 1
    else:
        cyrillic = name in CYRILLIC
        for k in (LOWER, UPPER):
            w[ASCII, k] += -12 if cyrillic else 3 if k == LOWER else -4
            w[k, ASCII] += -12 if cyrillic else 3
            w[LOWER, k] += (2 if k == LOWER else -4) if cyrillic else -3
            w[UPPER, k] += (1 if k == LOWER else 0) if cyrillic else -3
        for k in (ASCII, LOWER, UPPER):
            w[SIGN, k] -= 2
            w[k, SIGN] -= 2
        w[SIGN, SIGN] -= 3
    return w


def detect(raw: bytes) -> tuple[str, str]:
    """The name of the encoding, and the text without a mark."""
    if raw.startswith(MARK):
        return "UTF-8", raw[3:].decode("utf-8", "replace")
    try:
        return "UTF-8", raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    types = b" ".join(dict.fromkeys(raw.split()))
    best: tuple[float, str, str] | None = None
    for name, codec in CANDIDATES.items():
        try:
            text = raw.decode(codec)
        except UnicodeDecodeError:
            continue
        points = np.frombuffer(types.decode(codec).encode("utf-32-le"), "<u4")
        kinds = np.concatenate([[SPACE], np.where(points < 1 << 16, classes(name)[np.minimum(points, (1 << 16) - 1)], RARE), [SPACE]])
        score = float(weights(name)[kinds[:-1], kinds[1:]].sum())
        if name in CYRILLIC:
            score -= min(0.3 * int((kinds == ASCII).sum()), 20)
        score /= max(1, int((points > 127).sum()))
        if best is None or score > best[0]:
            best = score, name, text
    if best is None:
        return "EUC-KR", raw.decode("cp949", "replace")
    return best[1], best[2]


@F.pandas_udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("text", T.StringType())]))
def decoded(content: pd.Series) -> pd.DataFrame:
    """encoding and text of bytes; nulls of null."""
    found = [(None, None) if c is None else detect(bytes(c)) for c in content]
    return pd.DataFrame(found, columns=["encoding", "text"])


@F.pandas_udf(T.BinaryType())
def encoded(text: pd.Series, name: pd.Series) -> pd.Series:
    """The bytes of a text in the encoding of that name ("UTF-8 mark": UTF-8 behind a mark); UTF-8 where it can't hold the text, null of null."""

    def one(t: str | None, n: str) -> bytes | None:
        if t is None:
            return None
        try:
            return MARK + t.encode() if n == "UTF-8 mark" else t.encode(CANDIDATES.get(n, "utf-8"))
        except UnicodeEncodeError:
            return t.encode()

    return pd.Series([one(t, n) for t, n in zip(text, name, strict=True)], dtype=object)
