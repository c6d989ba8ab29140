"""Words of whole Arrow batches of text, as hashes and places, with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tillroll.llm.tokens import mix

_RNG = np.random.default_rng(11)
_T = _RNG.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: A multiplier of its own for each place in a word: powers of one number would make sums of some
#: different words equal (Thue-Morse words, whatever the number).
_P = _RNG.integers(1, 2**63, 1 << 16, np.uint64) * np.uint64(2) + np.uint64(1)
_Q = np.stack([np.cumprod(np.full(64, m, np.uint64)) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)])


def byte_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Which bytes are no word bytes in these ranges, as a table of word bytes."""
    out = np.ones(256, bool)
    for a, b in ranges:
        out[a:b + 1] = False
    return out


#: ``[^\x20\x09-\x0D]+`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text
UNSPACED = byte_table([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = byte_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


class Words:
    """``doc`` (row of each word), ``start`` and ``end`` (bytes in ``data``) and ``hash``; ``first`` and
    ``count``: the words of each row. Null texts have none."""

    def __init__(self, texts: pa.Array, table: np.ndarray, lower: bool):
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        at = np.frombuffer(texts.buffers()[1] or b"\0\0\0\0", np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        self.data = data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
        at = at - at[0]
        word = table[data]
        begin = np.zeros(len(data) + 1, bool)
        begin[at] = True
        before = np.concatenate([[False], word[:-1]]) if len(word) else word
        self.start = s = np.flatnonzero(word & (~before | begin[:-1]))
        after = np.concatenate([word[1:], [False]]) if len(word) else word
        self.end = np.flatnonzero(word & (~after | begin[1:])) + 1
        edge = np.searchsorted(s, at)
        self.first, self.count = edge[:-1], np.diff(edge)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.hash = self._hash(word, lower)

    def _hash(self, word, lower: bool) -> np.ndarray:
        s = self.start
        if not len(s):
            return np.zeros(0, np.uint64)
        t = _T.copy()
        if lower:
            t[65:91] = t[97:123]
        size = np.diff(s, append=len(self.data))
        pos = np.arange(s[0], len(self.data)) - np.repeat(s, size)
        part = t[self.data[s[0]:]] * _P[pos & 0xFFFF]
        far = np.flatnonzero(pos >= len(_P))
        if len(far):  # multipliers by rule where the table ends
            part[far] = t[self.data[s[0]:][far]] * (mix(pos[far].astype(np.uint64)) | np.uint64(1))
        part[~word[s[0]:]] = 0
        return mix(np.add.reduceat(part, s - s[0]) ^ (self.end - s).astype(np.uint64))


def rolled(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of the ``k`` words from each place on (the last k - 1 places are left out)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _Q[which][0]
    for j in range(1, k):
        out += h[j:j + n] * _Q[which][j]
    return mix(out ^ np.uint64(k))


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, … for count[i] numbers each, in a row."""
    total = int(count.sum())
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)
