"""A compressed FM-index over word codes: suffix order, BWT, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np

_U = np.uint64


class Bits:
    """A packed bit row with rank: 1.5 bits for each bit."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        words[:len(packed)] = packed
        self.words = words.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((_U(1) << bit) - _U(1)))


class Wavelet:
    def __init__(self, codes: np.ndarray, sigma: int):
        self.levels, rest = [], codes
        for bit in reversed(range(max(1, (sigma - 1).bit_length()))):
            one = (rest >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(one), int((~one).sum())))
            rest = np.concatenate([rest[~one], rest[one]])
        self.base = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, code, i):
        for bit, row, zeros in self.levels:
            ones = row.rank(i)
            i = np.where(code >> bit & 1, zeros + ones, i - ones)
        return i

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often code[k] stands before place i[k]."""
        return self._walk(code, i) - self.base[code]


def _half(depth: int) -> int:
    """The largest power of two that is not above ``depth``."""
    return 1 << depth.bit_length() - 1


class FMIndex:
    """Index of ``text`` (codes from 1; 0 ends each part), for patterns of up to ``depth`` codes (at
    least 2): suffixes are ordered by their first codes, ``depth`` or more."""

    def __init__(self, text: np.ndarray, depth: int):
        n, self.text, self.depth = len(text), text, depth
        ranks, held, h = text.astype(np.int64), {1: text.astype(np.int64)}, 1
        while h < depth:
            ahead = np.zeros(n, np.int64)
            ahead[:max(n - h, 0)] = ranks[h:] + 1
            ranks = np.unique(ranks * (int(ranks.max(initial=0)) + 2) + ahead, return_inverse=True)[1]
            h *= 2
            held[h] = ranks
            held = {x: r for x, r in held.items() if x in (_half(depth - 1), _half(depth))}
        self.order = sa = np.argsort(ranks, kind="stable")
        sigma = int(text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = Wavelet(text[sa - 1], sigma)
        self.short = self._groups(held, depth - 1)
        self.full = self._groups(held, depth)

    def _groups(self, held, depth: int):
        """First and end place, in suffix order, of the suffixes that share their first codes."""
        sa, n, h = self.order, len(self.order), _half(depth)
        tail = np.minimum(sa + depth - h, n - 1)  # the last h of the codes overlap the first h
        new = np.ones(n, bool)
        new[1:] = (held[h][sa[1:]] != held[h][sa[:-1]]) | (held[h][tail[1:]] != held[h][tail[:-1]])
        start = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        return start, np.append(start[1:], n), which

    def windows(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of streams text[begin:end], cut off at ``depth``: all streams step
        left together, one backward step a code. When a match has ``depth`` codes its interval is
        reported for its place, and the match gives up its last code (the parent interval).
        Returns the places and the first suffix of their intervals."""
        places, found = [], []
        lo = hi = size = np.zeros(0, np.int64)
        order = np.argsort(begin - end, kind="stable")  # longest first: finished streams fall off the end
        begin, at = begin[order], end[order] - 1
        lo, hi, size = np.zeros(len(at), np.int64), np.full(len(at), len(self.text)), np.zeros(len(at), np.int64)
        live = len(at)
        while True:
            live = int(np.searchsorted(-(at[:live] - begin[:live]), 0, "right")) if live else 0
            if not live:
                break
            at, begin, lo, hi, size = at[:live], begin[:live], lo[:live], hi[:live], size[:live]
            code = self.text[at]
            lo = self.first[code] + self.wavelet.rank(code, lo)
            hi = self.first[code] + self.wavelet.rank(code, hi)
            size = size + 1
            done = size == self.depth
            if done.any():
                places.append(at[done])
                found.append(lo[done])
                start, stop, which = self.short
                parent = which[lo[done]]
                lo[done], hi[done], size[done] = start[parent], stop[parent], self.depth - 1
            at = at - 1
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *places]), np.concatenate([none, *found])
