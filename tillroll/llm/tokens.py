"""Exact tokenizer ids at word-cache speed, for Arrow batches inside Spark tasks.

The tokenizers library takes about 1 MB of text a second and core. A byte-pair encoder works on
one pre-token (word) at a time, so the ids of a text are the ids of its pre-tokens in a row. A
task finds the pre-tokens of many texts at once with numpy (by the vocabulary's own split
pattern), looks them up by 64-bit hash in a bounded cache, and lets the library encode the ones
it has not met yet. Texts with characters outside a plain Latin range (where Unicode tables of two
libraries might differ) and texts with an added token's string are encoded whole by the library.
"""

from __future__ import annotations

import ctypes
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WS, _SEP = 4, 5


def _classes() -> np.ndarray:
    """1 letter, 2 number, 3 other, 4 white space, 5 text separator (NUL), 0 not plain."""
    out = np.zeros(0x250, np.uint8)
    for c in range(0x21, 0x250):
        ch = chr(c)
        if 0x7E < c < 0xA1 or c == 0xAD or len(ch.lower()) > 1 or ord(ch.lower()) >= 0x250:
            continue
        out[c] = 1 if ch.isalpha() else 2 if ch.isnumeric() else 3
    out[[9, 10, 13, 32]] = _WS
    out[0] = _SEP
    return out


_CLASS = _classes()
_LOWER = np.array([ord(chr(c).lower()) if _CLASS[c] else c for c in range(0x250)], np.uint16)
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x250) if not _CLASS[c] or not c) + "ɐ-\U0010ffff]|<\\|")
_RNG = np.random.default_rng(7)
_T = _RNG.integers(1, 2**63, 0x250, np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.zeros(0, np.uint64)

#: Pre-tokens kept by a worker's cache before it starts anew (about 60 MB with its table).
CACHE_WORDS = 1_000_000
#: Characters worked on at once.
CHUNK_CHARS = 1_000_000


def multipliers(n: int) -> np.ndarray:
    """An odd multiplier for each place in a pre-token. They must not be powers of one number, whose sums are
    equal for some different words (Thue-Morse words, whatever the number)."""
    global _P
    if n > len(_P):
        _P = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _P


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class HashTable:
    """64-bit keys to row numbers 0, 1, 2, …: open addressing, whole arrays at a time."""

    def __init__(self, limit: int):
        self.bits = max(4, int(2 * limit - 1).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        self.n = 0

    def _slots(self, h):
        # keys may be chosen by their order (smallest hashes), so their own bits are no even spread
        return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, h: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a key is not held."""
        out = np.full(len(h), -1, np.int32)
        slot, todo, mask = self._slots(h), None, len(self.keys) - 1
        while True:
            key, row = self.keys[slot], self.rows[slot]
            hit = (key == h) & (row >= 0)
            if todo is None:
                out[hit] = row[hit]
            else:
                out[todo[hit]] = row[hit]
            on = np.flatnonzero(~hit & (row >= 0))
            if not len(on):
                return out
            todo = on if todo is None else todo[on]
            h, slot = h[on], (slot[on] + 1) & mask

    def add(self, h: np.ndarray) -> None:
        """New, distinct keys get the next row numbers in order."""
        row, slot, mask = np.arange(self.n, self.n + len(h), dtype=np.int32), self._slots(h), len(self.keys) - 1
        self.n += len(h)
        while len(h):
            free = self.rows[slot] < 0
            self.rows[slot[free]] = row[free]
            left = self.rows[slot] != row
            self.keys[slot[~left]] = h[~left]
            h, row, slot = h[left], row[left], (slot[left] + 1) & mask


class CachedEncoder:
    """``encode(texts)`` gives (ids as uint32, number of ids of each text), as the library would.

    With ``added`` an added token's string in a text becomes that token, as by the library's default;
    without it is text like any other (for files whose separator must not occur in texts).

    ``kind`` is ``byte`` (byte-level BPE that keeps white space; a line feed must have an id of
    its own) or ``word`` (lower-cased words, the last token of each ending in ``</w>``). None
    encodes as the empty text.
    """

    def __init__(self, path: str, kind: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not added
        if not all("<|" in t.content for t in self.tok.get_added_tokens_decoder().values()):
            raise ValueError("an added token that _ODD does not find")
        self.word = kind == "word"
        vocab = self.tok.get_vocab()
        self.final = np.zeros(max(vocab.values()) + 1, bool)
        if self.word:
            self.final[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        else:
            self.feed = self._ids(["\n"])[0][0]
        self._reset()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _reset(self):
        self.table = HashTable(CACHE_WORDS)
        self.flat = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        """The ids of new pre-tokens, encoded joined: line by line, or (word) by blanks."""
        joined = [i for i, w in enumerate(words) if not w.isspace()]
        flat, lens = [], np.zeros(len(words), np.int64)
        got = {i: self._ids([w])[0] for i, w in enumerate(words) if w.isspace()}
        for k in range(0, len(joined), 1000):
            part = joined[k:k + 1000]
            if self.word:
                ids = np.array(self._ids([" ".join(words[i] for i in part)])[0], np.uint32)
                ends = np.flatnonzero(self.final[ids]) + 1
            else:
                ids = np.array(self._ids(["".join(words[i] + "\n" for i in part)])[0], np.uint32)
                stops = np.flatnonzero(ids == self.feed)
                ids, ends = np.delete(ids, stops), stops - np.arange(len(stops))
            if len(ends) != len(part):
                raise ValueError("the split pattern differs from the vocabulary's")
            lens[part] = np.diff(ends, prepend=0)
            flat.append(ids)
        if got:
            ids, parts = np.concatenate([*flat, np.zeros(0, np.uint32)]), []
            bounds = np.concatenate([[0], np.cumsum(lens)])
            for i in range(len(words)):
                parts.append(np.array(got[i], np.uint32) if i in got else ids[bounds[i]:bounds[i + 1]])
                lens[i] = len(parts[-1])
            flat = parts
        self.flat = np.concatenate([self.flat, *flat])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lens)])

    def _pieces(self, text: str):
        """Starts of all pieces, their hashes, and which are pre-tokens, of NUL-ended texts."""
        c = np.frombuffer(text.encode("utf-16-le"), np.uint16)
        if self.word:
            c = _LOWER[c]
        k = _CLASS[c]
        before = np.concatenate([[_SEP], k[:-1]]).astype(np.uint8)
        st = k != before
        if self.word:
            st |= (k == 2) | (k == _SEP)
            quote = (c == 39) & st
        else:
            blank = np.concatenate([[False], c[:-1] == 32])
            after = np.concatenate([k[1:], [_SEP]])
            st |= (k == _SEP) | ((k == _WS) & (after < _WS))
            st &= ~((k < _WS) & blank)
            quote = (c == 39) & st
        q = np.flatnonzero(quote)
        if len(q):
            pad = np.concatenate([c, np.zeros(3, np.uint16)])
            a, b = pad[q + 1], pad[q + 2]
            one = np.isin(a, [ord(x) for x in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            st[q[one | two] + 1] = False
            for n, hit in ((2, one), (3, two)):
                nxt = q[hit] + n
                st[nxt[k[nxt] == 1]] = True
        s = np.flatnonzero(st)
        size = np.diff(s, append=len(c))
        pos = np.arange(len(c)) - np.repeat(s, size)
        h = np.add.reduceat(_T[c] * multipliers(int(size.max()))[pos], s)
        first = k[s]
        return s, size, mix(h), (first < _WS) if self.word else (first != _SEP), first == _SEP

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        text = "\0".join(texts) + "\0"
        s, size, h, real, stop = self._pieces(text)
        key = h[real]
        row = self.table.get(key)
        if (row < 0).any():
            new, at = np.unique(key[row < 0], return_index=True)
            where = np.flatnonzero(real)[np.flatnonzero(row < 0)[at]]
            if self.table.n + len(new) > CACHE_WORDS:
                self._reset()
                new, at = np.unique(key, return_index=True)
                where = np.flatnonzero(real)[at]
                if len(new) > CACHE_WORDS:  # one text of so many words: by the library, past the cache
                    whole = [np.array(x, np.uint32) for x in self._ids(texts)]
                    return np.concatenate(whole), np.array([len(x) for x in whole], np.int64)
            self._learn([text[a:a + n] for a, n in zip(s[where].tolist(), size[where].tolist())])
            self.table.add(new)
            row = self.table.get(key)
        n = self.at[row + 1] - self.at[row]
        total = np.zeros(len(s), np.int64)
        total[real] = n
        ends = np.cumsum(total)
        begin = np.cumsum(n) - n
        ids = self.flat[np.repeat(self.at[row] - begin, n) + np.arange(int(n.sum()))]
        return ids, np.diff(ends[stop], prepend=0)

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, t in enumerate(texts) if _ODD.search(t)]
        if not odd:
            return self._plain(texts)
        skip = set(odd)
        ids, lens = self._plain([t for i, t in enumerate(texts) if i not in skip])
        whole = dict(zip(odd, self._ids([texts[i] for i in odd])))
        bounds, parts, at, out = np.concatenate([[0], np.cumsum(lens)]), [], 0, np.zeros(len(texts), np.int64)
        for i in range(len(texts)):
            if i in whole:
                parts.append(np.array(whole[i], np.uint32))
            else:
                parts.append(ids[bounds[at]:bounds[at + 1]])
                at += 1
            out[i] = len(parts[-1])
        return np.concatenate(parts), out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        done, part, size = [], [], 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size > CHUNK_CHARS:
                done.append(self._chunk(part))
                part, size = [], 0
        done.append(self._chunk(part))
        return np.concatenate([x for x, _ in done]), np.concatenate([n for _, n in done])


_HELD: dict[tuple[str, str, bool], CachedEncoder] = {}
_LIBC = ctypes.CDLL(None)


def encoder(path: str, kind: str, added: bool = False) -> CachedEncoder:
    """The encoder of this Python worker; tasks that share a worker share its cache."""
    if (path, kind, added) not in _HELD:
        _HELD[path, kind, added] = CachedEncoder(path, kind, added)
    return _HELD[path, kind, added]


def with_end(ids: np.ndarray, lens: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after each text's ids; the ids and the bounds of the texts."""
    bounds = np.concatenate([[0], np.cumsum(lens + 1)])
    out = np.full(int(bounds[-1]), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] - 1] = False
    out[keep] = ids
    return out, bounds


def slices(batches, column: str = "text", limit: int = 4_000_000):
    """Slices of batches that hold about ``limit`` bytes of ``column``, so that memory follows
    the bytes and not the row count of a batch (one very long text makes a slice of its own)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
        give_back()


def give_back() -> None:
    """Return freed memory to the system: the workers of an executor outlive their tasks, and what their allocators
    hold on to would count beside the memory of the next stage."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values).cast(kind) if values.dtype != kind.to_pandas_dtype() else pa.array(values, kind))


def binary_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each text's part of ``data`` as bytes; ``bounds`` count items of ``data``."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
