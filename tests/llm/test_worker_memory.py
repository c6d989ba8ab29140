"""What a Python worker holds while it works, and that working in parts changes no result."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tillroll.llm import langid, tokens


def texts(n, chars):
    rng = np.random.default_rng(3)
    letters = np.array([*"abcdefghijklmnopqrstuvwxyz   éß.\0\n"])
    return ["".join(rng.choice(letters, chars)) for _ in range(n)]


def test_counts_work_on_few_characters_at_once():
    some = texts(120, 5000)
    langid.counts(["warm"])
    tracemalloc.start()
    tf, letters = langid.counts(some)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6, peak
    whole, n = langid._counts(some)
    assert np.array_equal(tf, whole) and np.array_equal(letters, n)


def test_counts_of_odd_texts():
    some = [None, "", "x" * 250_000, "\0a\0", None, "b" * 99_999, "c", "12 34", "d e"]
    tf, letters = langid.counts(some)
    for i, t in enumerate(some):
        one, n = langid._counts([t])
        assert np.array_equal(tf[i], one[0]) and letters[i] == n[0]
    assert langid.counts([])[0].shape == (0, langid.DIMS)


def test_slices_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(tokens, "give_back", lambda: given.append(1))
    batches = [pa.RecordBatch.from_pydict({"text": ["ab"] * 5}) for _ in range(3)]
    assert [s.num_rows for s in tokens.slices(batches, limit=4)] == [2, 2, 1] * 3
    assert len(given) == 3
