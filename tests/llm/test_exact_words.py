"""Words that weak hashes take for one another, and texts with more words than the encoder's cache."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tillroll.llm import tokens, words
from tillroll.llm.queries import vocabulary

MORSE = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
SWAPPED = MORSE.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_word_hashes_tell_morse_words_apart(n):
    w = words.Words(pa.array([f"{MORSE[:n]} {SWAPPED[:n]}"]), words.UNSPACED, True)
    assert w.hash[0] != w.hash[1]


def test_word_hashes_see_every_place():
    base = "ab" * 70_000  # places beyond 65,536 have multipliers of their own
    moved = "ba" + base[2:65_536] + "ab" + base[65_538:]
    swapped = "b" + base[1:65_536] + "a" + base[65_537:]
    w = words.Words(pa.array([" ".join([base, moved, swapped, base, base + "a"])]), words.UNSPACED, True)
    assert w.hash[0] == w.hash[3] and len(np.unique(w.hash)) == 4


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder_past_its_cache(monkeypatch, name, kind):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 500)
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 2000)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    texts = ["short text", " ".join(word() for _ in range(3000)), None, "", "it's " * 50, MORSE[:1024], SWAPPED[:1024], " ".join(word() for _ in range(100))]
    enc = tokens.CachedEncoder(vocabulary(name), kind, True)
    want = [Tokenizer.from_file(vocabulary(name)).encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # with an empty and a used cache
        ids, lens = enc.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == want
