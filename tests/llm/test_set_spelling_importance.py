"""op11 to op13 against brute force on small, awkward tables: nulls, empty and very long texts, ties,
repeated rows, clashing column names, empty tables, families of near copies."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tillroll.llm import importance, setjoin, spelling
from tillroll.llm.ship import ship
from tillroll.sources.stage import scratch_path, write_stage

LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, texts, first=0):
    """A documents table with columns whose names clash with those of the operators."""
    ship(spark)
    rows = [(first + i, t, "en", "src", i, 0.5, 7, "a") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, score double, rank int, word string").repartition(5)


def awkward():
    rng = random.Random(5)
    vocab = ["the", "of", "Étude", "it's", "x1", "2024", "naïve", "über", "Σίσυφος", "漢字", "é"] + [f"w{i}" for i in range(50)]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = make(150), make(40)
    out = [None, "", " \n", "one", "ONE", "one two", "one  two", "a a " * 40, make(6000), "x" * 70_000 + " y z", "x" * 70_001 + " y z"]
    out += [make(rng.randrange(1, 90)) for _ in range(30)]
    out += [make(12) + " " + passage + " " + make(12) for _ in range(8)]
    out += [base, base.upper(), base + " tail", "head " + base, base.replace("w7 ", "changed ", 1)]
    words = base.split()
    for _ in range(25):  # near copies of one text, many of them linked by others only
        w = list(words)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
        out.append(" ".join(w))
    # differ in words that sums of powers modulo 2^64 cannot tell apart
    morse = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    swapped = morse.translate(str.maketrans("ab", "ba"))
    return out + [morse, swapped, f"p q {morse}", f"p q {swapped}"]


def linked(texts, k, percent):
    """Brute force over {doc_id: text}: set size and the smallest doc_id reachable."""
    sets = {}
    for d, t in texts.items():
        w = SPACED.findall((t or "").encode().translate(LOW))
        sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    group = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and group[a] != group[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    keep, gone = sorted((group[a], group[b]))
                    group = {d: keep if g == gone else g for d, g in group.items()}
    return sorted((d, len(sets[d]), group[d]) for d in sets)


@pytest.mark.parametrize("k,percent,heavy,block", [(3, 90, 1 << 16, 512), (3, 90, 6, 4), (2, 80, 6, 512), (1, 55, 1 << 16, 3)])
def test_op11(spark, monkeypatch, k, percent, heavy, block):
    for name, value in (("HEAVY", heavy), ("BLOCK", block), ("GROUP", 3), ("CHUNK", 50)):
        monkeypatch.setattr(setjoin, name, value)
    texts = dict(enumerate(awkward()))
    got = sorted(tuple(r) for r in setjoin.group(frame(spark, list(texts.values())), k, percent).collect())
    assert got == linked(texts, k, percent)


def test_op11_by_relation(spark):
    """The last step alone finds the links of given pairs, whether a set has a linked lead or not."""
    texts = dict(enumerate(awkward()))
    ids = sorted(texts)
    near = spark.createDataFrame([(d, 50) for d in range(55, 70)], "doc_id long, lead long")
    pairs = spark.createDataFrame([(a, b, 0, 0) for a in ids for b in ids if a < b], "a long, b long, na long, nb long")
    docs = frame(spark, list(texts.values()))
    got = {(min(r), max(r)) for r in map(tuple, setjoin._by_relation(pairs, near, docs.select("doc_id", "text"), 3, 90).collect())}
    sets = {d: x for d, x in zip(ids, setjoin.shingle_sets(docs.orderBy("doc_id").toArrow().column("text").combine_chunks(), 3))}
    want = set()
    for a in ids:
        for b in ids:
            both = len(np.intersect1d(sets[a], sets[b]))
            if a < b and both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                want.add((a, b))
    assert {p for p in got if len(sets[p[0]]) and len(sets[p[1]])} == want and len(want) > 20


def test_op11_repeats_and_empty(spark):
    docs = frame(spark, ["a b c d", "a b c d", None])
    rows = docs.unionByName(docs).unionByName(docs.selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
    assert sorted(tuple(r) for r in setjoin.group(rows, 3, 90).collect()) == [(0, 2, 0), (1, 2, 0), (2, 0, 2)]
    assert setjoin.group(docs.where("false"), 3, 90).collect() == []
    assert sorted(tuple(r) for r in setjoin.group(docs.where("text is null"), 3, 90).collect()) == [(2, 0, 2)]


def near_words(counts):
    """Brute force: near words of each word."""
    def one_apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    return {w: [x for x in counts if one_apart(w, x)] for w in counts}


def variants(counts):
    near, form = near_words(counts), {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def misspelt(texts):
    counts = Counter()
    for d, t in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.encode().translate(LOW).decode()
            h = zlib.crc32(f"{d}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_op12(spark):
    rng = random.Random(8)
    base = ["colour", "color", "colours", "aaaaa", "aaaaaa", "baaaaa", "Straße", "naïveté", "ÉCOLES", "École", "écoles", "×÷×÷×", "letter", "leter", "lettter"]
    text = lambda: " ".join(rng.choice(base) + rng.choice(["", "", "", "s", "x"]) for _ in range(rng.randrange(0, 60)))
    texts = [None, "", "12 34", "z" * 30_000 + " end"] + [text() for _ in range(150)] + ["k" * 40_000 + " " + "k" * 39_999 + "j"] * 3 + ["漢字word漢字wordy"] * 4
    got = spelling.variants(spelling.word_counts(frame(spark, texts))).select("word", "form", "root", "n", "n_near", "form_n")
    want = variants(misspelt(dict(enumerate(texts))))
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) > 20


def test_op12_chains_ties_and_empty(spark):
    """Long chains of forms, ties of n by code point, letters beyond 16 bits, many partitions."""
    rng = random.Random(2)
    counts = {"a" * i: 2**i for i in range(1, 40)}
    counts |= {"ab" + c + "cd": 9 for c in "xyzàÿ𝒳𝒴"} | {"abcd": 2, "": 3, "x": 1}
    counts |= {"".join(rng.choice("mn") for _ in range(rng.randrange(1, 9))): rng.randrange(1, 60) for _ in range(300)}
    ship(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("1", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            table = spark.createDataFrame([(w, n, 5) for w, n in counts.items()], "word string, n long, wid int").repartition(7)
            got = spelling.variants(table).select("word", "form", "root", "n", "n_near", "form_n").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert sorted(map(tuple, got), key=repr) == variants(counts)
    assert spelling.variants(table.where("false")).collect() == []


def resampled(texts, target, n, buckets, percent, min_words):
    """Brute force over [(doc_id, text)]."""
    def features(t):
        w = ALNUM.findall((t or "").encode().translate(LOW))
        return [zlib.crc32(b" ".join(w[i:i + k])) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)

    raw, goal = Counter(), Counter()
    for _, t in texts:
        raw.update(features(t)[0])
    for t in target:
        goal.update(features(t)[0])
    s, t = sum(raw.values()), sum(goal.values())
    gain = {b: math.floor(1000 * math.log((goal[b] + 1.0) * (s + buckets) / ((raw[b] + 1.0) * (t + buckets)))) for b in raw}
    rows = []
    for d, text in texts:
        own, words = features(text)
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append((d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0], r[1]))
    drawn = able[:percent * len(able) // 100]
    return sorted([(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in rows if r[4] < min_words] + [(*r[:4], None) for r in able[len(drawn):]], key=repr)


@pytest.mark.parametrize("n,buckets,percent,min_words", [(1, 10_000, 10, 20), (2, 50, 40, 1), (3, 7, 100, 0)])
def test_op13(spark, n, buckets, percent, min_words):
    texts, target = awkward(), ["the of w3 w4", None, "", "Étude x1 x1", "the of w3 w4"]
    table = frame(spark, texts)
    goal = frame(spark, target)
    got = importance.resample(table, goal, n, buckets, percent, min_words)
    assert sorted(map(tuple, got.collect()), key=repr) == resampled(list(enumerate(texts)), target, n, buckets, percent, min_words)


def test_op13_repeats_and_empty(spark):
    texts = awkward()
    docs = frame(spark, texts)
    twice = docs.unionByName(docs).unionByName(docs.selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
    got = importance.resample(twice, docs, percent=33, min_words=3)
    assert sorted(map(tuple, got.collect()), key=repr) == resampled(list(enumerate(texts)) * 2, texts, 1, 10_000, 33, 3)
    none = docs.where("false")
    assert importance.resample(none, docs).collect() == []
    alone = importance.resample(docs, none, min_words=5)
    assert sorted(map(tuple, alone.collect()), key=repr) == resampled(list(enumerate(texts)), [], 1, 10_000, 10, 5)


def test_op13_cutoff(spark, monkeypatch):
    """Weighted median of medians finds every key, with ties, and in rounds that grow with the logarithm."""
    monkeypatch.setattr(importance, "CHUNK", 37)
    ship(spark)
    rng = np.random.default_rng(1)
    a = rng.integers(-5, 5, 2000) * 10**17
    keys = sorted(zip(a.tolist(), rng.permutation(2000).tolist()))
    table = spark.createDataFrame(keys, "a long, b long").repartition(6).sortWithinPartitions("a", "b")
    table = write_stage(table, scratch_path(spark, "keys"))
    for k in (1, 2, 777, 1999, 2000):
        key, rounds = importance.kth_key(table, k, rest=1)
        assert key == keys[k - 1] and rounds <= 25
    with pytest.raises(ValueError):
        importance.kth_key(table, 2001)


def test_crc_of_words():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = rng.integers(0, 4900, 300)
    end = start + rng.integers(0, 100, 300)
    assert importance.crc_of_words(data, start, end).tolist() == [zlib.crc32(data[s:e].tobytes()) for s, e in zip(start, end)]
