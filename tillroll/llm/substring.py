"""Removal of repeated word sequences with a compressed FM-index per shard.

A window (``n`` consecutive words) that already starts earlier in the corpus is removed with all its
words. Windows are routed to shards by their minimizer (the smallest hash of their grams of
``GRAM`` words): equal windows have equal minimizers, so they meet in one shard, and a run of
neighbouring windows with one minimizer travels as one fragment.

1. Every document gives a light row for each fragment. Minimizers that occur once in the corpus
   cannot hold a repeated window; their rows go (counts are pre-aggregated).
2. Equal fragments are pre-aggregated to their first instance. All windows of a later instance are
   repeated; nothing of it is indexed. First instances whose minimizer has another fragment are
   fetched with their words.
3. Each shard orders its fragments' suffixes, builds BWT and wavelet matrix, and streams the
   fragments through a backward search. The matching statistics tell, where they reach ``n``, the
   interval of all places of the window; the first of them stays, the others are repeated.
4. A minimizer with more than ``HOT`` different fragments (a passage that a large part of the corpus
   quotes in different surroundings) is spread over the cluster by window hash and judged by a
   pre-aggregated minimum instead: exact as well, and no task holds it.
5. The covered words of each document are dropped.

Cases: null and empty texts have no words; fewer words than a window never repeat; rows that
repeat a doc_id count as one document, with the smallest text; rows without doc_id are left out; no
rows give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.fmindex import FMIndex
from tillroll.llm.sift import sift
from tillroll.llm.split import join_split
from tillroll.llm.tokens import mix, slices
from tillroll.llm.words import UNSPACED, Words, ranges, rolled
from tillroll.sources.stage import scratch_path, write_stage

WINDOW, GRAM = 20, 5
#: Windows of a fragment, fragments of one minimizer in a shard, words of one index.
LONGEST, HOT, SHARD_WORDS = 64, 20_000, 500_000


class Fragments:
    """The fragments of a batch of texts: ``doc`` (row), ``start`` (word of the row), ``n``
    (windows), ``m`` (minimizer), ``hash`` (of all words) and ``again`` (the minimizer occurs more
    than once inside)."""

    def __init__(self, texts: pa.Array, n: int):
        self.words = w = Words(texts, UNSPACED, False)
        grams = mix(rolled(w.hash, GRAM))
        per, low = n - GRAM + 1, grams
        step = 1
        while step < per:  # sliding minimum of ``per`` grams by doubling
            hop = min(step, per - step)
            low = np.minimum(low[:len(low) - hop], low[hop:]) if len(low) > hop else low[:0]
            step += hop
        win = np.maximum(w.count - n + 1, 0)
        place = ranges(w.first, win)
        key, row = low[place] if len(place) else np.zeros(0, np.uint64), np.repeat(np.arange(len(win)), win)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        size = np.diff(first, append=len(key))
        cuts = -(-size // LONGEST)
        at = np.repeat(first, cuts) + (np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * LONGEST
        self.n = np.minimum(np.repeat(first + size, cuts) - at, LONGEST)
        self.doc, self.m, self.place = row[at], key[at], place[at]
        self.start = self.place - w.first[self.doc]
        # the hash of a fragment sums its windows' hashes, weighted by their places
        each = mix(rolled(w.hash, n))[place] if len(place) else np.zeros(0, np.uint64)
        bounds = np.concatenate([at, [len(key)]])
        self.hash = mix(np.add.reduceat(each * (np.arange(len(each)) - np.repeat(at, np.diff(bounds)) + 1).astype(np.uint64), at)) if len(at) else np.zeros(0, np.uint64)
        count = self.n + per - 1  # grams of the fragment
        hits = grams[ranges(self.place, count)] == np.repeat(self.m, count) if len(at) else np.zeros(0, bool)
        self.again = np.add.reduceat(hits.astype(np.int64), np.cumsum(count) - count) > 1 if len(at) else np.zeros(0, bool)


def _light(docs: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for p in slices(batches, limit=2_000_000):
            f = Fragments(p.column(1), n)
            yield pa.RecordBatch.from_arrays(
                [p.column(0).take(pa.array(f.doc)), pa.array(f.start.astype(np.int64)), pa.array(f.n.astype(np.int32)), pa.array(f.m.view(np.int64)),
                 pa.array(f.hash.view(np.int64)), pa.array(f.again)], ["doc_id", "start", "n", "m", "hash", "again"])

    return docs.mapInArrow(run, "doc_id long, start long, n int, m long, hash long, again boolean")


def _content(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The word hashes of ``wanted`` fragments (doc_id, starts)."""

    def run(batches):
        for p in slices(batches, limit=2_000_000):
            f = Fragments(p.column(1), n)
            asked = [set(x) for x in p.column(2).to_pylist()]
            on = np.array([s in asked[d] for d, s in zip(f.doc.tolist(), f.start.tolist())], bool)
            rows = np.flatnonzero(on)
            h = f.words.hash
            yield pa.RecordBatch.from_arrays(
                [p.column(0).take(pa.array(f.doc[rows])), pa.array(f.start[rows].astype(np.int64)), pa.array(f.m[rows].view(np.int64)), pa.array(f.hash[rows].view(np.int64)),
                 pa.array([h[a:a + k].tobytes() for a, k in zip(f.place[rows].tolist(), (f.n[rows] + n - 1).tolist())], pa.binary())],
                ["doc_id", "start", "m", "hash", "words"])

    return sift(docs, wanted).join(wanted, "doc_id").select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, start long, m long, hash long, words binary")


def repeated(docs: np.ndarray, starts: np.ndarray, words: list[np.ndarray], n: int) -> list[list[int]]:
    """For each fragment of a shard the windows that start earlier in another place of the shard."""
    size = np.array([len(w) for w in words])
    known, codes = np.unique(np.concatenate(words), return_inverse=True)
    end = np.cumsum(size + 1) - 1  # one place after each fragment holds the end code 0
    begin = end - size
    text = np.zeros(int(end[-1]) + 1, np.int64)
    text[ranges(begin, size)] = codes.ravel() + 1
    index = FMIndex(text, n)
    place, suffix = index.windows(begin, end)
    frag = np.searchsorted(end, place, "right")
    off = place - begin[frag]
    rank = np.lexsort((starts[frag] + off, docs[frag]))
    turn = np.full(len(text), len(text), np.int64)
    turn[place[rank]] = np.arange(len(rank))
    group, _, which = index.full
    least = np.minimum.reduceat(turn[index.order], group)
    late = least[which[suffix]] < turn[place]
    out: list[list[int]] = [[] for _ in words]
    for f, o in zip(frag[late].tolist(), off[late].tolist()):
        out[f].append(o)
    return out


def _shards(content: DataFrame, n: int) -> DataFrame:
    """m, hash and the repeated windows (offsets) of first instances."""

    def run(batches):
        held, total, last = [], 0, None

        def out():
            found = repeated(np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64), [np.frombuffer(x[4], np.uint64) for x in held], n)
            return pa.RecordBatch.from_arrays(
                [pa.array([x[2] for x in held], pa.int64()), pa.array([x[3] for x in held], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["m", "hash", "late"])

        for p in batches:
            for row in zip(*(p.column(i).to_pylist() for i in range(5))):
                if held and row[2] != last and total >= SHARD_WORDS:
                    yield out()
                    held, total = [], 0
                held.append(row)
                total += len(row[4]) // 8
                last = row[2]
        if held:
            yield out()

    return content.repartition("m").sortWithinPartitions("m", "doc_id", "start").mapInArrow(run, "m long, hash long, late array<long>")


def _spread(content: DataFrame, n: int) -> DataFrame:
    """As ``_shards``, for hot minimizers: the first place of each window by a pre-aggregated minimum."""

    def run(batches):
        for p in batches:
            for doc, start, m, h, words in zip(*(p.column(i).to_pylist() for i in range(5))):
                w = np.frombuffer(words, np.uint64)
                a, b = rolled(w, n), rolled(w, n, 1)
                k = len(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x] * k, pa.int64()) for x in (m, h, doc)] + [pa.array(start + np.arange(k)), pa.array(np.arange(k)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                    ["m", "hash", "doc_id", "at", "off", "a", "b"])

    win = content.mapInArrow(run, "m long, hash long, doc_id long, at long, off long, a long, b long")
    least = win.groupBy("a", "b").agg(F.min(F.struct("doc_id", "at")).alias("least"))
    late = win.join(least, ["a", "b"]).where(F.struct("doc_id", "at") > F.col("least"))
    return late.groupBy("m", "hash").agg(F.collect_list("off").alias("late"))  # LONGEST at most


def spans(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id and late: (window, windows) runs of repeated windows, of the documents that have any."""
    spark = docs.sparkSession
    stage = lambda df, name: write_stage(df, scratch_path(spark, name))
    light = stage(_light(docs, n), "light")
    often = light.groupBy("m").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("w")).where("w > 1")
    flagged = stage(join_split(light, stage(often, "often"), "m", "w"), "fragments")
    first = stage(flagged.groupBy("m", "hash").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.max("again").alias("again")), "instances")
    kinds = stage(first.groupBy("m").agg(F.count("*").alias("kinds")), "kinds")
    first = stage(join_split(first, kinds, "m", "kinds").select("m", "hash", "f.doc_id", "f.start", "again", "kinds"), "first")
    wanted = first.where("kinds > 1 or again")
    content = write_stage(_content(docs, wanted.groupBy("doc_id").agg(F.collect_list("start").alias("starts")), n)
                          .join(wanted.select("m", "hash", F.col("kinds").alias("k")), ["m", "hash"]).select("doc_id", "start", "m", "hash", "words", "k"),
                          scratch_path(spark, "content"))
    columns = ["doc_id", "start", "m", "hash", "words"]
    found = _shards(content.where(F.col("k") <= HOT).select(columns), n)
    if content.where(F.col("k") > HOT).head(1):
        found = found.unionByName(_spread(content.where(F.col("k") > HOT).select(columns), n))
    judged = first.select("m", "hash", F.struct("doc_id", "start").alias("f")).join(found, ["m", "hash"], "left")
    own = flagged.join(judged, ["m", "hash"]).withColumn("later", F.struct("doc_id", "start") != F.col("f"))
    runs = F.when(F.col("later"), F.array(F.struct(F.col("start").alias("at"), F.col("n").cast("long").alias("n")))).otherwise(
        F.transform("late", lambda o: F.struct((F.col("start") + o).alias("at"), F.lit(1).cast("long").alias("n"))))
    return own.where(F.col("later") | (F.size("late") > 0)).select("doc_id", runs.alias("late")).groupBy("doc_id").agg(F.flatten(F.collect_list("late")).alias("late"))


def one_row_per_id(docs: DataFrame) -> DataFrame:
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if docs.groupBy("doc_id").count().where("count > 1").head(1):
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs


def dedup(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space). A window has at
    least ``GRAM`` words."""
    if n < GRAM:
        raise ValueError(f"a window of {n} words is shorter than a gram of {GRAM}")
    docs = one_row_per_id(docs)

    def run(batches):
        for p in slices(batches, limit=4_000_000):
            w = Words(p.column(1), UNSPACED, False)
            raw, kept, gone = w.data.tobytes(), [], []
            for a, k, late in zip(w.first.tolist(), w.count.tolist(), p.column(2).to_pylist()):
                cover = np.zeros(k + 1, np.int64)
                for x in late or ():
                    cover[x["at"]] += 1
                    cover[x["at"] + x["n"] + n - 1] -= 1
                on = np.flatnonzero(np.cumsum(cover[:-1]) == 0) + a
                gone.append(k - len(on))
                kept.append(b" ".join([raw[s:e] for s, e in zip(w.start[on].tolist(), w.end[on].tolist())]).decode())
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(w.count, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.join(spans(docs, n), "doc_id", "left").select("doc_id", "text", "late").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
