"""Importance resampling of documents towards a target text, with an exact distributed cutoff.

1. Word n-grams are hashed into a fixed number of buckets (crc32 of their bytes). Bucket counts are
   summed over all documents and over all target texts; a bucket's gain is the floored scaled log
   ratio of the two smoothed shares. These arrays have ``buckets`` entries whatever the data.
2. A document's weight is the sum of its features' gains, looked up in the array of gains. Adding
   Gumbel noise drawn from its id makes "the k highest scores" a sample without replacement.
3. The k-th highest key (score, then smaller doc_id) is found by weighted median of medians: every
   chunk of at most ``CHUNK`` remaining keys reports its median, the driver takes the median of these
   weighted by the chunks' sizes as pivot, and the chunks count and report both sides. At least
   about a quarter of the keys goes each round. Only medians and counts reach the driver, and at
   the end the last ``rest`` keys at most.
4. Winners are ranged and sorted for their ranks; the others are not moved at all.

Cases: null texts and texts without words have no features and weight 0; rows without doc_id take no
part; rows that repeat a doc_id are documents of their own, ordered by n_features among themselves;
no rows give no rows, no target texts leave the smoothing alone; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.tokens import slices
from tillroll.llm.words import ALNUM, Words
from tillroll.operators.ranking import global_row_number
from tillroll.sources.stage import scratch_path, write_stage

#: Remaining keys that share one median.
CHUNK = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 48
#: The reflected CRC-32 polynomial (fixed value).
POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1)).astype(np.uint32)
    return t


_TABLE = _crc_table()


def crc_of_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """crc32 of each ``data[start:end]``, continued from the crc32 ``before`` it: one step a byte
    position for all words that have it."""
    crc = np.zeros(len(start), np.uint32) if before is None else before.copy()
    size = end - start
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        crc[i] = zlib.crc32(data[start[i]:end[i]].tobytes(), int(crc[i]))
    short = np.flatnonzero(size <= LONG_WORD)
    short = short[np.argsort(-size[short], kind="stable")]
    state, at, left = ~crc[short], start[short], size[short]
    upto = np.searchsorted(-left, -np.arange(1, LONG_WORD + 1), "right")  # how many words have a byte j
    for j, n in enumerate(upto.tolist()):
        if not n:
            break
        s = state[:n]
        state[:n] = _TABLE[(s ^ data[at[:n] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
    crc[short] = ~state
    return crc


def feature_buckets(texts: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every run of 1 to ``n`` words, and the number of words of each row."""
    w = Words(texts, ALNUM, True)
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    data = np.concatenate([fold[w.data], np.array([32], np.uint8)])
    crc = crc_of_words(data, w.start, w.end)
    rows, crcs = [w.doc], [crc]
    for k in range(1, n):
        on = np.flatnonzero(w.doc[:-k] == w.doc[k:]) if len(w.doc) > k else np.zeros(0, np.int64)
        space = np.full(len(on), len(data) - 1)
        crc = crc_of_words(data, space, space + 1, crc[on])
        crc = crc_of_words(data, w.start[on + k], w.end[on + k], crc)
        rows.append(w.doc[on])
        crcs.append(crc)
        full = np.zeros(len(w.doc), np.uint32)  # the next round continues the runs by their first word
        full[on] = crc
        crc = full
    return np.concatenate(rows), (np.concatenate(crcs) % np.uint32(buckets)).astype(np.int64), w.count


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How many features of all ``texts`` (column ``text``) fall into each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for part in slices(batches):
            total += np.bincount(feature_buckets(part.column(0), n, buckets)[1], minlength=buckets)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long")
    for b, c in counted.groupBy("bucket").agg(F.sum("n")).collect():  # a row a bucket at most
        out[b] = c
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over that of the raw features."""
    b = len(raw)
    share = (target + 1).astype(float) * float(raw.sum() + b)
    return np.floor(1000 * np.log(share / ((raw + 1).astype(float) * float(target.sum() + b)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        g = held.value
        for part in slices(batches):
            row, bucket, words = feature_buckets(part.column(1), n, len(g))
            features = np.bincount(row, minlength=part.num_rows)
            weight = np.zeros(part.num_rows, np.int64)
            np.add.at(weight, row, g[bucket])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words.astype(np.int64)), pa.array(features.astype(np.int64)), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u drawn from the id by sha256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10)
    u = (h.cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u))).cast("long")


Pair = tuple[int, int]


def _summary(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The number of keys and their lower median (0, 0 of none)."""
    if not len(a):
        return 0, 0, 0
    mid = np.lexsort((b, a))[(len(a) - 1) // 2]
    return len(a), int(a[mid]), int(b[mid])


def _report(keys: DataFrame, lo: Pair | None, hi: Pair | None, pivot: Pair | None) -> list:
    """What each chunk of the keys between ``lo`` and ``hi`` (both left out) says of ``pivot``: the number
    and median of smaller keys, the number of equal ones, the number and median of larger ones."""
    a, b = F.col("a"), F.col("b")
    if lo:
        keys = keys.where((a >= lo[0]) & ((a > lo[0]) | (b > lo[1])))
    if hi:
        keys = keys.where((a <= hi[0]) & ((a < hi[0]) | (b < hi[1])))

    def tell(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        if pivot is None:
            less, same = np.zeros(len(a), bool), np.zeros(len(a), bool)
        else:
            less = (a < pivot[0]) | ((a == pivot[0]) & (b < pivot[1]))
            same = (a == pivot[0]) & (b == pivot[1])
        more = ~(less | same)
        row = [*_summary(a[less], b[less]), int(same.sum()), *_summary(a[more], b[more])]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], ["ln", "la", "lb", "same", "mn", "ma", "mb"])

    def run(batches: Iterator[pa.RecordBatch]):
        held, n = [], 0
        for batch in batches:
            for x in range(0, batch.num_rows, CHUNK):
                part = batch.slice(x, CHUNK)
                held.append([part.column(i).to_numpy() for i in (0, 1)])
                n += part.num_rows
                if n >= CHUNK:
                    yield tell(*(np.concatenate(c) for c in zip(*held)))
                    held, n = [], 0
        if n:
            yield tell(*(np.concatenate(c) for c in zip(*held)))

    return keys.mapInArrow(run, "ln long, la long, lb long, same long, mn long, ma long, mb long").collect()


def weighted_median(medians: list[tuple[int, int, int]]) -> Pair:
    """The key at which half of the weight of (n, a, b) is reached."""
    ordered = sorted((a, b, n) for n, a, b in medians if n)
    half, seen = sum(x[2] for x in ordered) / 2, 0
    for a, b, n in ordered:
        seen += n
        if seen >= half:
            return a, b
    raise ValueError("no keys")


def kth_key(keys: DataFrame, k: int, rest: int = 4096) -> tuple[Pair, int]:
    """The ``k``-th smallest (from 1) of the keys (a, b), and the number of rounds it took. ``keys`` must be
    a written table; rows sorted within its files let a round skip what earlier rounds discarded."""
    told = _report(keys, None, None, None)
    lo = hi = None
    medians, left, rounds = [(r.mn, r.ma, r.mb) for r in told], sum(r.mn for r in told), 1
    if not 1 <= k <= left:
        raise ValueError(f"no {k}-th of {left} keys")
    while True:
        if left <= rest:
            a, b = F.col("a"), F.col("b")
            part = keys if lo is None else keys.where((a >= lo[0]) & ((a > lo[0]) | (b > lo[1])))
            part = part if hi is None else part.where((a <= hi[0]) & ((a < hi[0]) | (b < hi[1])))
            return tuple(sorted(tuple(r) for r in part.select("a", "b").collect())[k - 1]), rounds  # ``rest`` rows at most
        pivot = weighted_median(medians)
        told, rounds = _report(keys, lo, hi, pivot), rounds + 1
        less, same = sum(r.ln for r in told), sum(r.same for r in told)
        if k <= less:
            hi, left, medians = pivot, less, [(r.ln, r.la, r.lb) for r in told]
        elif k <= less + same:
            return pivot, rounds
        else:
            k -= less + same
            lo, left, medians = pivot, left - less - same, [(r.mn, r.ma, r.mb) for r in told]


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20,
             seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document. ``percent`` per cent
    of the documents of ``min_words`` words or more are drawn. ``target``: any table with a ``text``."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    scored = weigh(docs, gain, n).withColumn("score", F.col("weight") + gumbel(seed))
    # ascending keys: ~ turns the order of longs round without overflow
    order = [F.bitwise_not("score").alias("a"), F.col("doc_id").alias("b")]
    scored = write_stage(scored.sortWithinPartitions(F.desc("score"), "doc_id"), scratch_path(spark, "scored"))
    able = F.col("n_words") >= min_words
    k = percent * scored.where(able).count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    keys = write_stage(scored.where(able).select(*order), scratch_path(spark, "keys"))
    (a, b), _ = kth_key(keys, k)
    s = ~a
    won = able & ((F.col("score") > s) | ((F.col("score") == s) & (F.col("doc_id") <= b)))
    ranked, _ = global_row_number(scored.where(won).select(out), [F.desc("score"), F.asc("doc_id"), F.asc("n_features")], "rank")
    # rows that repeat the last key may be more than k
    ranked = ranked.select(*out, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~won).select(*out, F.lit(None).cast("long").alias("rank")))
