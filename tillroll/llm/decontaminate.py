"""Benchmark decontamination as a prefix-filtered set join on word shingles.

A window (``n`` consecutive words of a benchmark item; the whole item if it is shorter) is taken
as the set of its positioned shingles of three words (fewer in shorter windows). Containment of a
whole window asks for all of its shingles, so by the prefix principle one token is enough to
probe: the rarest, by the counts of the benchmark's shingles in all documents.

1. The benchmark's windows, with their words' hashes and shingles, are a written table.
2. The first pass over the documents counts in how many of them each shingle of a window stands. A
   Bloom filter of a fixed size keeps most other shingles out of the counts.
3. A window's rarest shingle, by these counts, is its prefix token (``min`` over its shingles). A
   window with a shingle that no document has occurs nowhere and goes.
4. The second pass sends the places of possible prefix tokens, with the ``n - 1`` words on either
   side, to the windows of that token. The length and positional bounds (the window must lie inside
   the document around the shared shingle) come first, then the words are compared one by one.
5. Occurrences are kept by the hashes of the text, so copies of a text are judged once, and joined
   back to the documents as one row a text.

A window of fewer than ``COMMON_WORDS`` words is one shingle, so the first pass tells in how many
documents it stands; ``common`` ones are shown in at least ``COMMON_DOCS`` documents and in more
than ``COMMON_SHARE`` of all. Windows of more words are never common.

No item, window or count is on the driver: it gathers the filters (2 MB each, whatever the data)
and the sizes of shingles that occur (three at most). The prefix tokens are broadcast if their
windows have no more than ``MAX_INDEX_WORDS`` words, and else joined in a shuffle of written
tables. There are two passes over the documents, and a third for the result, whatever the benchmark.

Cases: null texts have no words; items without words or without item_id have no windows;
repeated items count once; documents that repeat a doc_id are judged one by one; empty tables give
empty or clean results; other columns of the documents pass through ``mark``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.tokens import slices
from tillroll.llm.words import ALNUM, Words, ranges, rolled
from tillroll.sources.stage import scratch_path, write_stage

WINDOW, SHINGLE = 10, 3
#: Whole items of fewer words (a single shingle) that stand in so many documents, and in more than this share of all, are common.
COMMON_WORDS, COMMON_DOCS, COMMON_SHARE = SHINGLE + 1, 10, 0.001
#: Words of the windows whose prefix tokens are broadcast at once (about 10 MB); beyond that they are shuffled.
MAX_INDEX_WORDS = 500_000
#: Bits of a filter, two a hash. With far more hashes than bits it lets everything pass, and the joins do the work alone.
BITS = 1 << 24
#: Places that a task sends in one batch.
BATCH = 50_000
#: The words of ALNUM in a text.
WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"


def _lists(flat: np.ndarray, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(flat.view(np.int64)))


def _windows(benchmark: DataFrame, n: int) -> DataFrame:
    """A row for every window of every item: item_id, w1 and w2 (its identity), size, its words' hashes
    and the hashes of its shingles by place."""

    def run(batches):
        for part in slices(batches):
            w = Words(part.column(1), ALNUM, True)
            per = np.where(w.count > 0, np.maximum(w.count - n + 1, 1), 0)
            item, start = np.repeat(np.arange(part.num_rows), per), ranges(w.first, per)
            size = np.minimum(w.count[item], n)
            for m in np.unique(size).tolist():
                rows = np.flatnonzero(size == m)
                short, one = min(m, SHINGLE), np.ones(len(rows), np.int64)
                words = w.hash[ranges(start[rows], one * m)]
                ids = [rolled(words, m, which)[::m] for which in (0, 1)]
                shingles = rolled(w.hash, short)[ranges(start[rows], one * (m - short + 1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(item[rows])), *(pa.array(x.view(np.int64)) for x in ids), pa.array(size[rows], pa.int32()),
                     _lists(words, one * m), _lists(shingles, one * (m - short + 1))],
                    ["item_id", "w1", "w2", "size", "words", "shingles"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.where("item_id is not null and text is not null").mapInArrow(run, "item_id string, w1 long, w2 long, size int, words array<long>, shingles array<long>")


def _filter(hashes: DataFrame):
    """A broadcast Bloom filter of the hashes ``h``."""
    places = F.array(F.col("h").bitwiseAND(BITS - 1), F.shiftrightunsigned("h", 32).bitwiseAND(BITS - 1))
    words = (hashes.select(F.explode(places).alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("bits")))
    held = np.zeros(BITS // 64, np.uint64)
    for b in words.toArrow().to_batches():  # BITS / 64 rows at most
        held[b.column(0).to_numpy()] = b.column(1).to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(held)


def _passing(bits: np.ndarray, w: Words, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shingles of ``m`` words that may be in the filter and lie in one text, and their hashes."""
    h, mask = rolled(w.hash, m), np.uint64(64 * len(bits) - 1)
    ok = np.ones(len(h), bool)
    for p in (h & mask, h >> np.uint64(32) & mask):
        ok &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    at = np.flatnonzero(ok)
    at = at[w.doc[at] == w.doc[at + m - 1]]
    return at, h[at]


def _counts(docs: DataFrame, sent, sizes: list[int]) -> DataFrame:
    """h, n: documents that hold the shingle, for all shingles of the filter (and some others); n of
    the null h is the number of documents."""

    def run(batches):
        bits = sent.value
        for part in slices(batches):
            out, w = [], Words(part.column(0), ALNUM, True) if sizes else None
            for m in sizes:
                at, h = _passing(bits, w, m)
                known, row = np.unique(h, return_inverse=True)
                each = np.unique(w.doc[at] * max(len(known), 1) + row)  # a document counts once
                out.append((known, np.bincount(each % max(len(known), 1), minlength=len(known))))
            h = [x for known, _ in out for x in known.view(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([None, *h], pa.int64()), pa.array([part.num_rows, *(x for _, n in out for x in n.tolist())], pa.int64())], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _places(texts: DataFrame, sent, sizes: list[int], n: int) -> DataFrame:
    """Places of possible prefix tokens in the texts (k1, k2): h, pos (word number), ``lead`` words
    before it in ``near`` and up to ``n`` from it on."""

    def run(batches):
        bits = sent.value
        for part in slices(batches):
            w = Words(part.column(2), ALNUM, True) if sizes else None
            for m in sizes:
                every, hashes = _passing(bits, w, m)
                for i in range(0, len(every), BATCH):
                    at, doc = every[i:i + BATCH], w.doc[every[i:i + BATCH]]
                    pos = at - w.first[doc]
                    lead = np.minimum(pos, n - 1)
                    count = lead + np.minimum(w.count[doc] - pos, n)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), pa.array(hashes[i:i + BATCH].view(np.int64)), pa.array(pos),
                         pa.array(lead, pa.int32()), _lists(w.hash[ranges(at - lead, count)], count)],
                        ["k1", "k2", "h", "pos", "lead", "near"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, h long, pos long, lead int, near array<long>")


def occurrences(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Occurrences of windows in texts (k1, k2: ``text_key``; start, size, w1, w2, common), and the
    items (item_id) of each window (w1, w2). Both are written tables."""
    spark = docs.sparkSession
    if n > 64:
        raise ValueError("windows of more than 64 words")
    stage = lambda df, name: write_stage(df, scratch_path(spark, name))
    raw = stage(_windows(benchmark, n), "windows")
    owners = stage(raw.select("w1", "w2", "item_id").distinct(), "owners")
    windows = stage(raw.groupBy("w1", "w2").agg(F.any_value(F.struct("size", "words", "shingles")).alias("x")).select("w1", "w2", "x.*"), "windows")
    sizes = sorted(r[0] for r in windows.select(F.least("size", F.lit(SHINGLE))).distinct().collect())  # three rows at most
    shingles = windows.select("w1", "w2", "size", F.posexplode("shingles").alias("place", "h"))
    counts = stage(_counts(docs, _filter(shingles.select("h").distinct()), sizes), "counts")
    documents = counts.where("h is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select("n").scalar()
    rare = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "place")).alias("rare")
    common = (F.col("size") < COMMON_WORDS) & (F.col("n") >= COMMON_DOCS) & (F.col("n") > COMMON_SHARE * documents)
    tokens = shingles.join(counts, "h", "left").groupBy("w1", "w2").agg(rare).select("w1", "w2", "rare.*").where("n > 0")
    tokens = stage(tokens.join(windows.select("w1", "w2", "size", "words"), ["w1", "w2"]).withColumn("common", common).drop("n"), "tokens")

    texts = docs.select("text", *[x.alias(k) for x, k in zip(text_key(F.col("text")), ("k1", "k2"))])
    places = _places(texts, _filter(tokens.select("h").distinct()), sizes, n)
    if (tokens.agg(F.sum("size")).first()[0] or 0) <= MAX_INDEX_WORDS:
        met = places.join(F.broadcast(tokens), "h")
    else:  # written, so that Spark can split a hot token
        met = stage(places, "places").join(tokens, "h")
    inside = (F.col("lead") >= F.col("place")) & (F.size("near") >= F.col("lead") - F.col("place") + F.col("size"))
    same = F.slice("near", F.col("lead") - F.col("place") + 1, F.col("size")) == F.col("words")
    met = met.where(inside).where(same).select("k1", "k2", (F.col("pos") - F.col("place")).alias("start"), "size", "w1", "w2", "common")
    return stage(met.distinct(), "met"), owners


def text_key(text):
    """Two independent hashes that stand for a text."""
    return F.xxhash64(text), F.xxhash64(F.lit(6), text)


def _marks(met: DataFrame, owners: DataFrame) -> DataFrame:
    """One row a text with occurrences: hit_spans, hit_items, telling_items."""
    key = ["k1", "k2"]
    ends = met.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    by_start = Window.partitionBy(*key).orderBy("start")  # at most the words of one text
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("new", (reached.isNull() | (F.col("start") > reached)).cast("int")).withColumn("run", F.sum("new").over(by_start))
    spans = ends.groupBy(*key, "run").agg(F.min("start").alias("from"), F.max("end").alias("to"))
    spans = spans.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("hit_spans"))
    items = met.select(*key, "w1", "w2", "common").distinct().join(owners, ["w1", "w2"]).groupBy(*key, "item_id").agg(F.bool_and("common").alias("common"))
    telling = F.when(~F.col("common"), F.col("item_id"))
    items = items.groupBy(*key).agg(F.sort_array(F.collect_list("item_id")).alias("hit_items"), F.sort_array(F.collect_list(telling)).alias("telling_items"))
    return spans.join(items, key)


def mark(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, hit_spans (from, to: word numbers, end excluded, merged), hit_items
    (item_ids as strings, sorted) and telling_items (those with a window here that is not common)."""
    added = ["n_words", "hit_spans", "hit_items", "telling_items"]
    docs = docs.drop(*added).withColumn("text", F.col("text").cast("string"))
    marks = _marks(*occurrences(docs, benchmark, n))
    marks = write_stage(marks, scratch_path(docs.sparkSession, "marks"))  # its size tells Spark whether to broadcast it
    keys = ["k1", "k2"]
    while set(keys) & set(docs.columns):
        keys = [f"_{k}" for k in keys]
    keyed = docs.select(*docs.columns, *[x.alias(k) for x, k in zip(text_key(F.col("text")), keys)])
    both = keyed.join(marks.withColumnsRenamed(dict(zip(("k1", "k2"), keys))), keys, "left")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    none = {c: F.array().cast(marks.schema[c].dataType) for c in added[1:]}
    return both.select(*docs.columns, words.alias("n_words"), *[F.coalesce(c, none[c]).alias(c) for c in added[1:]])


def digests(marked: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    return marked.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
