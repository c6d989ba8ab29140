"""Groups of spelling variants by a dictionary of trie-node pairs.

1. The words, sorted by code points in range partitions, are one forward trie: a word takes the
   nodes of the letters that it shares with the word before it and numbers new ones for the rest.
   The trie of the reversed words is numbered likewise. No prefix is ever written out, so a word of a
   million letters costs a million numbers. A partition's first word continues words of the
   partitions before it; the first and last word of each partition say which of its nodes these are.
2. A word of length L stands at L + 1 pairs (node before the gap, node behind it) and at L pairs with
   one letter skipped. Equal numbers are equal strings, so the pairs are exact: two words at one
   skipped pair differ in that letter, and a word at the pair that another reaches by skipping a
   letter lacks that letter. A deletion counts at the first letter of a run of equal letters only, so
   each two near words meet exactly once.
3. At one pair stand at most one word without a gap and one word for each letter of the alphabet, so
   the windows over a pair are bounded by the alphabet, however many words there are.
4. A word's form is its best near word; forms grow in n, so following them ends. Chains are at
   most log2 of the largest n long, and pointer doubling needs log2 of that in rounds.

Cases: null texts have no words; rows without doc_id are left out; rows that repeat a doc_id count each;
no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.sources.stage import scratch_path, write_stage

#: Bits of a number within its partition.
LOCAL = 40
#: Nodes in one batch that a task gives back.
BATCH = 1 << 20
#: Runs of letters (fixed by the contract).
LETTERS = "A-Za-zÀ-ÿ"


def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3, every: int | None = 97) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased. With ``every``, a run whose checksum (of doc_id and run) it
    divides has lost one letter, as a made misspelling."""
    # a run shorter than a word can give none
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("id"), F.explode(runs).alias("run"))
    lower = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    rows = rows.select("id", F.when(F.col("run").rlike("[A-Z]"), lower).otherwise(F.col("run")).alias("word"))
    if every:
        h, size = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")), F.char_length("word")
        at = (h % size).cast("int")
        word = F.col("word")
        rows = rows.select(F.when(h % every == 0, F.concat(word.substr(F.lit(1), at), word.substr(at + 2, size))).otherwise(word).alias("word"))
    return rows.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _code_points(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    off = np.flatnonzero(a[:n] != b[:n])
    return int(off[0]) if len(off) else n


def trie(words: DataFrame, name: str) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``words`` (key, carried long) with part, row (number in key order) and nodes, the trie nodes of
    the key's prefixes from the empty one on; and for each part the nodes of its first word that
    stand for nodes of parts before it (see :func:`resolve`). Keys must be distinct."""
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = words.repartitionByRange(n, "key").sortWithinPartitions("key").select("key", "carried", F.spark_partition_id().alias("part"))

    def run(batches):
        last, nodes, free, row, out, held = None, None, 0, 0, [], 0
        base = 0

        def batch():
            cols = list(zip(*out))
            size = np.cumsum([0, *map(len, cols[4])])
            arrays = [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()),
                      pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate(cols[4])))]
            return pa.RecordBatch.from_arrays(arrays, ["key", "carried", "part", "row", "nodes"])

        for b in batches:
            for key, carried, part in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                key = key.as_py()
                now, base = _code_points(key), part << LOCAL
                if last is None:
                    nodes = base + np.arange(len(now) + 1)
                    free = len(now) + 1
                else:
                    same = _shared(last, now)
                    nodes = np.concatenate([nodes[:same + 1], base + np.arange(free, free + len(now) - same)])
                    free += len(now) - same
                out.append((key, carried, part, base + row, nodes))
                last, row, held = now, row + 1, held + len(nodes)
                if held >= BATCH:
                    yield batch()
                    out, held = [], 0
        if out:
            yield batch()

    made = ranged.mapInArrow(run, "key string, carried long, part int, row long, nodes array<long>")
    made = write_stage(made, scratch_path(words.sparkSession, name))
    ends = made.groupBy("part").agg(*[f(F.struct("key", "nodes"), "row").alias(x) for f, x in ((F.min_by, "first"), (F.max_by, "last"))]).orderBy("part")
    stands, before, held = {}, None, None
    for r in ends.collect():  # two words a range partition
        first = _code_points(r.first.key)
        if before is not None:
            stands[r.part] = held[:_shared(before, first) + 1]
        before = _code_points(r.last.key)
        held = resolve(np.array(r.last.nodes, np.int64), r.part, stands)
    return made, stands


def resolve(nodes: np.ndarray, part: int, stands: dict[int, np.ndarray]) -> np.ndarray:
    """Node numbers with those that stand for nodes of earlier parts replaced by them. A part's first
    word has the local numbers 0, 1, 2, … by depth."""
    known = stands.get(part)
    if known is None:
        return nodes
    local = nodes - (part << LOCAL)
    out = nodes.copy()
    on = local < len(known)  # the other numbers are larger
    out[on] = known[local[on]]
    return out


#: What stands at a pair: the word itself, or the word less a letter that is, or is not, the first of
#: a run of equal letters.
WHOLE, INNER, FIRST = 0, 1, 2


def node_pairs(words: DataFrame) -> DataFrame:
    """p, s (nodes before and behind), kind, wid and n, of each word (wid, word, n) at each of its pairs."""
    spark = words.sparkSession
    ahead, ahead_at = trie(words.select(F.col("word").alias("key"), F.col("wid").alias("carried")), "forward-trie")
    back, back_at = trie(words.select(F.reverse("word").alias("key"), F.col("wid").alias("carried")), "reversed-trie")
    at = spark.sparkContext.broadcast((ahead_at, back_at))
    both = (ahead.select(F.col("carried").alias("wid"), "key", F.col("part").alias("fp"), F.col("nodes").alias("fn"))
            .join(back.select(F.col("carried").alias("wid"), F.col("part").alias("bp"), F.col("nodes").alias("bn")), "wid")
            .join(words.select("wid", "n"), "wid").select("wid", "n", "key", "fp", "fn", "bp", "bn"))

    def run(batches):
        out, held = [], 0

        def batch():
            cols = [np.concatenate(c) for c in zip(*out)]
            kinds = [pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["p", "s", "kind", "wid", "n"])

        for b in batches:
            fs, bs = b.column(4), b.column(6)
            for i, (wid, n, key, fp, bp) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 3, 5)))):
                p = resolve(fs[i].values.to_numpy(), fp, at.value[0])
                s = resolve(bs[i].values.to_numpy(), bp, at.value[1])[::-1]  # s[i]: the node of what stands from i on
                w = _code_points(key)
                first = np.ones(len(w), bool)
                first[1:] = w[1:] != w[:-1]
                kind = np.concatenate([np.zeros(len(p), np.int8), np.where(first, FIRST, INNER).astype(np.int8)])
                m = len(kind)
                out.append((np.concatenate([p, p[:-1]]), np.concatenate([s, s[1:]]), kind, np.full(m, wid), np.full(m, n)))
                held += m
                if held >= BATCH:
                    yield batch()
                    out, held = [], 0
        if out:
            yield batch()

    return both.mapInArrow(run, "p long, s long, kind byte, wid long, n long")


def neighbours(words: DataFrame) -> DataFrame:
    """wid, n_near and best (n, -wid of the best near word) of the words (wid, word, n) that have near words."""
    at = Window.partitionBy("p", "s")
    kind, key = F.col("kind"), F.struct("n", (-F.col("wid")).alias("w"))
    skips = kind != WHOLE
    rows = node_pairs(words).withColumn("key", key).withColumn("all", F.count("*").over(at)).where("all > 1")
    rows = (rows.withColumn("whole", F.max(F.when(~skips, F.col("key"))).over(at))
            .withColumn("skipped", F.sum(skips.cast("long")).over(at))
            .withColumn("firsts", F.sum((kind == FIRST).cast("long")).over(at))
            .withColumn("top", F.max(F.when(skips, F.col("key"))).over(at))
            .withColumn("top_first", F.max(F.when(kind == FIRST, F.col("key"))).over(at)))
    rows = rows.withColumn("second", F.max(F.when(skips & (F.col("key") != F.col("top")), F.col("key"))).over(at))
    other = F.when(F.col("key") == F.col("top"), F.col("second")).otherwise(F.col("top"))
    longer = (kind == FIRST) & F.col("whole").isNotNull()
    near = F.when(skips, F.col("skipped") - 1 + longer.cast("long")).otherwise(F.col("firsts"))
    best = F.when(~skips, F.col("top_first")).when(longer, F.greatest(other, F.col("whole"))).otherwise(other)
    return rows.select("wid", near.alias("near"), best.alias("best")).where("near > 0").groupBy("wid").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """wid, to: where the chain of forms (wid, to) from each wid ends, by pointer doubling."""
    spark = forms.sparkSession
    now = write_stage(forms, scratch_path(spark, "forms"))
    while True:
        further = now.select(F.col("wid").alias("to"), F.col("to").alias("then"))
        step = write_stage(now.join(further, "to", "left").select("wid", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved")),
                           scratch_path(spark, "forms"))
        if not step.where("moved").head(1):
            return step.select("wid", "to")
        now = step.select("wid", "to")


def variants(counts: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of the distinct words (word, n). A word's form is its near word
    (one inserted, deleted or replaced code point) of largest n, the first in code-point order of such,
    if that n is twice the word's or more; root is where the forms end."""
    spark = counts.sparkSession
    # wid grows in code-point order: range partitions of sorted words, as UTF-8 sorts like code points
    ranged = counts.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
    words = write_stage(ranged.withColumn("wid", F.monotonically_increasing_id()), scratch_path(spark, "words"))
    found = write_stage(neighbours(words), scratch_path(spark, "near"))
    judged = words.join(found, "wid", "left").select(
        "wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        *[F.when(F.col("best.n") >= 2 * F.col("n"), c).alias(x) for c, x in ((F.col("best.n"), "form_n"), (-F.col("best.w"), "to"))])
    judged = write_stage(judged, scratch_path(spark, "judged"))
    ends = last_forms(judged.where("to is not null").select("wid", "to")).select("wid", F.col("to").alias("end"))
    name = lambda key, out: words.select(F.col("wid").alias(key), F.col("word").alias(out))
    out = judged.join(ends, "wid", "left").join(name("to", "form"), "to", "left").join(name("end", "last"), "end", "left")
    return out.select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")
