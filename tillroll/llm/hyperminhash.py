"""Near-duplicate groups by HyperMinHash registers, banding and exact verification.

1. A document's set: the distinct hashes of its word shingles. Its elements fall into
   ``BANDS * ROWS`` buckets; a bucket's register stores the leading zeros of its smallest hash (6
   bits) and the ``MANTISSA`` bits after them. Empty buckets borrow another bucket's register by a
   fixed order (densification), so that short sets are banded too.
2. Documents with equal sets form a class (pre-aggregated before the shuffle); from here on a
   class is its smallest doc_id, and copies are never paired.
3. Bands of ``ROWS`` registers are hashed. Within a band bucket every class is paired with the
   bucket's smallest class only: pairs grow with the rows of the buckets, not with their square.
4. Pairs whose Jaccard estimate, corrected for the registers' expected collisions, lies more than
   ``MARGIN`` below the threshold go; the rest are verified on their full sets.
5. Verified links give components (distributed, see components.py). Where the classes that met one
   smallest class still lie in several components, all but those of the largest component there
   (the stragglers) are compared with all the others, in blocks of ``BLOCK`` by ``BLOCK`` texts and
   by exact counts; a task returns links, never its pairs. After that every two classes that share
   a bucket are in one component or were compared.

At a similarity of 0.8 a pair shares no band with probability (1 - 0.8^5)^40 = 1e-7.

Cases: null texts and texts without words have an empty set and link with nothing; a text of
fewer words than a shingle is one shingle; rows that repeat a doc_id count as one document, with
the smallest text; rows without doc_id are left out; no rows give no rows; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.components import components
from tillroll.llm.sift import sift
from tillroll.llm.split import join_split
from tillroll.llm.substring import one_row_per_id
from tillroll.llm.tokens import mix, slices
from tillroll.llm.words import UNSPACED, Words, rolled
from tillroll.sources.stage import scratch_path, write_stage

BANDS, ROWS, MANTISSA = 40, 5, 10
REGISTERS = BANDS * ROWS
#: Estimates this far below the threshold are trusted: over 7 standard deviations at 200 registers.
MARGIN = 0.2
#: Members of one pair group that a task verifies against a copy of their smallest class.
GROUP = 500
#: Texts on each side of a block of the second comparison.
BLOCK = 500
#: Bytes of text (unless one text has more) and sets that a task works on at once; its arrays take about 40 and 20,000 bytes for each.
SLICE, SETS = 1_000_000, 1000
_RNG = np.random.default_rng(5)
_BORROW = _RNG.integers(0, REGISTERS, (64, REGISTERS))
_BAND = _RNG.integers(1, 2**63, (BANDS, ROWS + 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    w = Words(texts, UNSPACED, True)
    h, out = rolled(w.hash, k), []
    for a, n in zip(w.first.tolist(), w.count.tolist()):
        if n >= k:
            s = np.sort(h[a:a + n - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(rolled(w.hash[a:a + n], n) if n else np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers a set (uint16); sets must not be empty."""
    flat = mix(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D))
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    low = np.full(len(sets) * REGISTERS, 2**64 - 1, np.uint64)
    np.minimum.at(low, doc * REGISTERS + (flat % np.uint64(REGISTERS)).astype(np.int64), mix(flat))
    low = low.reshape(len(sets), REGISTERS)
    has = np.zeros(len(sets) * REGISTERS, bool)
    has[doc * REGISTERS + (flat % np.uint64(REGISTERS)).astype(np.int64)] = True
    has = has.reshape(low.shape)
    own, full, todo = low.copy(), has.copy(), np.flatnonzero(~has.all(1))
    for step in _BORROW:
        if not len(todo):
            break
        take = ~full[todo] & has[todo][:, step]
        low[todo] = np.where(take, own[todo][:, step], low[todo])
        full[todo] |= take
        todo = todo[~full[todo].all(1)]
    for i in todo.tolist():  # very few elements: the next filled bucket to the right
        filled = np.flatnonzero(has[i])
        gaps = np.flatnonzero(~full[i])
        low[i, gaps] = own[i, filled[np.searchsorted(filled, gaps) % len(filled)]]
    exponent = np.frexp(low.astype(np.float64))[1]  # rounding up at a power of two is the same for equal hashes
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint64)
    mantissa = (low << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    return mix((parts * _BAND[None, :, :ROWS]).sum(2, dtype=np.uint64) + _BAND[None, :, ROWS])


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from equal registers, less the collisions expected of unequal minima
    (HyperMinHash's approximation for sets of these sizes)."""
    ratio = np.maximum(na, nb) / np.maximum(np.minimum(na, nb), 1)
    expected = 0.169919487159739 * 4 * ratio / (1 + ratio) ** 2 / 2**MANTISSA
    return np.clip(((a == b).mean(1) - expected) / (1 - expected), 0, 1)


def sign(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), s1, s2 (set identity) and registers (null if the set is empty)."""

    def run(batches):
        for part in slices(batches, limit=SLICE):
            sets = shingle_sets(part.column(1), k)
            some = [i for i, s in enumerate(sets) if len(s)]
            rows = [None] * len(sets)
            for j in range(0, len(some), SETS):
                for i, r in zip(some[j:j + SETS], registers([sets[i] for i in some[j:j + SETS]])):
                    rows[i] = r.tobytes()
            ids = [[int(mix(s ^ np.uint64(x)).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for x in (3, 0x1234567)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.int64()) for x in ids), pa.array(rows, pa.binary())],
                ["doc_id", "n", "s1", "s2", "regs"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, regs binary")


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), REGISTERS)


def _estimated(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with ``likely`` (the estimate may reach the threshold) and ``lo``, the least
    distance that the estimate leaves them."""

    def run(batches):
        for p in batches:
            if p.num_rows:
                na, nb = (p.column(i).to_numpy() for i in (2, 4))
                most = estimate(_matrix(p.column(3)), _matrix(p.column(5)), na, nb) + MARGIN
                by_size = np.minimum(na, nb) / np.maximum(na, nb)
                yield pa.RecordBatch.from_arrays(
                    [p.column(0), p.column(1), pa.array((most >= threshold) & (by_size >= threshold - 1e-9)), pa.array(np.maximum(1 - np.minimum(most, by_size), 0))],
                    ["a", "b", "likely", "lo"])

    side = lambda x: classes.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "ra", "nb", "rb")
    return both.mapInArrow(run, "a long, b long, likely boolean, lo double")


def _verified(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """inter and total (union size) on full sets, for pairs (a, b). A task gets groups of at most
    about ``GROUP`` texts with a copy of their ``a``, sorted so that it comes first."""
    parts = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / GROUP))
    parts = write_stage(parts, scratch_path(docs.sparkSession, "parts"))
    sized = join_split(pairs, parts, "a", "n")
    members = sized.select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("doc_id"))
    heads = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("doc_id"))
    asked = members.unionByName(heads)
    rows = asked.join(sift(docs, asked), "doc_id").select("a", "part", (F.col("doc_id") != F.col("a")).alias("member"), "doc_id", "text")
    grouped = rows.repartition("a", "part").sortWithinPartitions("a", "part", "member", "doc_id")

    def run(batches):
        head, own = None, np.zeros(0, np.uint64)
        for p in slices(batches, limit=SLICE):
            sets, out = shingle_sets(p.column(4), k), []
            for a, member, b, s in zip(p.column(0).to_pylist(), p.column(2).to_pylist(), p.column(3).to_pylist(), sets):
                if not member:
                    head, own = a, s
                else:
                    assert head == a
                    inter = int(np.isin(s, own, assume_unique=True).sum()) if len(s) and len(own) else 0
                    out.append((a, b, inter, len(s) + len(own) - inter))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "inter", "total"])

    return grouped.mapInArrow(run, "a long, b long, inter long, total long")


def _between(pairs: DataFrame, labels: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between the partners of one ``a`` that lie in different components."""
    met = (pairs.select(F.col("a").alias("lead"), F.col("b").alias("doc_id"))
           .join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    met = write_stage(met, scratch_path(docs.sparkSession, "met"))
    counts = met.groupBy("lead", "component").agg(F.count("*").alias("n"))
    mixed = (counts.groupBy("lead").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
             .where("all > most").select("lead", "main", "all", F.ceil(F.col("all") / BLOCK).alias("parts"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("strays")))
    mixed = write_stage(mixed, scratch_path(docs.sparkSession, "leads"))
    met = write_stage(join_split(met, mixed, "lead", "all"), scratch_path(docs.sparkSession, "mixed"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(n)), F.col(n))
    columns = ["lead", "row", "col", "role", "doc_id", "component"]
    strays = met.where("component <> main").withColumn("row", mine("strays")).withColumn("col", upto("parts")).withColumn("role", F.lit(0)).select(columns)
    others = met.withColumn("col", mine("parts")).withColumn("row", upto("strays")).withColumn("role", F.lit(1)).select(columns)
    rows = strays.unionByName(others).join(sift(docs, met), "doc_id").select(*columns, "text")
    grouped = rows.repartition("lead", "row", "col").sortWithinPartitions(*columns[:5])

    def run(batches):
        block, ids, comps, sets, known = None, [], [], [], None
        for p in slices(batches, limit=SLICE):
            at = list(zip(*(p.column(i).to_pylist() for i in range(3))))
            role, doc, comp = (p.column(i).to_numpy() for i in (3, 4, 5))
            own, links = shingle_sets(p.column(6), k), []
            edges = [0, *(i for i in range(1, len(at)) if at[i] != at[i - 1] or role[i] != role[i - 1]), len(at)]
            for i, j in zip(edges[:-1], edges[1:]):
                if at[i] != block:
                    block, ids, comps, sets = at[i], [], [], []
                if role[i] == 0:
                    ids, comps, sets, known = [*ids, *doc[i:j]], [*comps, *comp[i:j]], [*sets, *own[i:j]], None
                    continue
                if not sets:
                    continue
                if known is None:
                    known = np.unique(np.concatenate(sets))
                    held = [np.searchsorted(known, s) for s in sets]
                flat = np.concatenate(own[i:j])
                place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                place = np.where(known[place] == flat, place, len(known))
                size = np.array([len(s) for s in own[i:j]])
                for d, c, s in zip(ids, comps, held):
                    mark = np.zeros(len(known) + 1, np.int32)
                    mark[s] = 1
                    inter = np.add.reduceat(mark[place], np.cumsum(size) - size)
                    hit = (100 * inter >= percent * (size + len(s) - inter)) & (comp[i:j] != c)
                    links += [(min(d, x), max(d, x)) for x in doc[i:j][hit].tolist()]
            cols = list(zip(*links)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return grouped.mapInArrow(run, "a long, b long")


def group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of ``percent`` per
    cent or more) and kept (the smallest of its component), one row a doc_id."""
    spark = docs.sparkSession
    stage = lambda df, name: write_stage(df, scratch_path(spark, name))
    docs = one_row_per_id(docs)
    signed = sign(docs, k)
    least = F.min(F.struct("doc_id", "n", "regs")).alias("c")
    classes = stage(signed.where("n > 0").groupBy("s1", "s2").agg(least).select("s1", "s2", "c.*"), "classes")

    def bands(batches):
        for p in batches:
            if p.num_rows:
                keys = band_keys(_matrix(p.column(1))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), p.column(0).take(pa.array(np.repeat(np.arange(p.num_rows), BANDS)))], ["key", "doc_id"])

    banded = classes.select("doc_id", "regs").mapInArrow(bands, "key long, doc_id long")
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count("*").alias("size")).where("size > 1")
    # written first: behind an aggregate on the key, Spark would not split a hot one
    buckets = stage(banded.join(stage(shared, "shared"), "key"), "buckets")  # only rows of buckets with company
    threshold = percent / 100
    pairs = buckets.where("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    linked = F.col("inter") * 100 >= F.col("total") * percent

    guess = stage(_estimated(pairs, classes, threshold), "estimates")
    sure = _verified(guess.where("likely").select("a", "b"), docs, k)
    labels = stage(components(sure.where(linked).select("a", "b")), "labels")
    more = _between(guess.select("a", "b"), labels, docs, k, percent)
    labels = stage(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "labels")
    reps = classes.select("s1", "s2", F.col("doc_id").alias("rep")).join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select("s1", "s2", F.coalesce("component", "rep").alias("c"))
    out = signed.select("doc_id", "n", "s1", "s2").join(reps, ["s1", "s2"], "left")
    own = F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), (own == F.col("doc_id")).alias("kept"))
