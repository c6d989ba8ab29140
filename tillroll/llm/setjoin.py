"""Groups of documents linked by the Jaccard similarity of their shingle sets, by set-relation skipping.

1. Documents with equal sets form a class; from here on a class is its smallest doc_id.
2. A set's elements are ordered from rare to common (counts of ``COUNTERS`` hashed counters over all
   documents, then the element itself). Two sets that reach the threshold share an element among
   the first n - ceil(t n) + 1 of each, so only these prefixes are indexed: a list for each element
   holds the sets that have it, with their size and its position there.
3. A list's smallest class is its lead. Leads are compared with the sets of their lists first (length
   and position bounds, a bound on the difference from ``BINS`` hashed counts, then full sets), and the
   links found give components. Lists in which many sets are left outside the main component get
   further leads from these, as long as that settles at least a quarter of their work. Copies and near
   copies of one text are settled here, with one comparison a set and lead.
4. In what is left, a list is cut into position blocks sorted by size. A set reads of each block only
   the sizes that the length bound and both positions allow, so most blocks are skipped whole. Only
   sets of different components are paired.
5. These pairs are verified by relation: a set x with a linked lead y takes y's answers, |y & z|, and
   corrects them by the few elements in which x and y differ; |y ^ z| - |x ^ y| rules most pairs out
   before. Every link between different components is found, so the result is exact.

Elements are 64-bit hashes of word sequences. A list in which many unlike sets of like sizes share an
early element stays quadratic in comparisons of numbers (not in rows): the rare-first order is there to
prevent such lists.

Cases: null texts and texts without words have an empty set and link with nothing; a text of fewer words
than a shingle is one shingle; rows that repeat a doc_id count as one document, with the smallest text;
rows without doc_id are left out; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.components import components
from tillroll.llm.hyperminhash import shingle_sets
from tillroll.llm.sift import sift
from tillroll.llm.substring import one_row_per_id
from tillroll.llm.tokens import mix, slices
from tillroll.llm.words import ranges
from tillroll.sources.stage import scratch_path, write_stage

#: Hashed counters of elements (a power of two), and the rows in which a task reports them.
COUNTERS, COUNTER_BLOCKS = 1 << 18, 64
#: Hashed counts of a set's elements, for a lower bound on the difference of two sets.
BINS = 128
#: Rows of a list on each side of a block, and sets that a task holds against one lead.
BLOCK, GROUP = 512, 500
#: Sets outside the main component times sets, from which a list gets further leads.
HEAVY = 1 << 16
#: Pairs of numbers that a task looks at together.
CHUNK = 1 << 20


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """How many documents hold elements of each hashed counter. Tasks report blocks of counters, which are
    added up block by block; ``COUNTERS`` numbers reach the driver."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for part in slices(batches):
            sets = shingle_sets(part.column(0), k)
            total += np.bincount((np.concatenate(sets) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        rows = total.reshape(COUNTER_BLOCKS, -1)
        on = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array([rows[i].tobytes() for i in on], pa.binary())], ["block", "counts"])

    def add(batches):
        held = {}
        for b in batches:
            for block, counts in zip(b.column(0).to_pylist(), b.column(1)):
                held[block] = held.get(block, 0) + np.frombuffer(counts.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "counts"])

    kind = "block long, counts binary"
    out = np.zeros((COUNTER_BLOCKS, COUNTERS // COUNTER_BLOCKS), np.int64)
    for block, counts in docs.select("text").mapInArrow(count, kind).repartition(COUNTER_BLOCKS, "block").mapInArrow(add, kind).collect():
        out[block] = np.frombuffer(counts, np.int64)
    return out.ravel()


def sign(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n (set size), s1, s2 (set identity), prefix (rarest elements first) and bins (hashed counts)."""
    often = docs.sparkSession.sparkContext.broadcast(np.minimum(frequencies(docs, k), 2**32 - 1).astype(np.uint32))

    def run(batches):
        for part in slices(batches):
            sets = shingle_sets(part.column(1), k)
            heads, bins = [], []
            for s in sets:
                n = len(s)
                order = np.argsort(often.value[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
                heads.append(s[order[:n + percent * -n // 100 + 1 if n else 0]])  # n - ceil(t n) + 1
                bins.append(np.minimum(np.bincount((mix(s) >> np.uint64(57)).astype(np.int64), minlength=BINS), 65535).astype(np.uint16).tobytes())
            ids = [[int(mix(s ^ np.uint64(x)).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for x in (3, 0x1234567)]
            prefix = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, heads)]), pa.int32()), pa.array(np.concatenate(heads).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.int64()) for x in ids), prefix, pa.array(bins, pa.binary())],
                ["doc_id", "n", "s1", "s2", "prefix", "bins"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, prefix array<long>, bins binary")


def needed(n, m, percent: int):
    """The least intersection of sets of n and m elements that reaches the threshold: numbers or arrays."""
    return -(-percent * (n + m) // (100 + percent))


def _fits(n: str, i: str, m: str, j: str, percent: int) -> Column:
    """The sizes n, m and the positions i, j of the first common element leave the threshold in reach. Sets of
    different classes and one size share less than all."""
    need = f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"
    return F.expr(f"{need} <= least({n} - {i}, {m} - {j}) and {need} <= least({n}, {m}) - int({n} = {m})")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose hashed counts do not rule the threshold out: half of what two sets
    differ in their counts is missing from either at least."""

    def run(batches):
        for p in batches:
            if p.num_rows:
                x, y = (np.frombuffer(b"".join(p.column(i).to_pylist()), np.uint16).reshape(-1, BINS).astype(np.int32) for i in (4, 5))
                na, nb = (p.column(i).to_numpy() for i in (2, 3))
                ok = np.abs(x - y).sum(1) <= na + nb - 2 * needed(na, nb, percent)
                yield p.select([0, 1, 2, 3]).filter(pa.array(ok))

    side = lambda x: classes.select(F.col("doc_id").alias(x), F.col("bins").alias(f"bins_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bins_a", "bins_b")
    return both.mapInArrow(run, "a long, b long, na long, nb long")


def _dealt(pairs: DataFrame, key: str, other: str) -> DataFrame:
    """``pairs`` with part: the pairs of one ``key`` are dealt by ``other`` in parts of about ``GROUP``."""
    spark = pairs.sparkSession
    parts = write_stage(pairs.groupBy(key).agg(F.ceil(F.count("*") / GROUP).alias("parts")), scratch_path(spark, "parts"))
    return pairs.join(parts, key).withColumn("part", F.pmod(F.xxhash64(other), F.col("parts"))).drop("parts")


def _verified(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """a, b and inter, the exact intersection, of pairs. A task gets parts of the sets that meet one ``a``
    behind a copy of it."""
    dealt = write_stage(_dealt(pairs.select("a", "b"), "a", "b"), scratch_path(docs.sparkSession, "dealt"))
    asked = (dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("doc_id"))
             .unionByName(dealt.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("doc_id")).distinct()))
    rows = asked.join(sift(docs, asked), "doc_id").select("a", "part", "role", "doc_id", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role", "doc_id")

    def run(batches):
        own = np.zeros(0, np.uint64)
        for p in slices(batches):
            out = []
            for a, role, b, s in zip(*(p.column(i).to_pylist() for i in (0, 2, 3)), shingle_sets(p.column(4), k)):
                if role:
                    out.append((a, b, _common(s, own)))
                else:
                    own = s
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "inter"])

    return rows.mapInArrow(run, "a long, b long, inter long")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of sorted sets."""
    if not len(a) or not len(b):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b and apart (elements in one set only) of the pairs (a, b, na, nb) that reach the threshold."""
    spark = docs.sparkSession
    likely = write_stage(_likely(pairs, classes, percent), scratch_path(spark, "likely"))
    told = likely.join(_verified(likely, docs, k), ["a", "b"])
    linked = F.col("inter") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("inter"))
    return write_stage(told.where(linked).select("a", "b", (F.col("na") + F.col("nb") - 2 * F.col("inter")).alias("apart")), scratch_path(spark, "links"))


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, component after ``links``."""
    edges = links.select("a", "b")
    if labels is not None:
        edges = edges.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return write_stage(components(edges), scratch_path(links.sparkSession, "labels"))


def _mixed(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of lists that lie in several components, with their component, the list's largest one
    (main), and the sets of the list (all) and of main (most)."""
    spark = lists.sparkSession
    known = lists.select("token", "doc_id", "n", "pos").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    known = write_stage(known.withColumn("component", F.coalesce("component", "doc_id")), scratch_path(spark, "known"))
    counts = known.groupBy("token", "component").agg(F.count("*").alias("c"))
    stats = counts.groupBy("token").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("all")).where("all > m.c")
    stats = write_stage(stats.select("token", F.col("m.component").alias("main"), "all", F.col("m.c").alias("most")), scratch_path(spark, "mixed-lists"))
    return write_stage(known.join(stats, "token"), scratch_path(spark, "mixed"))


def _pairs_in_lists(mixed: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb (a < b): sets of different components that a list leaves in reach of the threshold."""
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(n)), F.col(n))
    sized = mixed.withColumn("parts", F.ceil(F.col("all") / BLOCK)).withColumn("rows", F.ceil((F.col("all") - F.col("most")) / BLOCK))
    columns = ["token", "row", "col", "role", "octave", "n", "pos", "doc_id", "component"]
    sized = sized.withColumn("octave", F.floor(F.log2(F.col("pos") + F.lit(1.0))).cast("int"))
    strays = sized.where("component <> main").withColumn("row", mine("rows")).withColumn("col", upto("parts")).withColumn("role", F.lit(0)).select(columns)
    others = sized.withColumn("col", mine("parts")).withColumn("row", upto("rows")).withColumn("role", F.lit(1)).select(columns)
    rows = strays.unionByName(others).repartition("token", "row", "col").sortWithinPartitions(*columns[:7])

    def pairs(c: list[np.ndarray]):
        token, row, col, role, octave, n, pos, doc, comp = c
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1])
        group = np.cumsum(new) - 1
        a, b = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        if not len(a) or not len(b):
            return
        # position blocks: (group, octave), each sorted by size
        cut = np.ones(len(b), bool)
        cut[1:] = (group[b][1:] != group[b][:-1]) | (octave[b][1:] != octave[b][:-1])
        block = np.cumsum(cut) - 1
        at_block = np.flatnonzero(cut)
        of_group, least = group[b][at_block], (1 << octave[b][at_block]) - 1
        lo, hi = np.searchsorted(of_group, group[a]), np.searchsorted(of_group, group[a], "right")
        x, y = np.repeat(a, hi - lo), ranges(lo, hi - lo)  # a set and each position block of its list
        nx, ix = n[x], pos[x]
        # sizes m that the length bound and both positions leave: m - j >= needed and n - i >= needed
        small = np.maximum(-(-percent * nx // 100), -(-(percent * nx + (100 + percent) * least[y]) // 100))
        large = np.minimum(100 * nx // percent, (100 + percent) * (nx - ix) // percent - nx)
        size = (block << 40) + n[b]
        first = np.searchsorted(size, (y << 40) + small)
        count = np.maximum(np.searchsorted(size, (y << 40) + large, "right") - first, 0)
        on = np.flatnonzero(count)  # all other blocks are skipped
        x, first, count = x[on], first[on], count[on]
        ends = np.cumsum(count)
        at = 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
            i, j = np.repeat(x[at:to], count[at:to]), b[ranges(first[at:to], count[at:to])]
            need = needed(n[i], n[j], percent)
            ok = (comp[i] != comp[j]) & (need <= np.minimum(n[i] - pos[i], n[j] - pos[j])) & (need <= np.minimum(n[i], n[j]) - (n[i] == n[j]))
            i, j = i[ok], j[ok]
            swap = doc[i] > doc[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            both = np.unique(np.stack([doc[i], doc[j], n[i], n[j]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, c]) for c in range(4)], ["a", "b", "na", "nb"])
            at = to

    def run(batches):
        held = None
        for p in batches:
            now = [p.column(i).to_numpy().astype(np.int64) for i in range(9)]
            now = now if held is None else [np.concatenate(c) for c in zip(held, now)]
            if not len(now[0]):
                continue
            # the last list block may go on in the next batch
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]) | (now[2] != now[2][-1]))
            to = int(last[-1]) + 1 if len(last) else 0
            if to:
                yield from pairs([c[:to] for c in now])
            held = [c[to:] for c in now]
        if held is not None and len(held[0]):
            yield from pairs(held)

    return rows.mapInArrow(run, "a long, b long, na long, nb long").distinct()


def _by_relation(pairs: DataFrame, near: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The links among ``pairs`` (a, b). ``near``: doc_id and the linked lead that it differs least from. A task
    holds a lead y and the sets z that y's near sets are to be compared with; each near set x
    corrects |y & z| by the elements that it has and y has not, and the reverse."""
    spark = docs.sparkSession
    lead = lambda x: near.select(F.col("doc_id").alias(x), F.col("lead").alias(f"lead_{x}"))
    asked = pairs.join(lead("a"), "a", "left").join(lead("b"), "b", "left")
    swap = F.col("lead_a").isNull() & F.col("lead_b").isNotNull()
    asked = asked.select(F.coalesce("lead_a", "lead_b", "a").alias("y"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("x"),
                         F.when(swap, F.col("a")).otherwise(F.col("b")).alias("z"))
    dealt = write_stage(_dealt(write_stage(asked, scratch_path(spark, "asked")), "y", "z"), scratch_path(spark, "dealt"))
    # a group: y, the sets z, then each x with its pairs behind it
    texts = reduce_union([
        dealt.select("y", "part", F.lit(0).alias("phase"), F.col("y").alias("doc_id")),
        dealt.select("y", "part", F.lit(1).alias("phase"), F.col("z").alias("doc_id")),
        dealt.select("y", "part", F.lit(2).alias("phase"), F.col("x").alias("doc_id"))]).distinct()
    rows = texts.join(sift(docs, texts), "doc_id").select("y", "part", "phase", F.col("doc_id").alias("x"), F.lit(-1).cast("long").alias("z"), F.lit(True).alias("head"), "text")
    rows = rows.unionByName(dealt.select("y", "part", F.lit(2).alias("phase"), "x", "z", F.lit(False).alias("head"), F.lit(None).cast("string").alias("text")))
    rows = rows.repartition("y", "part").sortWithinPartitions("y", "part", "phase", "x", F.desc("head"), "z")

    def run(batches):
        y, strangers, more, less, size, apart = None, {}, None, None, 0, 0
        for p in slices(batches):
            out = []
            for phase, x, z, head, s in zip(*(p.column(i).to_pylist() for i in (2, 3, 4, 5)), shingle_sets(p.column(6), k)):
                if phase == 0:
                    y, strangers = s, {}
                elif phase == 1:
                    strangers[x] = (s, _common(s, y))  # y's answer
                elif head:
                    more, less, size = np.setdiff1d(s, y, True), np.setdiff1d(y, s, True), len(s)
                    apart = len(more) + len(less)
                else:
                    other, common = strangers[z]
                    need = int(needed(size, len(other), percent))
                    if len(y) + len(other) - 2 * common - apart > size + len(other) - 2 * need:
                        continue
                    if common - _common(less, other) + _common(more, other) >= need:
                        out.append((x, z))
            cols = list(zip(*out)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def reduce_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable over links of ``percent`` per cent or
    more, itself included), one row a doc_id."""
    spark = docs.sparkSession
    stage = lambda df, name: write_stage(df, scratch_path(spark, name))
    docs = one_row_per_id(docs)
    signed = stage(sign(docs, k, percent), "signed")
    reps = stage(signed.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id")), "reps")
    classes = stage(signed.join(reps.select("doc_id"), "doc_id").select("doc_id", "n", "prefix", "bins"), "classes")

    entries = classes.select("doc_id", "n", F.posexplode("prefix").alias("pos", "token"))
    lead = F.min(F.struct("doc_id", "n", "pos")).alias("lead")
    shared = stage(entries.groupBy("token").agg(lead, F.count("*").alias("c")).where("c > 1").drop("c"), "shared")
    lists = stage(entries.join(shared, "token"), "lists")
    met = lambda rows: (rows.where(_fits("lead.n", "lead.pos", "n", "pos", percent))
                        .select(F.col("lead.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb")).distinct())

    links = _links(met(lists.where("doc_id <> lead.doc_id")), classes, docs, k, percent)
    labels, found = _joined(None, links), [links]
    mixed = _mixed(lists, labels)
    heavy, turn = mixed.withColumn("work", (F.col("all") - F.col("most")) * F.col("all")).where(F.col("work") > HEAVY), 0
    while heavy.head(1):
        turn += 1
        pick = F.min_by(F.struct("doc_id", "n", "pos", "component"), F.xxhash64("doc_id", F.lit(turn))).alias("lead")
        leads = stage(heavy.where("component <> main").groupBy("token").agg(pick, F.max("work").alias("work")), "leads")
        met_now = heavy.drop("work").join(leads, "token").where("component <> lead.component")
        links = _links(met(met_now), classes, docs, k, percent)
        labels = _joined(labels, links)
        found.append(links)
        # a list gets another lead if this one settled a quarter of its work
        again = _mixed(heavy, labels).withColumn("now", (F.col("all") - F.col("most")) * F.col("all"))
        before = leads.select("token", "work")
        heavy = again.join(before, "token").where((F.col("now") > HEAVY) & (F.col("now") * 4 <= F.col("work") * 3)).drop("work").withColumnRenamed("now", "work")
        heavy = stage(heavy, "heavy")

    mixed = _mixed(mixed, labels) if turn else mixed
    near = stage(reduce_union(found).groupBy(F.col("b").alias("doc_id")).agg(F.min_by("a", F.struct("apart", "a")).alias("lead")), "nearest")
    pairs = stage(_likely(stage(_pairs_in_lists(mixed, percent), "pairs"), classes, percent), "likely")
    labels = _joined(labels, _by_relation(pairs, near, docs, k, percent))

    ends = reps.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("s1", "s2", F.coalesce("component", "doc_id").alias("c"))
    out = signed.select("doc_id", "n", "s1", "s2").join(stage(ends, "ends"), ["s1", "s2"], "left")
    own = F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
