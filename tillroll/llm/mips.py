"""Exact top-k inner products by norm buckets, with local coordinate or length pruning.

Vectors become integers, are range-partitioned by norm (longest first) and laid down as buckets of
about ``BUCKET`` vectors. Queries, in blocks of ``QUERIES``, first meet the bucket of the longest
vectors, which gives each query a lower bound on its k-th score. With it, a bucket whose longest
vector cannot reach the bound is skipped; elsewhere the bound divided by both lengths is the
cosine that a candidate of this bucket must have. Above ``COSINE`` the query prunes by
coordinates: on its largest coordinates a candidate must lie in the interval that the cosine
allows (binary search in the bucket's sorted columns, intersected). Below, it prunes by length:
the bucket is sorted by norm, so the candidates are a prefix. Products of what is left are exact;
each bucket returns at most k candidates a query, and a window keeps the best k of all.

Query blocks are sent to the buckets (a stated query set against all rows, in blocks): a task
holds one bucket and one block at a time. Products are whole numbers: in doubles while they stay
below 2^52, else in 64-bit integers.

Cases: vectors that are null or hold null or non-finite components take no part; vectors of another
dimension than the query's are no candidates; vectors of norm 0 are (score 0); ties go to the
smaller vec_id; rows that repeat the query's vec_id are its own; rows that repeat vec_id and vector
count once, before buckets are made; a vec_id with several vectors takes one rank, by its best
score (as a query: the best over its vectors), and the bound counts vec_ids, not rows; no rows give
no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tillroll.sources.stage import scratch_path, write_stage

BUCKET, QUERIES, COSINE, FOCUS = 1024, 512, 0.6, 3
_BLOCK = "block long, dim int, n int, longest double, ids binary, vectors binary"
#: Steps of a doubling of the norm, by which buckets are looked up; all norms lie below 2^32.
STEPS = 4


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, dim, norm and v (int64 components as bytes; those beyond 2^62 are cut, their norm tells)
    of the vectors that take part."""

    def run(batches):
        for b in batches:
            ids, rows, norms = [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if i is not None and x is not None and None not in x:
                    v = np.array(x, np.float64)
                    if np.isfinite(v).all():
                        ids.append(i)
                        with np.errstate(over="ignore"):
                            v = np.floor(v * scale)
                            norms.append(float(np.linalg.norm(v)))
                        rows.append(np.clip(v, -(2.0**62), 2.0**62).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(v) for v in rows], pa.int32()), pa.array(norms, pa.float64()),
                 pa.array([v.tobytes() for v in rows], pa.binary())], ["vec_id", "dim", "norm", "v"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, dim int, norm double, v binary")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """The rows of each partition, in their order, as blocks of one dimension."""

    def pack(batches):
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId() << 32, 0, []

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([part + n], pa.int64()), pa.array([held[0][1]], pa.int32()), pa.array([len(held)], pa.int32()), pa.array([max(h[3] for h in held)], pa.float64()),
                 pa.array([np.array([h[0] for h in held], np.int64).tobytes()], pa.binary()), pa.array([b"".join(h[2] for h in held)], pa.binary())],
                ["block", "dim", "n", "longest", "ids", "vectors"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 2))):
                if held and (len(held) == size or held[0][1] != row[1]):
                    yield out()
                    n, held = n + 1, []
                held.append(row)
        if held:
            yield out()

    return rows.mapInArrow(pack, _BLOCK)


class Bucket:
    """One block of vectors, longest first, with sorted columns of their directions."""

    def __init__(self, dim: int, ids: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.v = np.frombuffer(vectors, np.int64).reshape(len(self.ids), dim)
        self.f = self.v.astype(np.float64)
        self.norm = np.linalg.norm(self.f, axis=1)
        self.repeats = len(np.unique(self.ids)) < len(self.ids)
        self.sorted = None

    def _columns(self):
        unit = self.f / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(unit, self.order, axis=0)

    def by_coordinates(self, q: np.ndarray, length: float, cosine: float) -> np.ndarray:
        """Candidates that can have this cosine with ``q``, by its ``FOCUS`` largest coordinates."""
        if self.sorted is None:
            self._columns()
        unit, seen = q / length, np.zeros(len(self.ids), np.int8)
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        turn = np.arccos(np.clip(cosine, -1, 1))
        for c in focus:  # at an angle of at most ``turn`` from q, and so from q's angle to this axis
            angle = np.arccos(np.clip(unit[c], -1, 1))
            a = np.searchsorted(self.sorted[:, c], np.cos(min(angle + turn, np.pi)) - 1e-9, "left")
            z = np.searchsorted(self.sorted[:, c], np.cos(max(angle - turn, 0)) + 1e-9, "right")
            seen[self.order[a:z, c]] += 1
        return np.flatnonzero(seen == len(focus))

    def best(self, qid: int, q: np.ndarray, bound: float, k: int):
        """Up to ``k`` (vec_id, score), best first, among vectors with scores of ``bound`` or more;
        a vec_id once, with its best score."""
        qf = q.astype(np.float64)
        length = float(np.linalg.norm(qf))
        if not len(self.ids) or length * self.norm[0] * (1 + 1e-9) + 1e-9 < bound:
            return []
        cosine = bound / (length * self.norm[0]) if length * self.norm[0] > 0 else 0
        if COSINE <= cosine <= 1:
            rows = self.by_coordinates(qf, length, cosine * (1 - 1e-9))
        elif bound > 0 and length > 0:
            rows = slice(0, int(np.searchsorted(-self.norm, -bound / length * (1 - 1e-9), "right")))
        else:
            rows = slice(0, len(self.ids))
        exact = length * self.norm[0] < 2**52
        score = (self.f[rows] @ qf).astype(np.int64) if exact else self.v[rows] @ q
        ids = self.ids[rows]
        ok = (score >= bound) & (ids != qid)
        score, ids = score[ok], ids[ok]
        if self.repeats:
            order = np.lexsort((-score, ids))
            order = order[np.unique(ids[order], return_index=True)[1]]
            score, ids = score[order], ids[order]
        if len(score) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            ok = score >= least
            score, ids = score[ok], ids[ok]
        order = np.lexsort((ids, -score))[:k]
        return list(zip(ids[order].tolist(), score[order].tolist()))


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score for rows of a query block (q…) and a bucket (b…)."""

    def run(batches):
        last, bucket = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["block"] != last:
                    last, bucket = r["block"], Bucket(r["dim"], r["ids"], r["vectors"])
                qids = np.frombuffer(r["qids"], np.int64)
                qv = np.frombuffer(r["qvectors"], np.int64).reshape(len(qids), r["dim"])
                bounds = np.frombuffer(r["bounds"], np.float64) if r["bounds"] else np.full(len(qids), -np.inf)
                out = [(i, v, s) for i, q, t in zip(qids.tolist(), qv, bounds) for v, s in bucket.best(i, q, t, k)]
                cols = list(zip(*out)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def _step(norm: Column) -> Column:
    return F.floor(F.log2(F.greatest(norm, F.lit(1.0))) * STEPS).cast("int")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` other vec_ids with the largest inner products of
    every query with vectors of its dimension. Scores are longs: if the square of the longest norm
    (after scaling) does not fit one, a ValueError says so before any score is made."""
    spark = vectors.sparkSession
    all_ = write_stage(integers(vectors, scale).dropDuplicates(["vec_id", "v"]), scratch_path(spark, "integers"))
    total, longest = all_.agg(F.count("*"), F.max("norm")).first()
    if (longest or 0) >= 2**31.5:
        raise ValueError(f"inner products of vectors with a norm of {longest:.3g} (scaled by {scale}) do not fit a long")
    parts = max(1, -(-total // BUCKET))
    ranged = all_.repartitionByRange(parts, F.col("dim"), F.col("norm").desc(), F.col("vec_id")).sortWithinPartitions("dim", F.col("norm").desc(), "vec_id")
    buckets = write_stage(_blocks(ranged, BUCKET), scratch_path(spark, "buckets"))
    asked = all_.where(is_query)
    asked = asked.repartition(max(1, -(-asked.count() // QUERIES)), "vec_id").sortWithinPartitions("dim", "vec_id")
    blocks = write_stage(_blocks(asked, QUERIES), scratch_path(spark, "queries")).select(F.col("block").alias("qblock"), "dim", F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"))
    sides = ["block", "dim", "ids", "vectors", "qids", "qvectors", "bounds"]
    heads = buckets.groupBy("dim").agg(F.min("block").alias("block"))  # the bucket of the longest vectors
    first = buckets.join(heads, ["dim", "block"], "left_semi")
    begun = _search(blocks.join(first, "dim").withColumn("bounds", F.lit(None).cast("binary")).select(sides), k)
    begun = write_stage(begun, scratch_path(spark, "begun"))
    least = _ranked(begun, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))

    def bounds(batches):  # the bounds of a block's queries, in its order, and the least norm that can reach one
        for b in batches:
            for r in b.to_pylist():
                got = {x["query_id"]: float(x["bound"]) for x in r["least"] or ()}
                ids = np.frombuffer(r["qids"], np.int64)
                bound = np.array([got.get(i, -np.inf) for i in ids.tolist()])
                size = np.linalg.norm(np.frombuffer(r["qvectors"], np.int64).reshape(len(ids), r["dim"]).astype(np.float64), axis=1)
                reach = np.where(bound > 0, bound / np.maximum(size, 1e-300), 0).min(initial=np.inf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["qblock"]], pa.int64()), pa.array([r["dim"]], pa.int32()), pa.array([reach * (1 - 1e-9)], pa.float64()), pa.array([bound.tobytes()], pa.binary())],
                    ["qblock", "dim", "reach", "bounds"])

    member = blocks.select("qblock", F.col("qids")).mapInArrow(_members, "qblock long, query_id long")
    per = member.join(least, "query_id").groupBy("qblock").agg(F.collect_list(F.struct("query_id", "bound")).alias("least"))  # QUERIES at most
    bounded = blocks.join(per, "qblock", "left").mapInArrow(bounds, "qblock long, dim int, reach double, bounds binary")
    bounded = write_stage(bounded, scratch_path(spark, "bounds"))
    # a block meets the buckets whose longest vector reaches its least bound: found by steps of the norm, before any vector moves
    steps = F.explode(F.sequence(_step(F.col("reach")), F.lit(32 * STEPS)))
    need = bounded.select("qblock", "dim", "reach", steps.alias("step"))
    rest = buckets.join(heads, ["dim", "block"], "left_anti")
    grid = need.join(rest.select("dim", "block", "longest", _step(F.col("longest")).alias("step")), ["dim", "step"]).where("longest >= reach").select("qblock", "block")
    grid = write_stage(grid, scratch_path(spark, "grid"))
    pairs = grid.join(blocks.join(bounded.select("qblock", "bounds"), "qblock").drop("dim"), "qblock").join(buckets, "block")
    found = begun.unionByName(_search(pairs.select(sides), k))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` vec_ids of each query in rows that may repeat them."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)


def _members(batches):
    for b in batches:
        for block, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block)), pa.array(n)], ["qblock", "query_id"])
