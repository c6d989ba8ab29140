"""Exact and approximate distinct counts that merge: bitmaps and sketches per base cell.

A report at several levels (a cube, a drill-down) would count distinct orders anew at each level, over
copies of the rows. Here each base cell keeps what it has seen in a form that merges:

* bitmaps, exact: a value is one bit of a bucket of 32,768 consecutive numbers
  (``bitmap_bucket_number``), a level's count is the bits of its cells or-ed bucket by bucket;
* HyperLogLog sketches, approximate: a few kilobytes a cell, whatever its rows.

Levels then cost work in cells, not in rows. Values that are no whole numbers, or spread so thinly that
most bits of a bucket would stay empty, are numbered densely first (:func:`numbered`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tillroll.operators.perkey import Keep, scratch
from tillroll.operators.ranking import global_row_number

#: Numbers between the least and the largest value for each value, from which values are numbered densely.
SPARSE = 64


def numbered(rows: DataFrame, value: str, name: str, keep: Keep | None = None) -> DataFrame:
    """``rows`` with ``_id``: a number for each value of ``value``, itself where that is a whole number and
    dense enough, else its place among the sorted distinct values."""
    keep = keep or scratch
    if isinstance(rows.schema[value].dataType, IntegralType):
        low, high, n = rows.agg(F.min(value).cast("decimal(20,0)"), F.max(value).cast("decimal(20,0)"), F.approx_count_distinct(value)).first()
        if n == 0 or high - low < SPARSE * max(n, 32_768):
            return rows.withColumn("_id", F.col(value).cast("long"))
    places, _ = global_row_number(rows.select(value).where(F.col(value).isNotNull()).distinct(), [F.col(value)], "_id")
    return rows.join(keep(name, places), value, "left")


def bitmaps(rows: DataFrame, cell: list[str]) -> DataFrame:
    """``cell``, _bucket and _bits of the numbers ``_id`` in each cell. Rows are dealt by bucket before they meet a bitmap:
    a task then fills whole bitmaps of few buckets, not a sparse one for nearly every row it holds."""
    rows = rows.where(F.col("_id").isNotNull()).select(*cell, F.bitmap_bucket_number("_id").alias("_bucket"), F.bitmap_bit_position("_id").alias("_bit"))
    return rows.repartition("_bucket").groupBy(*cell, "_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def at_levels(cells: DataFrame, cell: list[str], levels: list[int]) -> DataFrame:
    """``cells`` once for each grouping id in ``levels``, with the columns that it leaves out set to null
    (bit by bit from the last column, as ``grouping_id()``), and the id as _level."""
    copies = cells.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels])))
    return copies.select("_level", *[F.when(F.col("_level").bitwiseAND(1 << (len(cell) - 1 - i)) == 0, F.col(c)).alias(c) for i, c in enumerate(cell)],
                         *[c for c in cells.columns if c not in cell])


def _counted(bits: DataFrame, cell: list[str], levels: list[int], out: str) -> DataFrame:
    merged = at_levels(bits, cell, levels).groupBy("_level", *cell, "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))
    return merged.groupBy("_level", *cell).agg(F.sum(F.bitmap_count("_bits")).alias(out))


def merged_levels(sums: DataFrame, cell: list[str], levels: list[int], adds: list[str], bits: dict[str, tuple[DataFrame, list[int]]]) -> DataFrame:
    """_level, ``cell``, the sums of ``adds`` over ``sums`` and for each name of ``bits`` the distinct count over its
    bitmaps, at the levels given with them. Levels are put together by a union, not by joins on nullable keys."""
    parts = [at_levels(sums, cell, levels).groupBy("_level", *cell).agg(*[F.sum(a).alias(a) for a in adds])]
    parts += [_counted(b, cell, at, name) for name, (b, at) in bits.items()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.groupBy("_level", *cell).agg(*[F.sum(a).alias(a) for a in adds], *[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in bits])


def sketch(value: str, precision: int = 14) -> Column:
    """A HyperLogLog sketch of ``value`` (2^precision registers: about 1.04 / 2^(precision / 2) relative error)."""
    return F.hll_sketch_agg(value, F.lit(precision))


def merged_sketches(cells: DataFrame, cell: list[str], levels: list[int], adds: list[str], sketches: dict[str, str]) -> DataFrame:
    """As :func:`merged_levels`, with counts estimated from the united ``sketches`` (output name: column of cells)."""
    return at_levels(cells, cell, levels).groupBy("_level", *cell).agg(
        *[F.sum(a).alias(a) for a in adds],
        *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(name) for name, c in sketches.items()])
