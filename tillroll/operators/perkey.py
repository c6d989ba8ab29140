"""Facts of a key (an order, a line's attributes) met by the rows of that key, whatever the key's share.

Spark splits a skewed partition of a sort-merge join only where both sides come straight from a
shuffle, and only where nothing above the join relies on its partitioning. An aggregate by the join
key keeps its own shuffle and so forbids the split: a key with a third of all rows is then one task.
Hence the two rules of this module:

* the per-key facts are written first (a table of one small row a key, often far smaller than the
  rows) and joined as a plain scan (:func:`join_facts`, :func:`rows_with`);
* what groups the joined rows by a superset of the key is fed through a shuffle of its own
  (:func:`dealt_by`), so that the join below stays free to be split.

The written table also cuts the lineage: a lost executor costs tasks of the join, not the aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tillroll.sources.stage import scratch_path, write_stage

#: Writes a table under a name and returns it as read back.
Keep = Callable[[str, DataFrame], DataFrame]


def scratch(name: str, df: DataFrame) -> DataFrame:
    """Keep ``df`` in a fresh scratch folder; a batch gives its stage store instead."""
    return write_stage(df, scratch_path(df.sparkSession, name))


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], name: str, how: str = "left", keep: Keep | None = None) -> DataFrame:
    """``rows`` with the columns of ``facts``, at most one row a key, on equal ``keys``."""
    return rows.join((keep or scratch)(name, facts), keys, how)


def rows_with(rows: DataFrame, facts: DataFrame, keys: list[str], name: str, keep: Keep | None = None) -> DataFrame:
    """The ``rows`` whose keys are in ``facts``."""
    return join_facts(rows, facts, keys, name, "left_semi", keep)


#: Bits of :func:`likely_with`'s filter: 16 MB, whatever the rows.
FILTER_BITS = 2**27


def _flagged(rows: DataFrame, wanted: DataFrame, number: Column, flag: str) -> DataFrame:
    """``rows`` with ``flag``: whether ``number`` (at least 0, less than ``FILTER_BITS``; null: no) of a row is that of one of ``wanted``."""
    bits = wanted.select(F.bitmap_bucket_number(number).alias("_bucket"), F.bitmap_bit_position(number).alias("_bit")).repartition("_bucket")
    bits = bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    bit = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    told = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) != 0
    return (rows.withColumn("_bucket", F.bitmap_bucket_number(number)).join(F.broadcast(bits), "_bucket", "left")
            .select(*rows.columns, F.coalesce(told, F.lit(False)).alias(flag)))


def likely_in(rows: DataFrame, wanted: DataFrame, key: str, flag: str = "_likely") -> DataFrame:
    """``rows`` with a boolean ``flag``: true where ``key`` is in ``wanted``, and for a few others (4 % of them at five million
    wanted keys): a bit of the key's hash is looked up in bitmaps that are broadcast. Rows of one key get one answer."""
    return _flagged(rows, wanted, F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)), flag)


def marked(rows: DataFrame, wanted: DataFrame, key: str, flag: str = "_in") -> DataFrame | None:
    """``rows`` with a boolean ``flag``: whether ``key`` is in ``wanted`` (a written table), exactly and without a shuffle of the
    rows: a bit a key, in bitmaps that are broadcast. None where keys are no whole numbers or span more than ``FILTER_BITS``."""
    if not all(isinstance(df.schema[key].dataType, IntegralType) for df in (rows, wanted)):
        return None
    low, high = wanted.agg(F.min(key), F.max(key)).first()
    if low is None:
        return rows.withColumn(flag, F.lit(False))
    if high - low >= FILTER_BITS:
        return None
    k = F.col(key).cast("long")
    return _flagged(rows, wanted, F.when(k.between(low, high), k - F.lit(low).cast("long")), flag)


def members(rows: DataFrame, wanted: DataFrame, key: str, has: bool = True) -> DataFrame:
    """The ``rows`` whose ``key`` is in ``wanted`` (a written table), or with ``has=False`` the others."""
    told = marked(rows, wanted, key)
    if told is None:
        return rows.join(wanted, key, "left_semi" if has else "left_anti")
    return told.where(F.col("_in") if has else ~F.col("_in")).select(*rows.columns)


def likely_with(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is in ``wanted``, and a few others (:func:`likely_in`), so that an exact join behind it
    shuffles few of the rows."""
    return likely_in(rows, wanted, key).where("_likely").select(*rows.columns)


def dealt_by(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` shuffled by all of ``columns`` (which spread a hot key), for a grouping by them."""
    return rows.repartition(*columns)
