"""A dimension's attributes met by rows that stay where they are.

A join with a dimension too large to broadcast shuffles and sorts every row of the other side. But what the rows
take from it are often few different values under many keys: then one small number a key is all that has to be
broadcast. :func:`lookup` packs these numbers into arrays of ``BUCKET`` consecutive keys (a byte or two a key) beside
the table of the different values, and checks all it relies on in the data: whole-number keys, dense enough, each
listed with one value of its attributes, and few different values. Where any of this does not hold it returns None,
and the caller joins the dimension as usual.

At most 2 * ``MOST_KEYS`` bytes and ``MOST_VALUES`` rows are broadcast, whatever the dimension.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, IntegralType, StructField, StructType

from tillroll.operators.perkey import Keep, scratch

BUCKET = 256
#: Numbers between the least and the largest key: 64 MB of codes.
MOST_KEYS = 2**25
#: Numbers between the least and the largest key for each key, from which the arrays would be mostly empty.
SPARSE = 16
MOST_VALUES = 10_000
#: Bytes, by Spark's estimate, up to which a dimension that Spark broadcasts by itself is left to it.
SMALL = 2**20
#: How often the dimension lists a key.
TIMES = "_times"


class Lookup(NamedTuple):
    """``codes``: _bucket and _codes; ``values``: _code, the attributes and ``TIMES``; ``once``: no key is listed twice."""

    attrs: list[str]
    codes: DataFrame
    values: DataFrame
    once: bool

    def fits(self, rows: DataFrame, key: str) -> bool:
        return isinstance(rows.schema[key].dataType, IntegralType)

    def attach(self, rows: DataFrame, key: str, times: str | None = None, how: str = "inner") -> DataFrame:
        """``rows`` with the attributes of their ``key``, each once however often the dimension lists it (``times``: the column
        to tell how often). Rows whose key it does not list are left out, or with ``how="left"`` get nulls."""
        bucket, place = _places(key)
        told = (rows.withColumn("_bucket", bucket).join(F.broadcast(self.codes), "_bucket", how)
                .withColumn("_code", F.get("_codes", place)))
        values = self.values.select("_code", *self.attrs, *([F.col(TIMES).alias(times)] if times else []))
        return (told.drop("_bucket", "_codes").join(F.broadcast(values), "_code", how)
                .select(*rows.columns, *self.attrs, *([times] if times else [])))


def _places(key: str) -> tuple[Column, Column]:
    """The bucket of a key and its place in there."""
    k = F.col(key).cast("long")
    return F.shiftright(k, 8), k.bitwiseAND(F.lit(BUCKET - 1)).cast("int")


def _size(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_by_spark(dim: DataFrame) -> bool:
    """Whether Spark's size check lets a join broadcast ``dim``."""
    return _size(dim) <= dim.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def lookup(dim: DataFrame, key: str, attrs: list[str], name: str, keep: Keep | None = None) -> Lookup | None:
    """What :class:`Lookup` needs of ``dim``, or None where it does not fit. Only counts and the different values
    (``MOST_VALUES`` rows at most) reach the driver."""
    keep = keep or scratch
    if not isinstance(dim.schema[key].dataType, IntegralType):
        return None
    dim = dim.select(key, *attrs)
    if broadcast_by_spark(dim) and _size(dim) <= SMALL:
        return None
    rows = dim.where(F.col(key).isNotNull())
    low, high, n = rows.agg(F.min(key).cast("decimal(20,0)"), F.max(key).cast("decimal(20,0)"), F.count(F.lit(1))).first()
    if not n or high - low >= min(MOST_KEYS, SPARSE * max(n, BUCKET)):
        return None
    counted = keep(f"{name}_counted", rows.groupBy(key, *attrs).agg(F.count(F.lit(1)).alias(TIMES)))
    values = sorted((tuple(r) for r in counted.select(*attrs, TIMES).distinct().limit(MOST_VALUES + 1).collect()), key=repr)
    if len(values) > MOST_VALUES:
        return None
    kept = counted.select(*attrs, TIMES).schema
    numbered = dim.sparkSession.createDataFrame([(i, *v) for i, v in enumerate(values)], StructType([StructField("_code", IntegerType()), *kept.fields]))
    told = keep(f"{name}_values", numbered.coalesce(1))
    bucket, place = _places(key)
    if counted.groupBy(bucket.alias("_bucket")).count().where(F.col("count") > BUCKET).head(1):  # keys with several values
        return None
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"v.{c}")) for c in [*attrs, TIMES]])
    pairs = counted.alias("l").join(F.broadcast(told.alias("v")), same).select(bucket.alias("_bucket"), F.struct(place.alias("place"), F.col("_code").alias("code")).alias("_pair"))
    found = keep(f"{name}_pairs", pairs.groupBy("_bucket").agg(F.collect_list("_pair").alias("_pairs")))
    if found.where("size(array_distinct(_pairs.place)) < size(_pairs)").head(1):
        return None
    kind = "tinyint" if len(values) <= 128 else "smallint"
    codes = F.expr(f"transform(sequence(0, {BUCKET - 1}), i -> cast(get(_pairs.code, cast(array_position(_pairs.place, i) as int) - 1) as {kind}))")
    return Lookup(attrs, keep(f"{name}_codes", found.select("_bucket", codes.alias("_codes"))), told, all(v[-1] == 1 for v in values))
