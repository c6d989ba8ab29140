"""Global rankings without a single-partition window (H4).

``PERCENT_RANK() OVER (ORDER BY x)`` and ``NTILE(k) OVER (ORDER BY x)`` with no PARTITION BY
make Spark move every row to one task (``Exchange SinglePartition`` under ``Window``). What the
tiles and the percentile bands need of the order is only the few rows at their borders:

1. The key columns alone are range-partitioned (with a unique tiebreak, which splits heavy ties),
   sorted inside each partition and written to a scratch table. Range bounds are sampled, so the
   passes below must see this one partitioning.
2. Row counts per partition — n small rows — tell in which partition, and where in it, a wanted
   row stands; ``monotonically_increasing_id()`` (partition << 33 | position) is filtered for it.
3. The border rows become literals, and every row of the table is scored by comparing with them in
   one projection: no numbering, no join back, no rewrite of the table. The scratch table is
   dropped as soon as the borders are read.

``global_row_number`` numbers all rows where each row's own number is needed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.sources.stage import drop_path, scratch_path, write_stage

_LOW_BITS = (1 << 33) - 1


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


class Key(NamedTuple):
    """A sort column; nulls come first when ascending and last when descending."""

    name: str
    ascending: bool = True

    def order(self) -> Column:
        c = F.col(self.name)
        return c.asc_nulls_first() if self.ascending else c.desc_nulls_last()

    def after(self, border: Any, kind: str) -> Column:
        """Does a row sort strictly after ``border`` (a value of this column, of type ``kind``)?"""
        c = F.col(self.name)
        if border is None:
            return c.isNotNull() if self.ascending else F.lit(False)
        b = F.lit(border).cast(kind)
        return F.when(c.isNull(), F.lit(not self.ascending)).otherwise(c > b if self.ascending else c < b)


def _after(df: DataFrame, keys: list[Key], border) -> Column:
    """Does a row sort strictly after the row ``border`` by ``keys``?"""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def step(rest: Column, k: Key) -> Column:
        same = F.col(k.name).eqNullSafe(F.lit(border[k.name]).cast(kinds[k.name]))
        return k.after(border[k.name], kinds[k.name]) | (same & rest)

    return reduce(step, reversed(keys), F.lit(False))


def border_rows(df: DataFrame, keys: list[Key], positions: Callable[[int], list[int]],
                num_partitions: int | None = None) -> tuple[int, dict[int, Any]]:
    """The number of rows and the rows (``keys`` only) at 1-based ``positions(number of rows)`` of the
    order by ``keys``."""
    spark = df.sparkSession
    order = [k.order() for k in keys]
    ranged = (
        df.select(*[k.name for k in keys])
        .repartitionByRange(_num_partitions(df, num_partitions), *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    path = scratch_path(spark, "borders")
    try:
        staged = write_stage(ranged, path)
        counts = sorted(tuple(r) for r in staged.groupBy(F.shiftright("_mid", 33)).count().collect())
        total = sum(c for _, c in counts)
        wanted, before = {}, 0
        todo = sorted(set(positions(total)))
        for part, count in counts:
            wanted |= {(part << 33) + at - before - 1: at for at in todo if before < at <= before + count}
            before += count
        found = staged.where(F.col("_mid").isin(list(wanted))).collect() if wanted else []
        return total, {wanted[r["_mid"]]: r for r in found}
    finally:
        drop_path(spark, path)


def global_row_number(df: DataFrame, order_by: list[Column], out: str = "row_number",
                      num_partitions: int | None = None) -> tuple[DataFrame, int]:
    """Add ``out`` = ``ROW_NUMBER() OVER (ORDER BY order_by)`` (1-based); returns (df, N).

    ``order_by`` must be a total order (end it with a unique column) for a deterministic result,
    as SQL's own ROW_NUMBER needs.
    """
    spark = df.sparkSession
    n = _num_partitions(df, num_partitions)
    ranged = (
        df.repartitionByRange(n, *order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    staged = write_stage(ranged, scratch_path(spark, "rownum"))
    pid = F.shiftright(F.col("_mid"), 33)
    counts = sorted(tuple(r) for r in staged.groupBy(pid.alias("_pid")).count().collect())
    offsets, total = [], 0
    for p, c in counts:
        offsets.append((int(p), total))
        total += int(c)
    off_df = spark.createDataFrame(offsets or [(0, 0)], "_pid long, _off long")
    numbered = (
        staged.withColumn("_pid", pid)
        .join(F.broadcast(off_df), "_pid", "left")
        # bigint: no 2^31-row limit (Spark's own row_number is an int)
        .withColumn(out, (F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)) + F.coalesce(F.col("_off"), F.lit(0)) + 1)
                    .cast("bigint"))
        .drop("_mid", "_pid", "_off")
    )
    return numbered, total


def global_ntile(df: DataFrame, k: int, keys: list[Key], out: str = "ntile",
                 num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = ``NTILE(k) OVER (ORDER BY keys)``; end ``keys`` with a unique column.

    The first ``rows mod k`` tiles get one row more; the borders are the last rows of the tiles."""

    def last_of_tiles(total: int) -> list[int]:
        q, m = divmod(total, k)
        ends = [i * q + min(i, m) for i in range(1, k)]
        return [e for e in ends if 0 < e < total]

    _, borders = border_rows(df, keys, last_of_tiles, num_partitions)
    tile = reduce(lambda n, row: n + _after(df, keys, row).cast("int"), borders.values(), F.lit(1))
    return df.withColumn(out, tile.cast("int"))


def percentile_above(df: DataFrame, key: Key, thresholds: list[float], tiebreak: list[str] | None = None,
                     num_partitions: int | None = None) -> list[Column]:
    """For each threshold, the condition ``PERCENT_RANK() OVER (ORDER BY key) * 100 > threshold``.

    A row's percent rank is the number of rows before its value over (rows - 1). That many are at
    least c exactly if the row sorts after the c-th row, so each condition is one comparison.
    ``tiebreak`` only spreads equal values over the ranges."""

    def least_before(total: int, t: float) -> int:
        """The least number of rows before a value whose percent rank is above ``t``."""
        if total <= 1:
            return 0 if t < 0 else total
        span = total - 1
        c = max(0, int(t / 100 * span) - 2)
        while c <= span and not c / span * 100 > t:
            c += 1
        return c

    total, rows = border_rows(df, [key, *[Key(c) for c in tiebreak or []]],
                              lambda n: [c for c in (least_before(n, t) for t in thresholds) if 0 < c < n], num_partitions)
    return [F.lit(c == 0) if c not in rows else _after(df, [key], rows[c])
            for c in (least_before(total, t) for t in thresholds)]
