"""Top-k, top-k per group and share-of-total operators.

* :func:`top_k` is ``orderBy().limit()``, planned as ``TakeOrderedAndProject``: each task keeps
  its own k best rows and only k × tasks rows meet at the end.
* :func:`top_k_per_group` is ``row_number() over (partition by g order by …) <= k``, planned with
  ``WindowGroupLimit`` so each task drops rows beyond k before the shuffle.
* :func:`share_of_total` divides by a grand total taken as a scalar subquery over the
  per-key aggregate (one value), not by a cross join or a global window.

Ties: SQL's TOP and ROW_NUMBER are nondeterministic on ties; every ordering here ends with a
tiebreak column so that results are repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.exprs import percent


def top_k(df: DataFrame, order_by: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order_by).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], order_by: list[Column], k: int, out: str = "rn") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order_by)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def grand_totals(per_key: DataFrame, *values: str) -> list[Column]:
    """``SUM`` of each of ``values`` over the rows of a per-key aggregate, as scalar subquery columns.

    Name every aggregated column of ``per_key``: the subquery then reads the same aggregate as the
    report, whose exchange is reused. All sums come from one subquery (a struct).
    """
    if len(values) == 1:
        return [per_key.select(F.sum(values[0])).scalar()]
    sums = per_key.select(F.struct(*[F.sum(v).alias(v) for v in values])).scalar()
    return [sums.getField(v) for v in values]


def share_of_total(part: str | Column, total: Column, digits: int | None = None) -> Column:
    """``part * 100.0 / total`` in double, optionally ``ROUND(…, digits)``."""
    p = percent(part, total)
    return F.round(p, digits) if digits is not None else p
