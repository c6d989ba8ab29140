"""Discrepancy checks and repairs.

D3 and D6 (the per-order store and date repairs) live in :mod:`tillroll.operators.reconcile`
because the clean fact table is built from them; they are re-exported here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tillroll.operators.perkey import Keep, dealt_by, likely_with, rows_with, scratch
from tillroll.operators.reconcile import (  # noqa: F401  (re-exported)
    BILL_MONTH, fix_date_to_latest, fix_store_to_min, month_number, orders_with_spread,
)
from tillroll.sources.tables import PRODUCT_ATTRS

CUMULATIVE_KEYS = ["customer_id", "product_id", "channel", "delivered_storeid", "bill_date_timestamp",
                   "cost_per_unit", "mrp", "discount"]


def row_digest(df: DataFrame) -> Column:
    """128 bits of a whole row. Rows that differ may share it (nulls are passed over, for one), so it only narrows."""
    return F.struct(F.xxhash64(*df.columns).alias("h1"), F.xxhash64(F.lit(1), *df.columns).alias("h2"))


def exact_duplicates(df: DataFrame, keep: Keep | None = None) -> DataFrame:
    """D1 — rows that occur more than once, with ``duplicate_count`` (GROUP BY every column).

    Digests first: 16 bytes a row are shuffled to find the digests that repeat, and only rows with one of these
    are compared whole. Duplicates are few, so the wide rows mostly stay where they are."""
    digest = row_digest(df)
    repeated = df.select(digest.alias("_d")).groupBy("_d").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_d")
    repeated = (keep or scratch)("repeated_digests", repeated)
    if not repeated.head(1):
        rows = df.where(F.lit(False))
    else:
        rows = dealt_by(df.withColumn("_d", digest).join(repeated, "_d", "left_semi").drop("_d"), df.columns)
    return rows.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("duplicate_count")).where(F.col("duplicate_count") > 1)


def rows_of_orders_with_spread(df: DataFrame, column: str, keep: Keep | None = None) -> DataFrame:
    """Rows whose order has more than one distinct value of ``column`` (``order_id IN (…)``)."""
    return rows_with(df, orders_with_spread(df, column), ["order_id"], f"orders_of_several_{column}", keep)


def multi_store_orders(df: DataFrame) -> DataFrame:
    """D2 — how many rows (and orders) belong to orders delivered from several stores: both are sums
    over one aggregate per order, so the rows are read once and joined with nothing."""
    store = F.col("delivered_storeid")
    orders = (df.where(F.col("order_id").isNotNull()).groupBy("order_id")
              .agg(F.count(F.lit(1)).alias("_rows"), F.min(store).alias("_lo"), F.max(store).alias("_hi"))
              .where(F.col("_lo") < F.col("_hi")))
    return orders.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("no_of_discrepant_orders"),
                      F.count("order_id").alias("no_of_distinct_orders"))


def cumulative_lines(df: DataFrame, keys: list[str] | None = None, keep: Keep | None = None) -> DataFrame:
    """D4 — lines that look like a running total of an earlier line: within the same customer,
    product, channel, store, bill time and prices, any line whose quantity is below the largest
    (``RANK() … ORDER BY quantity DESC > 1``), with its ``rnk``.

    The reference joins the ranked rows back to the table on the 8 keys plus quantity; rank is a
    function of those 9 values, so that join returns the same lines, each repeated once per row
    sharing its 9 values, and drops lines with a null key. We return each line once and drop
    null keys explicitly.

    Scale: only key groups whose quantities differ can hold a rank above 1, so they are found
    first with a partial aggregate (``min < max``) over a digest of the keys (8 bytes a line; groups that share one are
    ranked apart later) and the lines are narrowed to them by a semi-join, both written; the rank is then 1 + the number of rows with a larger quantity, computed
    from the counts per (keys, quantity) with a window over the distinct quantities of a group — never
    over all its rows — and joined back on the 9 values. A hot key group is never sorted in one
    task, and AQE splits a hot key on the joins' large side.
    """
    keep = keep or scratch
    keys = keys or CUMULATIVE_KEYS
    cols = keys + ["quantity"]
    not_null = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    rows = df.where(not_null)
    digest = F.xxhash64(*keys).alias("_d")
    varied = keep("varied_keys", rows.select(digest, "quantity").groupBy("_d").agg(F.min("quantity").alias("_lo"), F.max("quantity").alias("_hi"))
                  .where(F.col("_lo") < F.col("_hi")).select("_d"))
    candidates = keep("lines_of_varied_keys", likely_with(rows.select("*", digest), varied, "_d").join(varied, "_d", "left_semi").select(*df.columns))
    counts = candidates.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    larger = Window.partitionBy(*keys).orderBy(F.col("quantity").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        counts.withColumn("rnk", (F.lit(1) + F.coalesce(F.sum("_n").over(larger), F.lit(0))).cast("int"))
        .where(F.col("rnk") > 1)
        .drop("_n")
    )
    return candidates.join(keep("ranks_of_quantities", ranks), cols).select(*df.columns, "rnk")


def multi_date_orders(df: DataFrame, keep: Keep | None = None) -> DataFrame:
    """D5 — order_id of every row whose order has more than one distinct bill date."""
    return rows_of_orders_with_spread(df, "bill_date_timestamp", keep).select("order_id")


def outside(ts: Column, start: str, end: str) -> Column:
    return (ts < F.lit(start).cast("timestamp_ntz")) | (ts > F.lit(end).cast("timestamp_ntz"))


def out_of_period(df: DataFrame, start: str, end: str) -> DataFrame:
    """D7 — rows billed before ``start`` or after ``end`` (timestamps compared at midnight, so a
    line on the last day after 00:00 counts as outside, as in the reference). A fact with ``BILL_MONTH`` is
    read from its first month to ``start``'s and from ``end``'s to its last; the months between are not opened."""
    rows = df.where(outside(F.col("bill_date_timestamp"), start, end))
    if BILL_MONTH not in df.columns:
        return rows
    month = F.col(BILL_MONTH)
    return rows.where((month <= month_number(start)) | (month >= month_number(end))).drop(BILL_MONTH)


def multi_customer_orders(df: DataFrame) -> DataFrame:
    """D8 — orders billed to more than one distinct customer."""
    return orders_with_spread(df, "customer_id")


def fix_na_category(products: DataFrame, sentinel: str = "#N/A", replacement: str = "Others") -> DataFrame:
    """D9 — category '#N/A' becomes 'Others'."""
    cat = F.col("category")
    return products.withColumn("category", F.when(cat == F.lit(sentinel), F.lit(replacement)).otherwise(cat))


def fix_missing_attributes(products: DataFrame, attrs: list[str] | None = None, replacement: str = "Others") -> DataFrame:
    """D10 — category becomes 'Others' when any product attribute is null."""
    attrs = attrs or PRODUCT_ATTRS
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in attrs])
    return products.withColumn("category", F.when(any_null, F.lit(replacement)).otherwise(F.col("category")))
