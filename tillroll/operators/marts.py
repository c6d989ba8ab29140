"""Customer, order and store "360" marts (M1–M3).

Faithful to the reference by default: ``customer_360`` and ``orders_360`` join every fact line
with every payment row of its order before summing, so an order paid in n parts counts n times
in revenue, quantity, profit and transaction counts; ``store_360`` joins the store table without
removing its duplicate rows. ``dedupe_payments=True`` gives the un-inflated figures.

How the fan-out is computed at scale: payments are first reduced to one row per order (payment
count and per-type counts), and each fact line is joined with that single row and weighted by
the count. The sums are the same as over the fanned-out rows, but an order with many lines and
many payments never produces lines × payments rows. Distinct counts and min/max are not changed
by repetition, so they are taken over the fact lines directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.perkey import Keep, join_facts
from tillroll.functions.exprs import days_between, is_weekend, month_name, ratio, percent
from tillroll.sources.tables import CUSTOMER_COLS, STORE_COLS

# The payment types the reference counts separately, and its column suffixes.
PAYMENT_TYPES = {
    "voucher": "voucher",
    "credit_card": "creditcard",
    "debit_card": "debitcard",
    "upi/cash": "upi_or_cash",
}


SUMMARY_COLS = ["_np", *[f"_n_{s}" for s in PAYMENT_TYPES.values()], "_types"]


def payments_per_order(payments: DataFrame) -> DataFrame:
    """C2 and :func:`payment_summary` by one grouping of the payments."""
    return payments.groupBy("order_id").agg(F.round(F.sum("payment_value"), 0).alias("paymenttotal"), *_summary())


def payment_summary(payments: DataFrame) -> DataFrame:
    """One row per order: ``_np`` payment rows, ``_n_<type>`` rows per counted type
    (case-insensitive) and ``_types``, the different types (no more than there are payment types)."""
    return payments.groupBy("order_id").agg(*_summary())


def _summary() -> list[Column]:
    ptype = F.lower(F.col("payment_type"))
    return [
        F.count(F.lit(1)).cast("bigint").alias("_np"),
        *[F.sum(F.when(ptype == F.lit(t), 1).otherwise(0)).cast("bigint").alias(f"_n_{s}")
          for t, s in PAYMENT_TYPES.items()],
        F.array_sort(F.collect_set(ptype)).alias("_types"),
    ]


def paid_lines(fact: DataFrame, payments: DataFrame | None, dedupe: bool = False, keep: Keep | None = None) -> DataFrame:
    """Fact lines of orders with at least one payment, with the order's payment summary and the
    weight ``_w`` = payment rows of the order (the reference's fan-out), or 1 with ``dedupe``.

    ``payments=None`` says that the fact carries the summary (the cleaning batch's fact stage appends it
    in the per-order join of C12) and is only filtered; otherwise the summary of ``payments`` is joined,
    whatever the fact carries."""
    if payments is None:
        missing = [c for c in SUMMARY_COLS if c not in fact.columns]
        if missing:
            raise ValueError(f"a fact without payments must carry their summary; it has no {', '.join(missing)}")
        lines = fact.where(F.col("_np").isNotNull())
    else:
        lines = join_facts(fact.drop(*SUMMARY_COLS), payment_summary(payments), ["order_id"], "payment_summary", "inner", keep)
    return lines.withColumn("_w", F.lit(1).cast("bigint") if dedupe else F.col("_np"))


def weight(n: Column) -> Column:
    """A row count as ``decimal(9,0)``. More than that many rows of one key are an error in every
    session, never a null that a later sum would drop."""
    return F.when(n < 1_000_000_000, n).otherwise(F.raise_error(F.lit("a key with 10^9 rows or more"))).cast("decimal(9,0)")


def _w(c: Column) -> Column:
    """A fact-line value repeated once per payment row of its order — ``_w`` times.

    The weight is ``decimal(9,0)`` so that a ``decimal(28,8)`` money value times the weight stays
    within 38 digits without Spark dropping scale."""
    return c.cast("decimal(28,8)") * weight(F.col("_w"))


def _wn(c: Column) -> Column:
    """Integer value (quantity) or indicator times the weight, as a bigint."""
    return c.cast("bigint") * F.col("_w")


def _payment_counters(per_order: bool = False) -> list[Column]:
    """Payment rows per type: per fact line (faithful fan-out) or once per order (``max`` of the
    per-order count, constant within an order)."""
    agg = F.max if per_order else F.sum
    return [agg(F.col(f"_n_{s}")).cast("bigint").alias(f"transactions_using_{s}") for s in PAYMENT_TYPES.values()]


def _profit_line() -> Column:
    cost = (F.col("cost_per_unit") * F.col("quantity").cast("decimal(19,0)")).cast("decimal(28,8)")
    return (F.col("total_amount").cast("decimal(28,8)") - cost).cast("decimal(28,8)")


def _distinct(c: str, approx: bool) -> Column:
    """``COUNT(DISTINCT c)``; with ``approx`` HyperLogLog++ (``approx_count_distinct``, about 5%
    relative error). One of these in an aggregate is planned over (key, c) rows; two or more would copy every
    line for each (Expand), so the marts keep to one and use :func:`_kinds` and :func:`_distinct_per_key`."""
    return F.approx_count_distinct(c) if approx else F.countDistinct(c)


def _kinds(c: str, approx: bool) -> Column:
    """The number of different ``c`` of a column with few values (categories, stores and their cities): a set in
    the aggregate's buffer, no larger than the dimension."""
    return F.approx_count_distinct(c) if approx else F.size(F.collect_set(c)).cast("bigint")


def _distinct_per_key(rows: DataFrame, key: str, c: str, out: str, approx: bool) -> DataFrame:
    """``key`` as _key and the distinct ``c`` of each, by an aggregate of its own over the two columns."""
    return rows.groupBy(F.col(key).alias("_key")).agg(_distinct(c, approx).alias(out))


def _global_last_date(fact: DataFrame) -> Column:
    """The latest bill date of all, as a scalar subquery that runs once."""
    return fact.select(F.max("bill_date_timestamp")).scalar()


def customer_360(customers: DataFrame, fact: DataFrame, payments: DataFrame | None, dedupe_payments: bool = False,
                 approx: bool = False) -> DataFrame:
    """M1 — one row per customer with at least one paid fact line.

    The fact lines are aggregated per ``customer_id`` (each distinct count apart from the sums, so
    that no line is copied) and the customer attributes are joined to the much smaller per-customer
    rows afterwards. A customer listed n times in the customer table multiplies the additive
    metrics by n, as the reference's inner join does. ``payments`` as in :func:`paid_lines`.
    """
    lines = paid_lines(fact, payments, dedupe_payments)
    ts = F.col("bill_date_timestamp")
    one = F.lit(1)
    per_cust = lines.groupBy("customer_id").agg(
        F.min(ts).alias("first_transaction_date"),
        F.max(ts).alias("last_transaction_date"),
        F.sum(_wn(F.when(is_weekend(ts), one).otherwise(0))).alias("weekend_transactions"),
        F.sum(_wn(F.when(~is_weekend(ts), one).otherwise(0))).alias("weekday_transactions"),
        F.sum(_wn(F.when(F.col("order_id").isNotNull(), one).otherwise(0))).alias("total_transactions"),
        F.sum(_w(F.col("total_amount"))).alias("total_revenue"),
        F.sum(_wn(F.col("quantity"))).alias("total_quantity_purchased"),
        F.sum(_w(F.col("discount"))).alias("total_discount_taken"),
        F.sum(_w(_profit_line())).alias("profit"),
        *([] if dedupe_payments else _payment_counters()),
    )
    if dedupe_payments:
        # Each payment row once: counters summed over the customer's distinct orders.
        names = [f"_n_{s}" for s in PAYMENT_TYPES.values()]
        orders = lines.groupBy("customer_id", "order_id").agg(*[F.max(n).alias(n) for n in names])
        counters = orders.groupBy("customer_id").agg(
            *[F.sum(F.col(f"_n_{s}")).cast("bigint").alias(f"transactions_using_{s}") for s in PAYMENT_TYPES.values()])
        per_cust = per_cust.join(counters, "customer_id")
    cust = customers.groupBy(*CUSTOMER_COLS).agg(F.count(F.lit(1)).alias("_nc"))
    nc = F.col("_nc")
    ncd = weight(nc)
    last = _global_last_date(fact)
    out = cust.join(per_cust, F.col("custid") == F.col("customer_id")).drop("customer_id")
    # each count apart: sets in the sums' rows outgrow a task's memory, and one distinct count shuffles these rows twice
    for column, name in (("order_id", "total_distinct_transactions"), ("product_id", "distinct_items_purchased"),
                         ("category", "distinct_categories_purchased"), ("delivered_storeid", "distinct_stores_purchased"),
                         ("seller_city", "distinct_cities_purchased")):
        out = out.join(_distinct_per_key(lines, "customer_id", column, name, approx), F.col("custid") == F.col("_key")).drop("_key")
    # orders' sets of payment types: few differ, whatever the number of orders
    types = lines.select(F.col("customer_id").alias("_key"), "_types").distinct().groupBy("_key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("_types")))).cast("bigint").alias("different_payment_types_used"))
    out = out.join(types, F.col("custid") == F.col("_key")).drop("_key")

    def money(c: str) -> Column:
        # per-customer sums fit in decimal(28,8); times decimal(9,0) stays within 38 digits
        return (F.col(c).cast("decimal(28,8)") * ncd).cast("decimal(38,8)").alias(c)

    return out.select(
        F.col("custid").alias("customer_id"), "customer_city", "customer_state", "gender",
        "first_transaction_date", "last_transaction_date",
        days_between("first_transaction_date", "last_transaction_date").alias("tenure"),
        days_between("last_transaction_date", last).alias("inactive_days"),
        *[(F.col(c) * nc).alias(c) for c in ("weekend_transactions", "weekday_transactions", "total_transactions")],
        "total_distinct_transactions",
        money("total_revenue"),
        (F.col("total_quantity_purchased") * nc).alias("total_quantity_purchased"),
        money("total_discount_taken"),
        percent("total_discount_taken", "total_revenue").alias("average_discount_percent"),
        ratio("total_revenue", "total_distinct_transactions").alias("average_order_value"),
        money("profit"),
        "distinct_items_purchased", "distinct_categories_purchased", "distinct_stores_purchased",
        "distinct_cities_purchased",
        "different_payment_types_used",
        *[(F.col(f"transactions_using_{s}") * (F.lit(1) if dedupe_payments else nc)).alias(f"transactions_using_{s}")
          for s in PAYMENT_TYPES.values()],
    )


def orders_360(fact: DataFrame, payments: DataFrame | None, dedupe_payments: bool = False,
               approx: bool = False) -> DataFrame:
    """M2 — one row per (order, customer, channel, bill time) with at least one payment. ``payments`` as
    in :func:`paid_lines`."""
    lines = paid_lines(fact, payments, dedupe_payments)
    ts = F.col("bill_date_timestamp")
    keys = ["order_id", "customer_id", "channel", "bill_date_timestamp"]
    per_order = lines.groupBy(*keys).agg(
        F.sum(_wn(F.when(F.col("product_id").isNotNull(), F.lit(1)).otherwise(0))).alias("total_products_in_order"),
        F.sum(_wn(F.col("quantity"))).alias("total_quantity_in_order"),
        F.sum(_w(F.col("total_amount"))).alias("total_order_value"),
        F.sum(_w(F.col("discount"))).alias("total_discount_on_order"),
        F.sum(_w(_profit_line())).alias("profit"),
        _kinds("category", approx).alias("distinct_categories_in_order"),
        _kinds("seller_city", approx).alias("distinct_seller_cities"),
        _kinds("delivered_storeid", approx).alias("distinct_delivered_stores"),
        *([_distinct("product_id", approx).alias("distinct_products_in_order")] if approx else []),
        F.max(F.size("_types")).cast("bigint").alias("different_payment_types_used"),
        *_payment_counters(per_order=dedupe_payments),
    )
    if not approx:
        # apart from the rest: one aggregate of both would shuffle the sums and sets once a line, not once an order.
        # Put together by a union, not by a join on nullable keys
        products = lines.groupBy(*keys).agg(F.countDistinct("product_id").alias("distinct_products_in_order"))
        both = per_order.unionByName(products, allowMissingColumns=True)
        per_order = both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in both.columns if c not in keys])
    return per_order.select(
        "order_id", "customer_id", "channel", "bill_date_timestamp",
        month_name(ts).alias("order_month"),
        F.quarter(ts).alias("order_quarter"),
        F.year(ts).alias("order_year"),
        "total_products_in_order", "total_quantity_in_order", "total_order_value", "total_discount_on_order",
        percent("total_discount_on_order", "total_order_value").alias("discount_percent"),
        "profit",
        "distinct_categories_in_order", "distinct_seller_cities", "distinct_delivered_stores",
        "distinct_products_in_order", "different_payment_types_used",
        *[f"transactions_using_{s}" for s in PAYMENT_TYPES.values()],
        ratio("total_order_value", "total_quantity_in_order").alias("avg_selling_price_per_product"),
    )


def store_360(fact: DataFrame, stores: DataFrame, approx: bool = False) -> DataFrame:
    """M3 — one row per (store, store attributes) over the fact, with the store table where it has the store.

    The store table is not deduplicated (faithful): a store listed twice doubles its sums. The
    fact is aggregated per store first (a partial aggregate over the big side) and only the
    per-store rows meet the store table.
    """
    ts = F.col("bill_date_timestamp")
    per_store = fact.groupBy("delivered_storeid").agg(
        F.sum("quantity").alias("_qty"),
        F.sum("total_amount").alias("_rev"),
        F.sum("discount").alias("_disc"),
        F.count("total_amount").alias("_cnt"),
        F.min(ts).alias("first_order_date"),
        F.max(ts).alias("last_order_date"),
    )
    dim = stores.groupBy(*STORE_COLS).agg(F.count(F.lit(1)).alias("_ns"))
    n = weight(F.coalesce(F.col("_ns"), F.lit(1)))
    last = _global_last_date(fact)
    for column, out in (("order_id", "total_orders_fulfilled"), ("customer_id", "unique_customers_served"),
                        ("product_id", "distinct_products_sold"), ("category", "distinct_categories_sold")):
        counts = _distinct_per_key(fact, "delivered_storeid", column, out, approx)
        per_store = per_store.join(counts, F.col("delivered_storeid").eqNullSafe(F.col("_key"))).drop("_key")
    return (
        per_store.join(dim, F.col("delivered_storeid") == F.col("storeid"), "left")
        .select(
            "delivered_storeid", "seller_city", "seller_state", "region",
            "total_orders_fulfilled", "unique_customers_served", "distinct_products_sold", "distinct_categories_sold",
            (F.col("_qty") * n).cast("bigint").alias("total_quantity_sold"),
            (F.col("_rev") * n).alias("total_revenue"),
            (F.col("_disc") * n).alias("total_discount_given"),
            ratio("_rev", "_cnt").alias("avg_order_value"),
            "first_order_date", "last_order_date",
            days_between("first_order_date", "last_order_date").alias("store_active_tenure"),
            days_between("last_order_date", last).alias("store_inactive_days"),
        )
    )
