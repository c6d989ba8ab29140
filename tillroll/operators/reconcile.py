"""Reconciliation and enrichment of order lines (the cleaning batch, C1–C12).

Each function takes DataFrames with the canonical columns of :mod:`tillroll.sources.tables` and
returns a DataFrame. None of them collects, loops on the driver or uses a Python UDF.

Scale notes, common to the module:

* Per-order facts (min/max store, payment count, …) are computed with ``groupBy`` (map-side
  partial aggregation), written, and joined back as a plain table (:mod:`tillroll.operators.perkey`):
  only so can Spark split the join where one order holds a third of the rows. ``keep`` says where
  they are written; a batch keeps them with its stages.
* Dimension sides are pre-aggregated to one row per (key, attribute values) with a multiplicity
  count before they are joined, so the reference's join fan-out (an order line repeated once
  per payment × review × duplicate store row) becomes a multiplication, not extra rows.
* Small dimensions are broadcast by Spark's own size check (``autoBroadcastJoinThreshold`` on
  the plan estimate, and AQE on runtime sizes); beyond it the joins stay sort-merge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.lookup import Lookup, broadcast_by_spark
from tillroll.operators.perkey import Keep, dealt_by, join_facts, likely_in, likely_with, rows_with, scratch
from tillroll.sources.tables import CUSTOMER_COLS, ORDER_COLS, STORE_COLS

ENRICH_COLS = ["category", "avg_rating", "seller_city", "seller_state", "region",
               "customer_city", "customer_state", "gender"]
FACT_COLS = ORDER_COLS + ENRICH_COLS  # the 19 columns of the clean fact table


def _round0(c: Column) -> Column:
    return F.round(c, 0)


#: By name of a dimension, what :func:`tillroll.operators.lookup.lookup` has made of it (None: it does not fit).
Lookups = dict[str, Lookup | None]
#: The dimensions with attributes in the fact, and the column of the lines that names their rows.
ATTRIBUTES_BY = {"products": "product_id", "stores": "delivered_storeid", "customers": "customer_id"}


def fitting(lookups: Lookups | None, name: str, rows: DataFrame, column: str) -> Lookup | None:
    """The lookup of dimension ``name``, where there is one and the keys in ``rows`` are whole numbers as well."""
    found = (lookups or {}).get(name)
    return found if found and found.fits(rows, column) else None


# ---- C1–C5: order totals against payment totals ---------------------------------------------

def cust_order_totals(orders: DataFrame) -> DataFrame:
    """C1 — (customer_id, order_id, totalamount), the amount in whole units."""
    return orders.groupBy("customer_id", "order_id").agg(_round0(F.sum("total_amount")).alias("totalamount"))


#: Whether an order's lines differ in store, bill date or customer: of no other order can C8–C11, D3 and D6 change a line.
MIXED = "_mixed"


def order_totals(orders: DataFrame) -> DataFrame:
    """C1 with the least and largest store and bill date of its lines: all that later steps ask of an order's lines, so
    that the lines are grouped once."""
    store, ts = F.col("delivered_storeid"), F.col("bill_date_timestamp")
    return orders.groupBy("customer_id", "order_id").agg(
        _round0(F.sum("total_amount")).alias("totalamount"), F.min(store).alias("_min_store"), F.max(store).alias("_max_store"),
        F.min(ts).alias("_min_date"), F.max(ts).alias("_max_date"))


def _differ(lo: str, hi: str) -> Column:
    return F.coalesce(F.min(lo) < F.max(hi), F.lit(False))


def several_stores(totals: DataFrame) -> DataFrame:
    """:func:`orders_with_spread` of the stores, from :func:`order_totals`."""
    return totals.groupBy("order_id").agg(_differ("_min_store", "_max_store").alias("_s")).where("_s").select("order_id")


def mixed_orders(totals: DataFrame) -> DataFrame:
    """order_id of each order that is ``MIXED``, from :func:`order_totals`."""
    return totals.groupBy("order_id").agg(
        (_differ("_min_store", "_max_store") | _differ("_min_date", "_max_date") | _differ("customer_id", "customer_id")).alias("_s")
    ).where("_s").select("order_id")


def order_spread(totals: DataFrame, keep: Keep | None = None) -> DataFrame:
    """order_id of each order that is ``MIXED``, and ``_several``: whether its lines have several stores. With ``keep`` the
    orders of several customers are written, and only rows likely to be of these are grouped: an order with one row of C1 has all its
    lines in there."""
    several = _differ("_min_store", "_max_store")
    mixed = several | _differ("_min_date", "_max_date") | _differ("customer_id", "customer_id")
    grouped = lambda df: df.groupBy("order_id").agg(several.alias("_several"), mixed.alias("_s"))
    if keep is None:
        return grouped(totals).where("_s").select("order_id", "_several")
    shared = keep("orders_of_several_customers", totals.groupBy("order_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("order_id"))
    told = likely_in(totals, shared, "order_id")
    alone = told.where(~F.col("_likely")).select("order_id", *[F.coalesce(F.col(lo) < F.col(hi), F.lit(False)).alias(c) for c, lo, hi in (
        ("_several", "_min_store", "_max_store"), ("_dates", "_min_date", "_max_date"))]).withColumn("_s", F.col("_several") | F.col("_dates")).drop("_dates")
    return alone.unionByName(grouped(told.where("_likely"))).where("_s").select("order_id", "_several")


def order_payment_totals(payments: DataFrame) -> DataFrame:
    """C2 — (order_id, paymenttotal), the payments in whole units."""
    return payments.groupBy("order_id").agg(_round0(F.sum("payment_value")).alias("paymenttotal"))


def _totals_as_payment(cust_totals: DataFrame) -> DataFrame:
    return cust_totals.select("customer_id", "order_id", F.col("totalamount").alias("paymenttotal"))


def matched_orders(cust_totals: DataFrame, pay_totals: DataFrame) -> DataFrame:
    """C3 — C1 rows whose order has a payment total equal to the order total.

    C2 has one row per order, so the reference's inner join is a semi-join (no duplication).
    """
    return (
        _totals_as_payment(cust_totals)
        .join(pay_totals, ["order_id", "paymenttotal"], "left_semi")
        .select("customer_id", "order_id", F.col("paymenttotal").alias("totalamount"))
    )


def orders_not_matching(cust_totals: DataFrame, pay_totals: DataFrame) -> DataFrame:
    """C4 — C2 rows with no C1 row of equal total .

    Written as a left-anti join; a C1 row with a null customer counts as absent, as the
    definition has it.
    """
    present = _totals_as_payment(cust_totals).where(F.col("customer_id").isNotNull()).drop("customer_id")
    return pay_totals.join(present, ["order_id", "paymenttotal"], "left_anti")


def remaining_orders(not_matching: DataFrame, orders: DataFrame, keep: Keep | None = None) -> DataFrame:
    """C5 — (customer_id, order_id, paymenttotal) where one single line's rounded amount equals the
    payment total (one row per such line). With ``keep`` C4 is written, and of the lines only those likely to be in its orders
    are shuffled."""
    if keep:
        not_matching = keep("orders_not_matching", not_matching)
        orders = likely_with(orders, not_matching, "order_id")
    lines = orders.select("customer_id", "order_id", _round0(F.col("total_amount")).alias("paymenttotal"))
    return lines.join(not_matching, ["order_id", "paymenttotal"]).select("customer_id", "order_id", "paymenttotal")


def reconciled_orders(orders: DataFrame, matched: DataFrame, remaining: DataFrame) -> DataFrame:
    """C6 — all lines of the matched orders and the single lines of the corrected orders.

    Faithful to the reference's second join: when k lines of one (customer, order) carry the
    payment total, C5 has k rows for it and each such line comes out k times.

    One join instead of two: the lines meet a table with one row per (customer, order) — from
    C3 "every line, once", from C5 "lines whose rounded amount is the payment total, k times"
    (the two never share an order: a matched order is not in C4) — and the k copies are made by
    :func:`copies`. The order lines, the largest input, are shuffled once for both parts.
    """
    return copies(_apply_plan(orders, _reconcile_plan(matched, remaining)).select(*ORDER_COLS, COPIES))


#: How often C6 has a line, carried as a number until the copies themselves are asked for.
COPIES = "_k"


def copies(df: DataFrame) -> DataFrame:
    """Every row of ``df`` as often as its ``COPIES`` column says, without that column."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(COPIES)))).drop("_copy", COPIES)


def _reconcile_plan(matched: DataFrame, remaining: DataFrame) -> DataFrame:
    """One row per (customer, order) to keep: ``_pt`` null = every line once; otherwise the lines
    whose rounded amount is ``_pt``, ``_k`` times each."""
    keys = ["customer_id", "order_id"]
    return matched.select(*keys, F.lit(None).cast("decimal(38,0)").alias("_pt"), F.lit(1).cast("bigint").alias("_k")).unionByName(
        remaining.groupBy(*keys, "paymenttotal").agg(F.count(F.lit(1)).alias("_k"))
        .select(*keys, F.col("paymenttotal").cast("decimal(38,0)").alias("_pt"), "_k"))


def _apply_plan(orders: DataFrame, plan: DataFrame) -> DataFrame:
    return (
        orders.join(plan, ["customer_id", "order_id"])
        .where(F.col("_pt").isNull() | (_round0(F.col("total_amount")) == F.col("_pt")))
    )


def reconciled_integrated(orders: DataFrame, matched: DataFrame, remaining: DataFrame, reviews: DataFrame,
                          products: DataFrame, stores: DataFrame, customers: DataFrame,
                          order_facts: list[DataFrame] | None = None, keep: Keep | None = None, lookups: Lookups | None = None) -> DataFrame:
    """C6 then C7 in one plan: the rows of ``integrated_orders(reconciled_orders(…), …)``, each once
    with ``COPIES`` (:func:`copies` makes them; C11 removes duplicates, so it never needs to).

    The mean review (per order) and the customer row (per customer) are joined to the
    per-(customer, order) plan of C6 — a table of order size — so the order lines pick them up
    in C6's one join; only the product and store joins remain at line grain. Those that shuffle the lines come first, while the lines
    are narrow; broadcast ones and ``lookups`` (of the customers too) come last, so that C6's join moves no attributes. It leaves an order's
    lines side by side, which later steps group and compress by. Inner-join semantics are kept: a (customer, order) without a review or customer row drops its lines,
    and a customer listed twice doubles them, as in the reference.

    Each of ``order_facts`` (at most one row per ``order_id``) is joined to the plan as well (left) and its
    columns come with every line. With ``keep`` C6's plan is written, and only lines likely to be of its orders are shuffled
    to the products and stores.
    """
    order_facts = order_facts or []
    kept = _reconcile_plan(matched, remaining)
    if keep:
        kept = keep("reconcile_plan", kept)
        orders = likely_with(orders, kept, "order_id")
    extra = [c for df in order_facts for c in df.columns if c != "order_id"]
    plan = reduce(lambda a, b: a.join(b, "order_id", "left"), order_facts, kept.join(avg_rating_per_order(reviews), "order_id"))
    product, store, customer = (fitting(lookups, name, orders, column) for name, column in ATTRIBUTES_BY.items())
    if not (customer and customer.once):
        customer = None
        plan = plan.join(customers.select(*CUSTOMER_COLS), F.col("customer_id") == F.col("custid")).drop("custid")
    prod, first, last = products.select("product_id", "category"), orders, []
    if product and product.once:
        last.append(lambda df: product.attach(df, "product_id"))
    elif broadcast_by_spark(prod):
        last.append(lambda df: df.join(prod, "product_id"))
    else:
        first = first.join(prod, "product_id")
    rows = stores.select(*STORE_COLS).distinct()
    if store:
        last.append(lambda df: store.attach(df, "delivered_storeid"))
    elif broadcast_by_spark(rows):
        last.append(lambda df: df.join(rows, F.col("delivered_storeid") == F.col("storeid")))
    else:
        first = first.join(rows, F.col("delivered_storeid") == F.col("storeid"))
    if customer:
        last.append(lambda df: customer.attach(df, "customer_id"))
    return reduce(lambda df, add: add(df), last, _apply_plan(first, plan)).select(*FACT_COLS, COPIES, *extra)


# ---- C7: enrichment ---------------------------------------------------------------------------

def avg_rating_per_order(reviews: DataFrame) -> DataFrame:
    """Mean satisfaction score per order, as a double (T-SQL would truncate an integer AVG)."""
    return reviews.groupBy("order_id").agg(F.avg(F.col("customer_satisfaction_score").cast("double")).alias("avg_rating"))


def integrated_orders(lines: DataFrame, reviews: DataFrame, products: DataFrame, stores: DataFrame,
                      customers: DataFrame) -> DataFrame:
    """C7 — order lines joined (inner) with the mean review of the order, the product category,
    the deduplicated store row and the customer row: the 19 fact columns."""
    prod = products.select("product_id", "category")
    store = stores.select(*STORE_COLS).distinct()
    cust = customers.select(*CUSTOMER_COLS)
    return (
        lines.join(avg_rating_per_order(reviews), "order_id")
        .join(prod, "product_id")
        .join(store, F.col("delivered_storeid") == F.col("storeid"))
        .join(cust, F.col("customer_id") == F.col("custid"))
        .select(*FACT_COLS)
    )


# ---- C8–C11: orders delivered from several stores ---------------------------------------------

def orders_with_spread(df: DataFrame, column: str) -> DataFrame:
    """Orders (order_id) with more than one distinct non-null value of ``column``.

    ``COUNT(DISTINCT c) > 1`` is ``MIN(c) < MAX(c)``: one partial aggregate, no distinct step.
    """
    return (
        df.groupBy("order_id")
        .agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
        .where(F.col("_lo") < F.col("_hi"))
        .select("order_id")
    )


def multi_store_lines(orders: DataFrame, keep: Keep | None = None, spread: DataFrame | None = None) -> DataFrame:
    """C8 — distinct order lines whose order has a line at another store, with the unit amount
    ``net_amount = total_amount / quantity`` and ``net_qty = quantity / quantity`` (integer).

    The reference self-joins orders on ``a.order_id = b.order_id AND a.store <> b.store``
    (cost Σ lines² per order). A line qualifies iff its store is not null and its order has two
    distinct non-null stores, which is a semi-join against :func:`orders_with_spread` (``spread``, where it is
    known already).
    """
    if spread is None:
        spread = (keep or scratch)("orders_of_several_stores", orders_with_spread(orders, "delivered_storeid"))
    else:
        spread = (keep or scratch)("orders_of_several_stores", spread)
        orders = likely_with(orders, spread, "order_id")
    # one row an order, so an inner join; a semi-join would be moved below the filter
    lines = (orders.join(spread, "order_id")
             .where(F.col("delivered_storeid").isNotNull())
             .select(*ORDER_COLS))
    return (
        dealt_by(lines, ORDER_COLS)
        .distinct()
        .withColumn("net_amount", (F.col("total_amount") / F.col("quantity")).cast("decimal(18,8)"))
        .withColumn("net_qty", F.expr("quantity div quantity").cast("int"))
    )


#: Amounts summed over a join's fan-out: 20 digits before the point, none of a line's 8 after it lost.
SUM_TYPE = "decimal(28,8)"


def _counted(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))


def multi_store_insert(multi: DataFrame, products: DataFrame, payments: DataFrame, customers: DataFrame,
                       reviews: DataFrame, stores: DataFrame, keep: Keep | None = None, payment_counts: DataFrame | None = None,
                       lookups: Lookups | None = None) -> DataFrame:
    """C9's inserted rows: C8 joined (inner) with products, payments, customers, reviews and
    stores — none deduplicated — then grouped by all 21 columns, summing net_qty and net_amount.

    Each C8 row × each distinct combination of dimension attributes is one group, whose size is
    the product of the matching row counts on every side. We join each side pre-aggregated to
    (key, attributes, count) and multiply, which gives the same sums without materialising the
    fan-out. ``avg_rating`` here is the raw score of a review row, as in the reference. ``payment_counts``, if
    given, is a written table of order_id and its payments ``_n2``. Sides with ``lookups`` are not joined.
    """
    # the other sides are grouped by more than their join key, so they are shuffled anew for the join
    pay = (keep or scratch)("payments_per_order", _counted(payments, ["order_id"], "_n2")) if payment_counts is None else payment_counts
    rev = _counted(reviews, ["order_id", "customer_satisfaction_score"], "_n4")
    sides = {"products": (products, ["product_id", "category"], "_n1"), "customers": (customers, CUSTOMER_COLS, "_n3"), "stores": (stores, STORE_COLS, "_n5")}

    def with_side(df: DataFrame, name: str) -> DataFrame:
        side, cols, n = sides[name]
        found = fitting(lookups, name, multi, ATTRIBUTES_BY[name])
        if found:
            return found.attach(df, ATTRIBUTES_BY[name], n)
        return df.join(_counted(side, cols, n).withColumnRenamed(cols[0], "_key"), F.col(ATTRIBUTES_BY[name]) == F.col("_key")).drop("_key")

    shuffled = [name for name in ("products", "customers") if not fitting(lookups, name, multi, ATTRIBUTES_BY[name])]
    # by order after the products and customers that shuffle the lines, in one shuffle of them
    joined = reduce(with_side, shuffled, multi).join(pay, "order_id").join(rev, "order_id")
    joined = reduce(with_side, [name for name in sides if name not in shuffled], joined)
    # decimal(18,8) × decimal(19,0) stays within 38 digits, so Spark keeps all 8 decimals (a bigint
    # factor would make it drop one), and the product holds any hot order's sum.
    mult = reduce(lambda a, b: a * b, [F.col(f"_n{i}") for i in range(1, 6)]).cast("decimal(19,0)")
    return joined.select(
        *[c for c in ORDER_COLS if c not in ("quantity", "total_amount")],
        (F.col("net_qty") * mult).cast("bigint").alias("quantity"),
        (F.col("net_amount") * mult).cast(SUM_TYPE).alias("total_amount"),
        "category",
        F.col("customer_satisfaction_score").cast("double").alias("avg_rating"),
        *STORE_COLS[1:],
        *CUSTOMER_COLS[1:],
    ).select(*FACT_COLS)


def append_multi_store(integrated: DataFrame, insert: DataFrame) -> DataFrame:
    """C9 — C7 with the multi-store rows appended, duplicates kept."""
    return integrated.select(*FACT_COLS).unionByName(insert.select(*FACT_COLS))


def multi_store_records(insert: DataFrame) -> DataFrame:
    """C10 — the same join grouped without quantity and amount columns.

    C9's groups refine C10's, so C10 is C9's insert regrouped on its 17 other columns.
    """
    keys = [c for c in FACT_COLS if c not in ("quantity", "total_amount")]
    return (
        insert.groupBy(*keys)
        .agg(F.sum("quantity").cast("bigint").alias("quantity"),
             F.sum("total_amount").cast(SUM_TYPE).alias("total_amount"))
        .select(*FACT_COLS)
    )


def finalised_records(appended: DataFrame, add_records: DataFrame, integrated: DataFrame, keep: Keep | None = None) -> DataFrame:
    """C11 — C9 EXCEPT (C10 rows whose order is in C7): set difference with nulls equal and
    duplicates removed (EXCEPT DISTINCT). The reference's inner join with C7 only filters (EXCEPT
    discards its duplicates), so it is a semi-join here.

    Written as one aggregation: both sides tagged and unioned, grouped by all 19 columns, and a
    group kept when no row of it came from the right side. GROUP BY treats nulls as equal and
    removes duplicates, which is EXCEPT's semantics, in a single shuffle hashed on all columns
    (``subtract`` plans an anti-join and a separate distinct, three shuffles of the fact here).
    """
    right = rows_with(add_records, integrated.select("order_id").distinct(), ["order_id"], "integrated_order_ids", keep)
    tagged = (appended.select(*FACT_COLS, F.lit(0).alias("_right"))
              .unionByName(right.select(*FACT_COLS, F.lit(1).alias("_right"))))
    return (tagged.groupBy(*FACT_COLS).agg(F.max("_right").alias("_right"))
            .where(F.col("_right") == 0)
            .select(*FACT_COLS))


def finalised_with_insert(lines: DataFrame, insert: DataFrame, keep: Keep | None = None) -> DataFrame:
    """C11 from C7 (``lines``) and C9's insert: ``finalised_records(append_multi_store(lines, insert),
    multi_store_records(insert), lines)``.

    A group of C10 with one row of the insert has that very row: if its order is in C7 the row removes itself and its equals in
    C7, else it stays. So whole rows are shuffled only where another row may be equal or may share the group, which digests tell
    first (8 bytes a row), and where the order is not in C7. All rows of one digest go the same way, so that a digest
    shared by different rows, or found by chance in the filter, changes nothing.
    """
    keep = keep or scratch
    keys = [c for c in FACT_COLS if c not in ("quantity", "total_amount")]
    # the digests of equal rows are equal only in one type
    summed = insert.withColumns({"quantity": F.col("quantity").cast("bigint"), "total_amount": F.col("total_amount").cast(SUM_TYPE)})
    types = reduce(DataFrame.unionByName, [df.select(*FACT_COLS) for df in (lines, insert, summed)]).schema
    lines, insert = (df.select(*[F.col(c).cast(types[c].dataType).alias(c) for c in FACT_COLS]) for df in (lines, insert))
    grouped = insert.withColumn("_g", F.xxhash64(*keys))
    several = keep("insert_groups_of_several", grouped.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_g"))
    # orders of the insert that are not in C7; one without an id is in no join
    outside = keep("insert_orders_outside", insert.select("order_id").distinct().join(lines.select("order_id").distinct(), "order_id", "left_anti"))

    def in_c7(df: DataFrame) -> DataFrame:
        return df.where(F.col("order_id").isNotNull()).join(outside, "order_id", "left_anti")

    stay = (likely_with(insert, outside, "order_id").join(outside, "order_id", "left_semi")
            .unionByName(insert.where(F.col("order_id").isNull())))
    of_several = keep("insert_rows_of_several", in_c7(likely_with(grouped, several, "_g").join(several, "_g", "left_semi").select(*FACT_COLS)))
    sums = keep("insert_sums_of_several", of_several.groupBy(*keys).agg(
        *[F.sum(c).cast(types[c].dataType).alias(c) for c in ("quantity", "total_amount")]).select(*FACT_COLS))
    told = lambda df: df.withColumn("_d", F.xxhash64(*FACT_COLS))
    repeated = keep("repeated_rows", reduce(DataFrame.unionByName, [told(df).select("_d") for df in (lines, insert, sums)])
                    .groupBy("_d").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_d"))
    left = likely_in(reduce(DataFrame.unionByName, [told(df) for df in (lines, stay, of_several)]), repeated, "_d")
    alone = in_c7(likely_with(told(insert), repeated, "_d").withColumn("_g", F.xxhash64(*keys)).join(several, "_g", "left_anti"))
    tagged = (left.where("_likely").select(*FACT_COLS, F.lit(0).alias("_right"))
              .unionByName(alone.select(*FACT_COLS).unionByName(sums).select(*FACT_COLS, F.lit(1).alias("_right"))))
    return left.where(~F.col("_likely")).select(*FACT_COLS).unionByName(
        tagged.groupBy(*FACT_COLS).agg(F.max("_right").alias("_right"))
        .where(F.col("_right") == 0)
        .select(*FACT_COLS))


def unrepeated(lines: DataFrame, columns: list[str], keep: Keep | None = None) -> DataFrame:
    """``lines`` with each different value of ``columns`` once (its other columns follow from these).

    Digests first, as in D1: 8 bytes a line are shuffled to find those that repeat, and only lines with one of these are
    compared whole; the others stay where they are."""
    digest = F.xxhash64(*columns)
    repeated = (keep or scratch)("repeated_lines", lines.select(digest.alias("_d")).groupBy("_d").agg(F.count(F.lit(1)).alias("_n"))
                                 .where(F.col("_n") > 1).select("_d"))
    if not repeated.head(1):
        return lines
    told = lines.withColumn("_d", digest).join(repeated.withColumn("_again", F.lit(True)), "_d", "left")
    again = dealt_by(told.where(F.col("_again")).select(*lines.columns), columns).dropDuplicates(columns)
    return told.where(F.col("_again").isNull()).select(*lines.columns).unionByName(again)


# ---- D3 / D6 / C12: per-order repairs ----------------------------------------------------------

def _per_order(df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy("order_id").agg(*[a.alias(n) for n, a in aggs.items()])


def fix_store_to_min(fact: DataFrame, keep: Keep | None = None) -> DataFrame:
    """D3 — set the store of every line to its order's lowest store. Lines with a null
    store keep it."""
    stats = _per_order(fact, {"_min_store": F.min("delivered_storeid")})
    store = F.col("delivered_storeid")
    return join_facts(fact, stats, ["order_id"], "lowest_stores", keep=keep).select(
        *[F.when(store.isNotNull(), F.col("_min_store")).otherwise(store).alias(c) if c == "delivered_storeid"
          else F.col(c) for c in fact.columns])


def fix_date_to_latest(fact: DataFrame, keep: Keep | None = None) -> DataFrame:
    """D6 — set the bill date of every line to its order's latest bill date."""
    stats = _per_order(fact, {"_max_date": F.max("bill_date_timestamp")})
    ts = F.col("bill_date_timestamp")
    return join_facts(fact, stats, ["order_id"], "latest_dates", keep=keep).select(
        *[F.when(ts.isNotNull(), F.col("_max_date")).otherwise(ts).alias(c) if c == "bill_date_timestamp"
          else F.col(c) for c in fact.columns])


def refresh_store_attrs(fact: DataFrame, stores: DataFrame) -> DataFrame:
    """B6 — city, state and region of every line as the store table has them for its (corrected) store.

    Of a store listed with different attributes the smallest row counts; lines whose store is null or
    not in the table keep theirs."""
    attrs = STORE_COLS[1:]
    rows = stores.groupBy(F.col("storeid").alias("_store")).agg(F.min(F.struct(*attrs)).alias("_attrs"))
    return fact.join(rows, F.col("delivered_storeid") == F.col("_store"), "left").select(
        *[F.when(F.col("_store").isNotNull(), F.col(f"_attrs.{c}")).otherwise(F.col(c)).alias(c) if c in attrs
          else F.col(c) for c in fact.columns])


BILL_DATE_BEFORE_FIX = "_bill_date_before_fix"
STORE_FIXED = "_store_fixed"
ORDER_REPAIRS = "order_repairs"


def order_repairs(finalised: DataFrame) -> DataFrame:
    """One row per order: what D3 and D6 set, and the spread of stores, dates and customers over its lines."""
    store, ts, cust = F.col("delivered_storeid"), F.col("bill_date_timestamp"), F.col("customer_id")
    return _per_order(finalised, {"_min_store": F.min(store), "_max_store": F.max(store), "_min_date": F.min(ts), "_max_date": F.max(ts),
                                  "_min_customer": F.min(cust), "_max_customer": F.max(cust), "_lines": F.count(F.lit(1))})


#: Counts over :func:`order_repairs`: rows of orders with several stores or dates, orders with several customers.
ORDER_CHECKS = {
    "multi_store_rows": "sum(if(order_id is not null and _min_store < _max_store, _lines, 0))",
    "multi_date_rows": "sum(if(order_id is not null and _min_date < _max_date, _lines, 0))",
    "multi_customer_orders": "count_if(_min_customer < _max_customer)",
}


def clean_fact(finalised: DataFrame, order_facts: DataFrame | None = None, keep_original_date: bool = False,
               keep: Keep | None = None) -> DataFrame:
    """C12 — F8: C11 with D3 then D6 applied. Both repairs read per-order aggregates that the
    other does not change, so one aggregate and one join apply both.

    ``order_facts`` (one row per ``order_id``), when given, is joined to that per-order table
    and its other columns are appended to every line: the lines pick them up in the join they
    need anyway, and later readers (the payment-weighted marts) need no join of their own.
    ``keep_original_date`` also keeps each line's bill date from before D6 (an audit column,
    ``BILL_DATE_BEFORE_FIX``), so "F8 after D3 only" is a projection of this table, and whether D3 changed its store.
    """
    stats = order_repairs(finalised)
    extra: list[str] = []
    if order_facts is not None:
        stats = stats.join(order_facts, "order_id", "left")
        extra = [c for c in order_facts.columns if c != "order_id"]
    store, ts = F.col("delivered_storeid"), F.col("bill_date_timestamp")
    fixed = {
        "delivered_storeid": F.when(store.isNotNull(), F.col("_min_store")).otherwise(store),
        "bill_date_timestamp": F.when(ts.isNotNull(), F.col("_max_date")).otherwise(ts),
    }
    if keep_original_date:
        extra += [ts.alias(BILL_DATE_BEFORE_FIX), ((F.col("_min_store") != store) & F.col("order_id").isNotNull()).alias(STORE_FIXED)]
    # the stage's other columns are for the checks that its write gathers; the join leaves them unread
    return join_facts(finalised, stats, ["order_id"], ORDER_REPAIRS, keep=keep).select(
        *[fixed[c].alias(c) if c in fixed else F.col(c) for c in FACT_COLS], *extra)


def clean_as_is(lines: DataFrame, order_facts: list[str]) -> DataFrame:
    """What :func:`clean_fact` makes of lines whose orders have one store and one date: the same, with its audit columns and
    the columns ``order_facts`` that they carry."""
    return lines.select(*FACT_COLS, *order_facts, F.col("bill_date_timestamp").alias(BILL_DATE_BEFORE_FIX), F.lit(False).alias(STORE_FIXED))


def late_attributes(lines: DataFrame, lookups: Lookups) -> dict[str, Lookup]:
    """By column of ``lines``, the lookups that give a settled line the attributes that C7 gave it: none whose dimension
    lists a product or customer twice."""
    found = {column: (name, fitting(lookups, name, lines, column)) for name, column in ATTRIBUTES_BY.items()}
    return {column: x for column, (name, x) in found.items() if x and (x.once or name == "stores")}


def without_attributes(settled: DataFrame, late: dict[str, Lookup]) -> DataFrame:
    """Settled lines with nulls in place of the attributes that :func:`with_attributes` gives them, so that a shuffle moves none."""
    gone = {a for x in late.values() for a in x.attrs}
    return settled.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name in gone else F.col(f.name) for f in settled.schema.fields])


def with_attributes(fact: DataFrame, late: dict[str, Lookup]) -> DataFrame:
    """``fact`` with the attributes of its lines that are not ``MIXED``; the others have theirs."""
    for column, x in late.items():
        own = {a: f"_own_{a}" for a in x.attrs}
        told = x.attach(fact.withColumnsRenamed(own), column, how="left")
        fact = told.select(*[F.when(F.col(MIXED), F.col(own[c])).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in fact.columns])
    return fact


#: Partition column of the stored fact: 100 * year + month of the bill date (null: no date).
BILL_MONTH = "bill_month"


def with_month(fact: DataFrame) -> DataFrame:
    ts = F.col("bill_date_timestamp")
    return fact.withColumn(BILL_MONTH, (F.year(ts) * 100 + F.month(ts)).cast("int"))


def month_number(date: str) -> int:
    """``BILL_MONTH`` of an ISO date."""
    return int(date[:4]) * 100 + int(date[5:7])


def in_months(fact: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """The rows billed in the months of the ISO dates ``first`` to ``last`` (none: open). Of the stored fact only these
    months' folders are read."""
    fact = fact if BILL_MONTH in fact.columns else with_month(fact)
    if first:
        fact = fact.where(F.col(BILL_MONTH) >= month_number(first))
    if last:
        fact = fact.where(F.col(BILL_MONTH) <= month_number(last))
    return fact


def by_month(fact: DataFrame) -> DataFrame:
    """``fact`` (with ``BILL_MONTH``) laid out for a write partitioned by month: a month's rows in few tasks,
    a large month in several (AQE sizes them), each sorted by order so that a looked-up order is in few row groups."""
    return fact.hint("rebalance", BILL_MONTH).sortWithinPartitions(BILL_MONTH, "order_id")


#: Counts over the fact with its audit columns: lines that D3 and D6 changed.
FACT_CHECKS = {
    "store_fixes": f"count_if({STORE_FIXED})",
    "date_fixes": f"count_if({BILL_DATE_BEFORE_FIX} <> bill_date_timestamp)",
}


def order_lookup(fact: DataFrame, order_id) -> DataFrame:
    """C13 — all rows of one order (a filter that reaches the parquet scan)."""
    return fact.where(F.col("order_id") == F.lit(order_id))
