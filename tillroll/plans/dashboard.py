"""Dashboard-style views (R1–R5): drill-down and slicer tables, month-on-month trend, the top
store's lead, and a data-quality summary of the cleaning batch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.exprs import count_when, month_name, percent, ratio
from tillroll.operators import quality
from tillroll.operators.distinct import bitmaps, merged_levels, merged_sketches, numbered, sketch
from tillroll.operators.perkey import Keep, scratch
from tillroll.operators.reconcile import BILL_MONTH, in_months
from tillroll.operators.topk import top_k


DRILL = ["region", "seller_state", "delivered_storeid"]
SLICERS = ["region", "channel", "gender"]
#: Grouping ids of the drill-down, from store rows to the grand total, and of the cube.
DRILL_LEVELS, SLICER_LEVELS = [0, 1, 3, 7], list(range(8))


def revenue_drilldown(fact: DataFrame, keep: Keep | None = None) -> DataFrame:
    """R1 — revenue and orders at every level of region → state → store; ``level`` is ``grouping_id()`` (0 = store
    rows, 7 = grand total). The lines are summed once per order of a store. A store's orders are the rows of
    that table; the levels above merge bitmaps of the orders of each state."""
    keep = keep or scratch
    per_order = keep("drill_orders", fact.groupBy(*DRILL, "order_id").agg(F.sum("total_amount").alias("total_amount")))
    stores = keep("drill_stores", per_order.groupBy(*DRILL).agg(F.sum("total_amount").alias("revenue"), F.count("order_id").alias("orders")))
    states = numbered(per_order, "order_id", "drill_order_numbers", keep).withColumn(DRILL[2], F.lit(None).cast(fact.schema[DRILL[2]].dataType))
    bits = keep("drill_bitmaps", bitmaps(states, DRILL))
    out = merged_levels(stores, DRILL, DRILL_LEVELS, ["revenue"], {"orders": (bits, DRILL_LEVELS[1:])}).where("_level > 0")
    out = out.select(*DRILL, "revenue", "orders", F.col("_level").cast("long").alias("level"))
    return stores.select(*DRILL, "revenue", "orders", F.lit(0).cast("long").alias("level")).unionByName(out)


def kpi_slicer_cube(fact: DataFrame, keep: Keep | None = None) -> DataFrame:
    """R2 — revenue, quantity, orders and customers for every combination of region, channel
    and gender, as a dashboard's slicers need. The lines are summed once per order; the cube merges
    base cells: their sums, and bitmaps of their orders and customers."""
    keep = keep or scratch
    per_order = keep("slicer_orders", fact.groupBy(*SLICERS, "order_id", "customer_id").agg(
        F.sum("total_amount").alias("total_amount"), F.sum("quantity").alias("quantity")))
    sums = keep("slicer_sums", per_order.groupBy(*SLICERS).agg(F.sum("total_amount").alias("revenue"), F.sum("quantity").cast("bigint").alias("quantity")))
    bits = {}
    for name, value in (("orders", "order_id"), ("customers", "customer_id")):
        rows = per_order.select(*SLICERS, value).distinct() if value == "customer_id" else per_order
        bits[name] = (keep(f"slicer_{name}_bitmaps", bitmaps(numbered(rows, value, f"slicer_{name}_numbers", keep), SLICERS)), SLICER_LEVELS)
    return _whole_cube(merged_levels(sums, SLICERS, SLICER_LEVELS, ["revenue", "quantity"], bits))


def _whole_cube(cube: DataFrame) -> DataFrame:
    return cube.select(*SLICERS, "revenue", F.col("quantity").cast("bigint").alias("quantity"), "orders", "customers", F.col("_level").cast("long").alias("slice"))


def revenue_drilldown_approx(fact: DataFrame, keep: Keep | None = None) -> DataFrame:
    """R1 with estimated orders: one sketch a store, made in the one pass over the lines and united upwards."""
    cells = (keep or scratch)("drill_sketches", fact.groupBy(*DRILL).agg(F.sum("total_amount").alias("revenue"), sketch("order_id").alias("_orders")))
    out = merged_sketches(cells, DRILL, DRILL_LEVELS, ["revenue"], {"orders": "_orders"})
    return out.select(*DRILL, "revenue", "orders", F.col("_level").cast("long").alias("level"))


def kpi_slicer_cube_approx(fact: DataFrame, keep: Keep | None = None) -> DataFrame:
    """R2 with estimated orders and customers, from the sketches of the base cells."""
    cells = (keep or scratch)("slicer_sketches", fact.groupBy(*SLICERS).agg(
        F.sum("total_amount").alias("revenue"), F.sum("quantity").cast("bigint").alias("quantity"), sketch("order_id").alias("_orders"), sketch("customer_id").alias("_customers")))
    return _whole_cube(merged_sketches(cells, SLICERS, SLICER_LEVELS, ["revenue", "quantity"], {"orders": "_orders", "customers": "_customers"}))


def monthly_growth(fact: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """R3 — revenue per calendar month, change against the previous month and the month's rank
    by revenue (peak seasons), of all months or those of the ISO dates ``first`` to ``last`` (of the stored
    fact, only these are read). The windows run over one row per month (a few dozen rows per
    year, whatever the data size), after the fact has been aggregated in parallel."""
    m = F.col(BILL_MONTH)
    monthly = in_months(fact, first, last).groupBy(m).agg(F.sum("total_amount").alias("revenue")).select(
        F.floor(m / 100).cast("int").alias("year"), (m % 100).alias("month"), "revenue")
    by_time = Window.orderBy("year", "month")
    by_revenue = Window.orderBy(F.col("revenue").desc(), "year", "month")
    prev = F.lag("revenue").over(by_time)
    return (monthly
            .withColumn("month_name", month_name(F.make_date("year", "month", F.lit(1))))
            .withColumn("prev_revenue", prev)
            .withColumn("mom_change", F.col("revenue") - F.col("prev_revenue"))
            .withColumn("mom_growth_pct", percent(F.col("revenue") - F.col("prev_revenue"), "prev_revenue"))
            .withColumn("peak_rank", F.rank().over(by_revenue))
            .orderBy("year", "month"))


def store_lead_ratio(fact: DataFrame, k: int = 10) -> DataFrame:
    """R4 — the k stores with most revenue, each with the next store's revenue and the ratio
    (the README's "3.6x more than the second-best store"). The window runs over k rows."""
    top = top_k(fact.groupBy("delivered_storeid").agg(F.sum("total_amount").alias("revenue")),
                [F.col("revenue").desc(), F.col("delivered_storeid").asc()], k)
    w = Window.orderBy(F.col("revenue").desc(), F.col("delivered_storeid").asc())
    return (top.withColumn("store_rank", F.row_number().over(w))
            .withColumn("next_revenue", F.lead("revenue").over(w))
            .withColumn("lead_ratio", ratio("revenue", "next_revenue")))


def _check(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("affected_rows")).select(F.lit(name).alias("check_name"), "affected_rows")


def _checks(totals: DataFrame) -> DataFrame:
    """The columns of a one-row table of counts as (check_name, affected_rows) rows."""
    return totals.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("check_name"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("affected_rows"))
        for c in totals.columns])).alias("_c")).select("_c.*")


def data_quality_summary(p, period: tuple[str, str]) -> DataFrame:
    """R5 — one row per check of the cleaning batch with the rows it found or changed (for the
    updates, the rows their WHERE matches, as the database reports "rows affected"). Counts that the
    writes of the fact and its per-order table have gathered are taken from there; of the fact itself only
    the months around the period's ends and beyond are read."""
    finalised = p.finalised_records()
    product_checks = p.t.products.agg(
        count_when(F.col("category") == "#N/A").alias("na_categories"),
        count_when(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in quality.PRODUCT_ATTRS]))
        .alias("missing_attribute_categories"))
    seen = list(p.seen_while_writing().items())
    checks = [
        _check("orders_not_matching", p.unmatched_orders()),
        _check("exact_duplicates", quality.exact_duplicates(finalised, p.keeper("exact_duplicates"))),
        _check("cumulative_lines", quality.cumulative_lines(p.store_fixed(), keep=p.keeper("cumulative_lines"))),
        _check("out_of_period", quality.out_of_period(p.fact_by_month(), *period)),
        p.spark.createDataFrame(seen, "check_name string, affected_rows bigint"),
        _checks(product_checks),
    ]
    return reduce(DataFrame.unionByName, checks)
