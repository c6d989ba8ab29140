"""Breakdowns, top-k, shares and trends.

Inputs are the clean fact table (``fact``, F8) and the marts. Every grand total is a scalar
subquery over the per-key aggregate that the report needs anyway (the same exchange, reused, so the
fact is scanned once); every TOP n ends its ordering with the key as a tiebreak.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exprs import count_when, mean, month_name, ratio
from tillroll.operators.topk import grand_totals, share_of_total, top_k, top_k_per_group


def new_customers_by_month(c360: DataFrame, years: list[int]) -> DataFrame:
    """A1 — customers by year and month of their first purchase, in calendar order."""
    fd = F.col("first_transaction_date")
    return (
        c360.where(F.year(fd).isin(list(years)))
        .groupBy(F.year(fd).alias("year"), month_name(fd).alias("month"), F.month(fd).alias("_m"))
        .agg(F.countDistinct("customer_id").alias("new_customers"))
        .orderBy("year", "_m")
        .drop("_m")
    )


def revenue_by(fact: DataFrame, key: str, alias: str = "total_revenue") -> DataFrame:
    """A2 (seller_state) / A3 (region) — revenue per key, largest first."""
    return fact.groupBy(key).agg(F.sum("total_amount").alias(alias)).orderBy(F.col(alias).desc(), F.col(key))


def top_categories_by(fact: DataFrame, key: str, k: int = 5) -> DataFrame:
    """A4 (region) / A5 (seller_state) — the k categories with most lines per key."""
    counts = fact.groupBy(key, "category").agg(F.count("order_id").alias("order_count"))
    ranked = top_k_per_group(counts, [key], [F.col("order_count").desc(), F.col("category").asc_nulls_first()], k)
    return ranked.select(key, "category", "order_count", "rn")


def sales_by_channel(fact: DataFrame) -> DataFrame:
    """A6 — quantity and revenue per channel."""
    return (
        fact.groupBy("channel")
        .agg(F.sum("quantity").cast("bigint").alias("total_quantity"), F.sum("total_amount").alias("revenue"))
        .orderBy(F.col("total_quantity").desc(), "channel")
    )


def channel_contribution(fact: DataFrame) -> DataFrame:
    """A7 — A6 plus each channel's percent of all quantity and revenue."""
    per_channel = fact.groupBy("channel").agg(
        F.sum("quantity").cast("bigint").alias("total_quantity"), F.sum("total_amount").alias("revenue"))
    tq, tr = grand_totals(per_channel, "total_quantity", "revenue")
    return (
        per_channel
        .withColumn("quantity_percentage", share_of_total("total_quantity", tq))
        .withColumn("revenue_percentage", share_of_total("revenue", tr))
        .orderBy(F.col("total_quantity").desc(), "channel")
    )


def store_revenue(fact: DataFrame) -> DataFrame:
    return fact.groupBy("delivered_storeid").agg(F.sum("total_amount").alias("revenue"))


def top_stores_by_revenue(fact: DataFrame, k: int = 10) -> DataFrame:
    """A8 — the k stores with most revenue."""
    return top_k(store_revenue(fact), [F.col("revenue").desc(), F.col("delivered_storeid").asc()], k)


def top_stores_revenue_share(fact: DataFrame, k: int = 10) -> DataFrame:
    """A9 — revenue of the top k stores and their percent of all revenue (2 places)."""
    top = top_stores_by_revenue(fact, k)
    (total,) = grand_totals(store_revenue(fact), "revenue")
    return top.agg(F.sum("revenue").alias("top10_total_revenue")).withColumn(
        "top10_contribution_percentage", share_of_total("top10_total_revenue", total, 2))


def _store_lines(fact: DataFrame) -> DataFrame:
    return fact.groupBy("delivered_storeid").agg(
        F.sum("total_amount").alias("total_revenue"), F.count("order_id").alias("total_orders"))


def top_stores_by_aov(fact: DataFrame, k: int = 10) -> DataFrame:
    """A10 — the k stores with the highest revenue per line (the reference's "average order
    value" divides by ``COUNT(order_id)``, i.e. lines, not orders)."""
    per_store = _store_lines(fact).withColumn("average_order_value", ratio("total_revenue", "total_orders"))
    return top_k(per_store, [F.col("average_order_value").desc_nulls_last(), F.col("delivered_storeid").asc()], k)


def top_aov_store_shares(fact: DataFrame, k: int = 10) -> DataFrame:
    """A11 — each of A10's stores with its percent of all revenue (2 places)."""
    total, _ = grand_totals(_store_lines(fact), "total_revenue", "total_orders")
    return top_stores_by_aov(fact, k).select(
        "delivered_storeid", F.col("total_revenue").alias("revenue"),
        share_of_total("total_revenue", total, 2).alias("top10_contribution_percentage"))


def top_aov_revenue_share(fact: DataFrame, k: int = 10) -> DataFrame:
    """A12 — revenue of A10's stores together and its percent of all revenue (2 places)."""
    total, _ = grand_totals(_store_lines(fact), "total_revenue", "total_orders")
    return top_stores_by_aov(fact, k).agg(F.sum("total_revenue").alias("top10_total_revenue")).withColumn(
        "top10_contribution_percentage", share_of_total("top10_total_revenue", total, 2))


def customers_by_state(c360: DataFrame) -> DataFrame:
    """A13 — customers per state."""
    return (c360.groupBy("customer_state").agg(F.count("customer_id").alias("no_of_customers"))
            .orderBy(F.col("no_of_customers").desc(), "customer_state"))


def gender_customer_share(fact: DataFrame) -> DataFrame:
    """A14 — distinct customers per gender and their percent (2 places)."""
    pairs = fact.select("gender", "customer_id").distinct()
    # counted per customer, not as a distinct count, which would drop the pairs and scan the fact again
    customers = pairs.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_pairs"))
    total = customers.select(count_when((F.col("_pairs") > 0) & F.col("customer_id").isNotNull())).scalar()
    return pairs.groupBy("gender").agg(F.count("customer_id").alias("customer_count")).withColumn(
        "percentage", share_of_total("customer_count", total, 2))


def gender_revenue_share(fact: DataFrame) -> DataFrame:
    """A15 — revenue per gender and its percent (2 places)."""
    per_gender = fact.groupBy("gender").agg(F.sum("total_amount").alias("revenue"))
    (total,) = grand_totals(per_gender, "revenue")
    return per_gender.withColumn(
        "percentage", share_of_total("revenue", total, 2))


# ---- cohorts of customer_360 (A19–A28) -------------------------------------------------------

def discount_seekers() -> Column:
    return F.col("total_discount_taken") > 0


def non_discount_seekers() -> Column:
    return F.col("total_discount_taken") == 0


def one_time_buyers() -> Column:
    return F.col("total_distinct_transactions") == 1


def repeat_buyers() -> Column:
    return F.col("total_distinct_transactions") > 1


def cohort_count(c360: DataFrame, cohort: Column, count_name: str) -> DataFrame:
    """A19 / A22 — how many customers are in the cohort."""
    return c360.agg(count_when(cohort).alias(count_name))


def cohort_by_state(c360: DataFrame, cohort: Column, count_name: str, revenue_name: str | None = None) -> DataFrame:
    """A20, A21, A25, A26 — cohort customers (and their revenue) per customer state."""
    aggs = [F.count(F.lit(1)).alias(count_name)]
    if revenue_name:
        aggs.append(F.sum("total_revenue").alias(revenue_name))
    return (c360.where(cohort).groupBy("customer_state").agg(*aggs)
            .orderBy(F.col(count_name).desc(), "customer_state"))


def cohort_revenue_share(c360: DataFrame, cohort: Column, names: tuple[str, str, str]) -> DataFrame:
    """A23, A24, A27, A28 — cohort size, revenue and percent of all customers' revenue, in one
    conditional aggregation of the mart."""
    count_name, revenue_name, pct_name = names
    return (c360.agg(count_when(cohort).alias(count_name),
                     F.sum(F.when(cohort, F.col("total_revenue"))).alias(revenue_name),
                     F.sum("total_revenue").alias("_all"))
            .select(count_name, revenue_name, share_of_total(revenue_name, F.col("_all")).alias(pct_name)))


# ---- products and time (A29–A32) ---------------------------------------------------------------

def top_mrp_products(fact: DataFrame, k: int = 10) -> DataFrame:
    """A29 — the k fact rows with the highest MRP (a product may appear more than once)."""
    return top_k(fact.select("product_id", "mrp"), [F.col("mrp").desc_nulls_last(), F.col("product_id").asc()], k)


def top_mrp_revenue_share(fact: DataFrame, k: int = 10) -> DataFrame:
    """A30 — revenue of all rows whose product is among A29's, and its percent. The k products (at
    most) flag the lines in a left join, so one pass sums both the flagged and all of them."""
    top = top_mrp_products(fact, k).select("product_id").distinct().withColumn("_top", F.lit(True))
    return (fact.select("product_id", "total_amount").join(top, "product_id", "left")
            .agg(F.sum(F.when(F.col("_top"), F.col("total_amount"))).alias("total_revenue_from_top_10"),
                 F.sum("total_amount").alias("_all"))
            .select("total_revenue_from_top_10",
                    share_of_total("total_revenue_from_top_10", F.col("_all")).alias("contribution_percentage")))


def avg_revenue_by_month(fact: DataFrame) -> DataFrame:
    """A31 — mean line amount per calendar month over all years (the reference names it
    "avg monthly revenue", but it averages lines)."""
    ts = F.col("bill_date_timestamp")
    return (fact.groupBy(F.month(ts).alias("month_number"), month_name(ts).alias("month_name"))
            .agg(mean("total_amount").alias("avg_monthly_revenue"))
            .orderBy("month_number"))


def monthly_revenue_by_year(o360: DataFrame) -> DataFrame:
    """A32 — revenue per year and month from ``orders_360``, in calendar order (the reference
    sorts month names alphabetically)."""
    return (o360.groupBy("order_year", "order_month", F.month("bill_date_timestamp").alias("_m"))
            .agg(F.sum("total_order_value").alias("revenue"))
            .orderBy("order_year", "_m")
            .drop("_m"))
