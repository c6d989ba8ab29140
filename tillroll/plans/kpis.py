"""KPIs K1–K30: one aggregate pass per mart computes the whole family; each registered query
selects its own column(s) and Catalyst prunes the aggregates it does not use.

``approx=True`` swaps every exact distinct count for ``approx_count_distinct`` (HyperLogLog++,
no distinct shuffle), for very large marts; the default is exact, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.exprs import count_when, mean, percent


def _distinct(c: str, approx: bool) -> Column:
    return F.approx_count_distinct(c) if approx else F.countDistinct(c)


def order_kpis(o360: DataFrame, approx: bool = False) -> DataFrame:
    """K1–K7, K14–K21, K26 over ``orders_360``."""
    dc = F.col("distinct_categories_in_order")
    value, disc, profit = F.col("total_order_value"), F.col("total_discount_on_order"), F.col("profit")
    orders = _distinct("order_id", approx)
    return o360.agg(
        orders.alias("total_unique_orders"),
        F.sum("total_quantity_in_order").cast("bigint").alias("total_quantity"),
        mean("total_order_value").alias("avg_order_value"),
        mean("total_quantity_in_order").alias("avg_items_per_order"),
        mean("distinct_categories_in_order").alias("avg_categories_per_order"),
        percent(count_when(dc == 1), orders).alias("pct_single_category_orders"),
        percent(count_when(dc > 1), orders).alias("pct_multi_category_orders"),
        F.sum(value).alias("total_revenue"),
        F.sum(disc).alias("total_discount"),
        mean(disc).alias("avg_discount_per_order"),
        mean("discount_percent").alias("avg_discount_percent"),
        F.sum(profit).alias("total_profit"),
        F.sum(value - profit).alias("total_cost"),
        percent(F.sum(disc), F.sum(value)).alias("discount_percentage"),
        percent(F.sum(profit), F.sum(value)).alias("profit_percentage"),
        _distinct("channel", approx).alias("total_channels"),
    )


def customer_kpis(c360: DataFrame, approx: bool = False) -> DataFrame:
    """K8–K13, K30 over ``customer_360``."""
    n = F.col("total_distinct_transactions")
    everyone = F.count(F.lit(1))
    return c360.agg(
        _distinct("customer_id", approx).alias("total_customers"),
        mean("total_distinct_transactions").alias("avg_transactions_per_customer"),
        mean("total_revenue").alias("avg_sales_per_customer"),
        mean("profit").alias("avg_profit_per_customer"),
        percent(count_when(n > 1), everyone).alias("repeat_purchase_rate"),
        percent(count_when(n == 1), everyone).alias("one_time_buyer_percentage"),
        F.sum("weekend_transactions").cast("bigint").alias("total_weekend_transactions"),
        F.sum("weekday_transactions").cast("bigint").alias("total_weekday_transactions"),
    )


def store_kpis(s360: DataFrame, approx: bool = False) -> DataFrame:
    """K22–K25 over ``store_360``."""
    return s360.agg(
        _distinct("delivered_storeid", approx).alias("total_stores"),
        _distinct("seller_city", approx).alias("total_cities"),
        _distinct("seller_state", approx).alias("total_states"),
        _distinct("region", approx).alias("total_regions"),
    )


def product_kpis(fact: DataFrame, approx: bool = False) -> DataFrame:
    """K27–K29 over the clean fact table (no payment fan-out)."""
    return fact.agg(
        F.sum("quantity").cast("bigint").alias("total_quantity_sold"),
        _distinct("product_id", approx).alias("total_products"),
        _distinct("category", approx).alias("total_categories"),
    )


# name → (mart, columns)
KPI_QUERIES: dict[str, tuple[str, list[str]]] = {
    "kpi_unique_orders": ("orders", ["total_unique_orders"]),
    "kpi_total_quantity": ("orders", ["total_quantity"]),
    "kpi_avg_order_value": ("orders", ["avg_order_value"]),
    "kpi_avg_items_per_order": ("orders", ["avg_items_per_order"]),
    "kpi_avg_categories_per_order": ("orders", ["avg_categories_per_order"]),
    "kpi_pct_single_category": ("orders", ["pct_single_category_orders"]),
    "kpi_pct_multi_category": ("orders", ["pct_multi_category_orders"]),
    "kpi_customers": ("customers", ["total_customers"]),
    "kpi_avg_orders_per_customer": ("customers", ["avg_transactions_per_customer"]),
    "kpi_avg_sales_per_customer": ("customers", ["avg_sales_per_customer"]),
    "kpi_avg_profit_per_customer": ("customers", ["avg_profit_per_customer"]),
    "kpi_repeat_rate": ("customers", ["repeat_purchase_rate"]),
    "kpi_one_time_rate": ("customers", ["one_time_buyer_percentage"]),
    "kpi_total_revenue": ("orders", ["total_revenue"]),
    "kpi_total_discount": ("orders", ["total_discount"]),
    "kpi_avg_discount_per_order": ("orders", ["avg_discount_per_order"]),
    "kpi_avg_discount_percent": ("orders", ["avg_discount_percent"]),
    "kpi_total_profit": ("orders", ["total_profit"]),
    "kpi_total_cost": ("orders", ["total_cost"]),
    "kpi_discount_percentage": ("orders", ["discount_percentage"]),
    "kpi_profit_percentage": ("orders", ["profit_percentage"]),
    "kpi_stores": ("stores", ["total_stores"]),
    "kpi_cities": ("stores", ["total_cities"]),
    "kpi_states": ("stores", ["total_states"]),
    "kpi_regions": ("stores", ["total_regions"]),
    "kpi_channels": ("orders", ["total_channels"]),
    "kpi_quantity_sold": ("products", ["total_quantity_sold"]),
    "kpi_products": ("products", ["total_products"]),
    "kpi_categories": ("products", ["total_categories"]),
    "kpi_weekend_weekday": ("customers", ["total_weekend_transactions", "total_weekday_transactions"]),
}
