"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``
over the tables derived from ``sf_dir`` (through the memoised, staged cleaning batch).

Outputs are report-shaped: decimal money columns are cast to double at the very end (sums stay
exact decimals up to that point).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tillroll.operators import quality, reconcile
from tillroll.plans import analysis as A
from tillroll.plans import dashboard as R
from tillroll.plans import kpis as K
from tillroll.plans import segments as S
from tillroll.plans.batch import CleaningBatch, batch_for
from tillroll.plans.incremental import IncrementalFact
from tillroll.sources.tables import RetailTables

# Parameters on the driver's tables (FIXTURES.md §3); the reference used 2021-09-01 … 2023-10-31
# and the years 2021–2023 on its own data.
PERIOD = ("1995-09-01", "2001-03-31")
YEARS = list(range(1995, 2002))
TOP_K = 10
PER_GROUP_K = 5
LOOKUP_ORDER = 10  # an order split over several stores in the fixture


def report(df: DataFrame) -> DataFrame:
    """Cast decimal columns to double for output; keep names and order."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                       else F.col(f.name) for f in df.schema.fields])


def increments(t: RetailTables) -> list[tuple[str, RetailTables]]:
    """The sources as three arrivals: lines by bill date (so an order with several dates comes in parts), late payments
    and reviews, and rows of each dimension that come with the second."""
    first, second = YEARS[2], YEARS[4]
    year = F.coalesce(F.year("bill_date_timestamp"), F.lit(0))
    orders = [t.orders.where(year < first), t.orders.where((year >= first) & (year < second)), t.orders.where(year >= second)]

    def split(df: DataFrame, key: str, late: int) -> list[DataFrame]:
        """Three parts: all but every ``late``-th key, these, none."""
        h = F.pmod(F.coalesce(F.col(key), F.lit(0)), F.lit(late))
        return [df.where(h != 1), df.where(h == 1), df.where(F.lit(False))]

    parts = {"payments": split(t.payments, "order_id", 7), "reviews": split(t.reviews, "order_id", 11), "customers": split(t.customers, "custid", 97),
             "products": split(t.products, "product_id", 89), "stores": split(t.stores, "storeid", 5)}
    return [(name, RetailTables(orders=orders[i], **{k: v[i] for k, v in parts.items()})) for i, name in enumerate(("first", "second", "third"))]


def incremental_fact(p: CleaningBatch) -> IncrementalFact:
    """The fact made by three increments instead of one batch."""
    out = IncrementalFact(p.spark, p.store.path("incremental"))
    for name, rows in increments(p.t):
        out.apply(name, rows)
    return out


Query = Callable[[SparkSession, str], DataFrame]


def _q(fn: Callable[[CleaningBatch], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(fn(batch_for(spark, sf_dir)))
    run.__doc__ = fn.__doc__
    return run


def _kpi(mart: str, cols: list[str]) -> Callable[[CleaningBatch], DataFrame]:
    builders = {
        "orders": lambda p: K.order_kpis(p.orders_360()),
        "customers": lambda p: K.customer_kpis(p.customer_360()),
        "stores": lambda p: K.store_kpis(p.store_360()),
        "products": lambda p: K.product_kpis(p.clean_fact()),
    }
    return lambda p: builders[mart](p).select(*cols)


def _cohort(kind: str):
    return {
        "discount": A.discount_seekers(),
        "non_discount": A.non_discount_seekers(),
        "one_time": A.one_time_buyers(),
        "repeat": A.repeat_buyers(),
    }[kind]


_PLANS: dict[str, Callable[[CleaningBatch], DataFrame]] = {
    # C — cleaning and reconciliation
    "cust_order_totals": lambda p: p.cust_order_totals(),
    "order_payment_totals": lambda p: p.order_payment_totals(),
    "matched_orders": lambda p: p.matched_orders(),
    "orders_not_matching": lambda p: p.orders_not_matching(),
    "remaining_orders": lambda p: p.remaining_orders(),
    "reconciled_orders": lambda p: p.reconciled_orders(),
    "integrated_orders": lambda p: p.integrated_orders(),
    "multi_store_lines": lambda p: p.multi_store_lines(),
    "append_multi_store": lambda p: p.append_multi_store(),
    "multi_store_records": lambda p: p.multi_store_records(),
    "finalised_records": lambda p: p.finalised_records(),
    "clean_fact": lambda p: p.clean_fact(),
    "clean_fact_refreshed_store": lambda p: p.variant(refresh_store_attrs=True).clean_fact(),
    "clean_fact_incremental": lambda p: incremental_fact(p).fact(),
    "clean_fact_clean_categories": lambda p: p.variant(clean_categories=True).clean_fact(),
    "order_lookup": lambda p: reconcile.order_lookup(p.clean_fact(), LOOKUP_ORDER),
    "table_view": lambda p: p.clean_fact().select("*"),
    # D — discrepancies
    "exact_duplicates": lambda p: quality.exact_duplicates(p.finalised_records(), p.keeper("exact_duplicates")),
    "exact_duplicates_appended": lambda p: quality.exact_duplicates(p.append_multi_store(), p.keeper("exact_duplicates_appended")),
    "multi_store_orders": lambda p: quality.multi_store_orders(p.finalised_records()),
    "fix_store_to_min": lambda p: p.stores_fixed_of_finalised(),
    "cumulative_lines": lambda p: quality.cumulative_lines(p.store_fixed(), keep=p.keeper("cumulative_lines")),
    "cumulative_lines_orders": lambda p: quality.cumulative_lines(p.t.orders, keep=p.keeper("cumulative_lines_orders", ())),
    "multi_date_orders": lambda p: quality.multi_date_orders(p.store_fixed(), p.keeper("multi_date_orders")),
    "fix_date_to_latest": lambda p: p.dates_fixed(),
    "out_of_period": lambda p: quality.out_of_period(p.fact_by_month(), *PERIOD),
    "multi_customer_orders": lambda p: quality.multi_customer_orders(p.clean_fact()),
    # the check of multi_customer_orders on raw lines and a column that does vary within orders
    "multi_product_orders": lambda p: reconcile.orders_with_spread(p.t.orders, "product_id"),
    "fix_na_category": lambda p: p.products_na_fixed(),
    "fix_missing_attributes": lambda p: p.products_clean(),
    # M — marts
    "customer_360": lambda p: p.customer_360(),
    "customer_360_dedup": lambda p: p.customer_360_dedup(),
    "orders_360": lambda p: p.orders_360(),
    "orders_360_dedup": lambda p: p.orders_360_dedup(),
    "store_360": lambda p: p.store_360(),
    # K — KPIs
    **{name: _kpi(mart, cols) for name, (mart, cols) in K.KPI_QUERIES.items()},
    # A — analyses
    "new_customers_by_month": lambda p: A.new_customers_by_month(p.customer_360(), YEARS),
    "revenue_by_state": lambda p: A.revenue_by(p.clean_fact(), "seller_state", "total_revenue"),
    "revenue_by_region": lambda p: A.revenue_by(p.clean_fact(), "region", "revenue"),
    "top_categories_by_region": lambda p: A.top_categories_by(p.clean_fact(), "region", PER_GROUP_K),
    "top_categories_by_state": lambda p: A.top_categories_by(p.clean_fact(), "seller_state", PER_GROUP_K),
    "sales_by_channel": lambda p: A.sales_by_channel(p.clean_fact()),
    "channel_contribution": lambda p: A.channel_contribution(p.clean_fact()),
    "top_stores_by_revenue": lambda p: A.top_stores_by_revenue(p.clean_fact(), TOP_K),
    "top_stores_revenue_share": lambda p: A.top_stores_revenue_share(p.clean_fact(), TOP_K),
    "top_stores_by_aov": lambda p: A.top_stores_by_aov(p.clean_fact(), TOP_K),
    "top_aov_store_shares": lambda p: A.top_aov_store_shares(p.clean_fact(), TOP_K),
    "top_aov_revenue_share": lambda p: A.top_aov_revenue_share(p.clean_fact(), TOP_K),
    "customers_by_state": lambda p: A.customers_by_state(p.customer_360()),
    "gender_customer_share": lambda p: A.gender_customer_share(p.clean_fact()),
    "gender_revenue_share": lambda p: A.gender_revenue_share(p.clean_fact()),
    "revenue_segments": lambda p: S.revenue_segments(p.customer_360()),
    "profit_segments": lambda p: S.profit_segments(p.customer_360()),
    "rfm_segments": lambda p: S.rfm_segments(p.rfm_base()),
    "rfm_segments_corrected": lambda p: S.rfm_segments(p.rfm_base(), corrected=True),
    "discount_seekers": lambda p: A.cohort_count(p.customer_360(), _cohort("discount"), "discount_customers_count"),
    "discount_seekers_by_state": lambda p: A.cohort_by_state(
        p.customer_360(), _cohort("discount"), "discount_customers_count", "revenue"),
    "non_discount_by_state": lambda p: A.cohort_by_state(
        p.customer_360(), _cohort("non_discount"), "non_discount_customers_count"),
    "non_discount_seekers": lambda p: A.cohort_count(
        p.customer_360(), _cohort("non_discount"), "non_discount_customers_count"),
    "discount_revenue_share": lambda p: A.cohort_revenue_share(p.customer_360(), _cohort("discount"), (
        "discount_customers_count", "discount_customers_revenue", "discount_revenue_percentage")),
    "non_discount_revenue_share": lambda p: A.cohort_revenue_share(p.customer_360(), _cohort("non_discount"), (
        "non_discount_customers_count", "non_discount_customers_revenue", "non_discount_revenue_percentage")),
    "one_time_by_state": lambda p: A.cohort_by_state(
        p.customer_360(), _cohort("one_time"), "one_time_buyers_count", "total_revenue_generated"),
    "repeat_by_state": lambda p: A.cohort_by_state(
        p.customer_360(), _cohort("repeat"), "repeat_buyers_count", "total_revenue_generated"),
    "one_time_revenue_share": lambda p: A.cohort_revenue_share(p.customer_360(), _cohort("one_time"), (
        "no_of_customers", "total_revenue", "percentage_revenue")),
    "repeat_revenue_share": lambda p: A.cohort_revenue_share(p.customer_360(), _cohort("repeat"), (
        "no_of_customers", "total_revenue", "percentage_contributed")),
    "top_mrp_products": lambda p: A.top_mrp_products(p.clean_fact(), TOP_K),
    "top_mrp_revenue_share": lambda p: A.top_mrp_revenue_share(p.clean_fact(), TOP_K),
    "avg_revenue_by_month": lambda p: A.avg_revenue_by_month(p.clean_fact()),
    "monthly_revenue_by_year": lambda p: A.monthly_revenue_by_year(p.orders_360()),
    # R — dashboard views
    "revenue_drilldown": lambda p: R.revenue_drilldown(p.clean_fact(), p.keeper("revenue_drilldown")),
    "kpi_slicer_cube": lambda p: R.kpi_slicer_cube(p.clean_fact(), p.keeper("kpi_slicer_cube")),
    "revenue_drilldown_approx": lambda p: R.revenue_drilldown_approx(p.clean_fact(), p.keeper("revenue_drilldown_approx")),
    "kpi_slicer_cube_approx": lambda p: R.kpi_slicer_cube_approx(p.clean_fact(), p.keeper("kpi_slicer_cube_approx")),
    "monthly_growth": lambda p: R.monthly_growth(p.fact_by_month()),
    "store_lead_ratio": lambda p: R.store_lead_ratio(p.clean_fact(), TOP_K),
    "data_quality_summary": lambda p: R.data_quality_summary(p, PERIOD),
}

#: Estimates: no SQL gives the same numbers; tests hold them to their error bound.
ESTIMATES = {"revenue_drilldown_approx", "kpi_slicer_cube_approx"}

QUERIES: dict[str, Query] = {name: _q(fn) for name, fn in _PLANS.items()}
