"""Distinct counts of the marts, each apart from the sums."""

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import rows
from tillroll.operators import marts
from tillroll.plans.batch import batch_for


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_marts_keep_no_sets_beside_the_sums(spark):
    p = batch_for(spark, "/root/testdata/sf0.001")
    for made in (marts.customer_360(p.t.customers, p.fact_with_payments(), None), marts.store_360(p.clean_fact(), p.t.stores)):
        sums = [x for x in plan(made).splitlines() if "Aggregate" in x and "sum(" in x]
        assert sums and not any("collect_set" in x or "distinct" in x for x in sums)


def test_counts_of_a_customer_without_values(spark):
    """Nulls are no value, and a customer with none of a column keeps its row with 0."""
    day = datetime(2023, 1, 1)
    fact = spark.createDataFrame(
        [(1, 7, 5, None, None, None, day, 1, Decimal("1"), Decimal("0"), Decimal("3"), []),
         (1, 8, 5, None, None, None, day, 1, Decimal("1"), Decimal("0"), Decimal("3"), []),
         (2, 9, 5, "a", 4, "x", day, 1, Decimal("1"), Decimal("0"), Decimal("3"), ["card", "upi"]),
         (2, 9, 6, "b", 4, "y", day, 1, Decimal("1"), Decimal("0"), Decimal("3"), ["card", "cash"])],
        "customer_id long, order_id long, product_id long, category string, delivered_storeid long, seller_city string, "
        "bill_date_timestamp timestamp_ntz, quantity int, cost_per_unit decimal(12,2), discount decimal(12,2), total_amount decimal(18,8), _types array<string>")
    fact = fact.select("*", F.lit(1).cast("bigint").alias("_np"), *[F.lit(0).cast("bigint").alias(c) for c in marts.SUMMARY_COLS[1:-1]])
    customers = spark.createDataFrame([(1, "c", "s", "M"), (2, "c", "s", "F"), (2, "c", "s", "F")], "custid long, customer_city string, customer_state string, gender string")
    made = marts.customer_360(customers, fact, None)
    assert rows(made, ["customer_id", "total_distinct_transactions", "distinct_items_purchased", "distinct_categories_purchased",
                       "distinct_stores_purchased", "distinct_cities_purchased", "different_payment_types_used"]) == [
        (1, 2, 1, 0, 0, 0, 0), (2, 1, 2, 2, 1, 2, 3)]
