"""A hot order's fanned-out amounts, and stages that follow their inputs."""

import dataclasses

import pytest

from tillroll.operators import reconcile
from tillroll.plans.batch import CleaningBatch
from tillroll.sources.tables import fixture_tables


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_hot_order_amounts_are_whole(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        multi = spark.sql("""select 1L customer_id, 1L order_id, 1L product_id, 'Online' channel, 1L delivered_storeid, timestamp_ntz'2022-01-01 00:00:00' bill_date_timestamp,
            1 quantity, cast(1 as decimal(12,2)) cost_per_unit, cast(1 as decimal(12,2)) mrp, cast(0 as decimal(12,2)) discount, cast(10000 as decimal(18,8)) total_amount,
            cast(10000 as decimal(18,8)) net_amount, 1 net_qty""")
        products = spark.sql("select 1L product_id, 'c' category")
        payments = spark.range(20_000).selectExpr("1L order_id", "id payment_value")
        customers = spark.sql("select 1L custid, 'c' customer_city, 's' customer_state, 'M' gender")
        reviews = spark.range(200).selectExpr("1L order_id", "5 customer_satisfaction_score")
        stores = spark.sql("select 1L storeid, 'c' seller_city, 's' seller_state, 'r' region")
        out = reconcile.multi_store_insert(multi, products, payments, customers, reviews, stores)
        assert [(int(r.quantity), int(r.total_amount)) for r in out.collect()] == [(4_000_000, 40_000_000_000)]
        again = reconcile.multi_store_records(out.unionByName(out))
        assert [(int(r.quantity), int(r.total_amount)) for r in again.collect()] == [(8_000_000, 80_000_000_000)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_stages_follow_their_inputs(spark):
    tables = fixture_tables(spark, "/root/testdata/sf0.001")
    first = CleaningBatch(spark, tables, "one-key")
    assert first.integrated_orders().count() > 0
    other = CleaningBatch(spark, dataclasses.replace(tables, orders=tables.orders.where("false")), "one-key")
    assert other.integrated_orders().count() == 0
    other.store.drop()
    first.store.drop()
