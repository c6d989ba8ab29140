"""A hot order holding a third of all lines (several stores, dates and payments): the cleaning
batch and the marts give the same results as the reference's literal SQL."""

import pytest

from conftest import rows
from fixtures import ORDERS_SCHEMA, PAYMENTS_SCHEMA, line, register, tables
from tillroll.operators import marts as M
from tillroll.operators import reconcile as C
from tillroll.operators import quality as Q


@pytest.fixture(scope="module")
def skewed(spark):
    from decimal import Decimal as D
    t = tables(spark)
    base = [tuple(r) for r in t.orders.collect()]
    # order 9: 12 lines (a third of the table), stores 100/200/300, three dates, 3 payments
    hot = [line(9, 9, 10 + i % 4, (100, 200, 300)[i % 3], 10 + i % 3, 1 + i % 3, "1.00", "2.00", "0.00",
                f"{2 * (1 + i % 3)}.00") for i in range(12)]
    orders = spark.createDataFrame(base + hot + hot[:3], ORDERS_SCHEMA)  # 3 exact duplicate lines
    total = sum(2 * (1 + i % 3) for i in range(12)) + sum(2 * (1 + i % 3) for i in range(3))
    pays = [tuple(r) for r in t.payments.collect()] + [(9, "voucher", D(10)), (9, "credit_card", D(10)),
                                                       (9, "debit_card", D(total - 20))]
    customers = t.customers.unionByName(spark.createDataFrame([(9, "city9", "S1", "F")], t.customers.schema))
    t = t.replace(orders=orders, payments=spark.createDataFrame(pays, PAYMENTS_SCHEMA), customers=customers,
                  reviews=t.reviews.unionByName(spark.createDataFrame([(9, 4)], "order_id long, customer_satisfaction_score int")))
    register(spark, t)
    return t


def _clean(t):
    co, op = C.cust_order_totals(t.orders), C.order_payment_totals(t.payments)
    rec = C.reconciled_orders(t.orders, C.matched_orders(co, op), C.remaining_orders(C.orders_not_matching(co, op), t.orders))
    integ = C.integrated_orders(rec, t.reviews, t.products, t.stores, t.customers)
    ins = C.multi_store_insert(C.multi_store_lines(t.orders), t.products, t.payments, t.customers, t.reviews, t.stores)
    return C.clean_fact(C.finalised_records(C.append_multi_store(integ, ins), C.multi_store_records(ins), integ))


def test_hot_order_through_cleaning_and_marts(spark, skewed):
    t = skewed
    f8 = _clean(t)
    f8.createOrReplaceTempView("f8_skew")
    hot = f8.where("order_id = 9").collect()
    assert hot and len({r.delivered_storeid for r in hot}) == 1 and len({r.bill_date_timestamp for r in hot}) == 1
    brute = spark.sql("""
        SELECT f.order_id, count(f.product_id) AS n, sum(f.total_amount) AS v,
               count(DISTINCT f.product_id) AS dp
        FROM f8_skew f JOIN orderpayments p ON f.order_id = p.order_id
        GROUP BY f.order_id, f.customer_id, f.channel, f.bill_date_timestamp""")
    got = M.orders_360(f8, t.payments).select("order_id", "total_products_in_order", "total_order_value",
                                               "distinct_products_in_order")
    assert rows(got) == rows(brute)
    assert Q.exact_duplicates(t.orders).count() == 3
