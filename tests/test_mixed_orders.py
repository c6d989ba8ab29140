"""Only orders whose lines differ in store, date or customer meet the multi-store steps and the repairs; the others' lines
go to the fact as they are, with the same result."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fixtures import ORDERS_SCHEMA, line, tables
from tillroll.operators import marts, reconcile as C
from tillroll.operators.perkey import likely_with
from tillroll.plans.batch import CleaningBatch


@pytest.fixture(scope="module")
def t(spark):
    t = tables(spark)
    base = [tuple(r) for r in t.orders.collect()]
    odd = [line(2, 8, 10, 100, 4, 1, "5.00", "10.00", "0.00", "10.00"), line(1, 8, 10, 100, 4, 1, "5.00", "10.00", "0.00", "10.00"),  # two customers
           line(1, None, 10, 100, 4, 1, "5.00", "10.00", "0.00", "10.00"), line(None, 1, 10, 100, 1, 1, "5.00", "10.00", "0.00", "10.00")]
    pays = t.payments.unionByName(spark.sql("select 8L order_id, 'voucher' payment_type, cast(10 as decimal(12,2)) payment_value"))
    revs = t.reviews.unionByName(spark.sql("select 8L order_id, 4 customer_satisfaction_score"))
    # order 1 comes twice, and its customer too: repeated lines in an order of one store
    orders = spark.createDataFrame(base + base[:2] + odd, ORDERS_SCHEMA)
    pays = pays.unionByName(spark.sql("select 1L order_id, 'voucher' payment_type, cast(17.5 as decimal(12,2)) payment_value"))
    return t.replace(orders=orders, payments=pays, reviews=revs, customers=t.customers.unionByName(t.customers.where("custid = 1")))


def test_fact_equals_the_whole_steps(spark, t):
    p = CleaningBatch(spark, t, "mixed")
    co, op = C.cust_order_totals(t.orders), C.order_payment_totals(t.payments)
    rec = C.reconciled_orders(t.orders, C.matched_orders(co, op), C.remaining_orders(C.orders_not_matching(co, op), t.orders))
    integ = C.integrated_orders(rec, t.reviews, t.products, t.stores, t.customers)
    ins = C.multi_store_insert(C.multi_store_lines(t.orders), t.products, t.payments, t.customers, t.reviews, t.stores)
    final = C.finalised_records(C.append_multi_store(integ, ins), C.multi_store_records(ins), integ)
    assert rows(p.integrated_orders()) == rows(integ) and rows(p.multi_store_insert()) == rows(ins)
    assert rows(p.finalised_records()) == rows(final) and final.dtypes == p.finalised_records().dtypes
    fact = C.clean_fact(final, marts.payment_summary(t.payments), True)
    assert rows(p.fact_with_payments(), fact.columns) == rows(fact)
    assert rows(p.stores_fixed_of_finalised()) == rows(C.fix_store_to_min(final))
    assert rows(p.dates_fixed()) == rows(C.fix_date_to_latest(p.store_fixed()))
    mixed = {r.order_id: r[C.MIXED] for r in p.fact_with_payments().collect()}
    assert mixed[3] and not mixed[1] and mixed.get(8, True)
    p.store.drop()


def test_one_grouping_of_the_lines_and_few_of_them_moved(spark, t):
    """The batch reads the order lines' totals once; settled lines meet neither the set difference nor C12's join."""
    p = CleaningBatch(spark, t, "moved")
    p.fact_with_payments()
    settled = p.integrated_lines().where(~F.col(C.MIXED)).select("order_id").distinct()
    assert settled.count() > 0 and p.finalised_mixed().join(settled, "order_id").count() == 0
    assert p.store.stage(f"clean_fact.{C.ORDER_REPAIRS}", lambda: None).join(settled, "order_id").count() == 0
    for df in (p.cust_order_totals(), p.order_payment_totals(), p.payment_summary()):
        assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()
    p.store.drop()


def test_repeated_lines_by_digest(spark, monkeypatch):
    df = spark.sql("""select * from values (1, null, 0.0D, 'x'), (null, 1, 0.0D, 'y'), (1, null, -0.0D, 'x'), (2, 2, double('NaN'), 'z'), (2, 2, double('NaN'), 'z'), (3, 3, 1.0D, 'w')
                      as t(a, b, d, note)""")
    want = sorted(map(repr, df.dropDuplicates(["a", "b", "d"]).selectExpr("a", "b", "abs(d) d", "note").collect()))
    got = lambda: sorted(map(repr, C.unrepeated(df, ["a", "b", "d"]).selectExpr("a", "b", "abs(d) d", "note").collect()))
    assert len(want) == 4 and got() == want
    one = df.where("a = 3")
    assert "Exchange" not in C.unrepeated(one, ["a", "b", "d"])._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(C.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    assert got() == want


def test_likely_rows_hold_all_wanted(spark):
    lines, wanted = spark.range(50_000).withColumn("name", F.concat(F.lit("o"), "id")), spark.range(0, 50_000, 40)
    kept = likely_with(lines, wanted, "id")
    assert kept.columns == lines.columns and kept.join(wanted, "id").count() == 1_250 and kept.count() < 1_500
    assert likely_with(lines, wanted.select(F.concat(F.lit("o"), "id").alias("name")), "name").count() >= 1_250
    assert likely_with(lines, wanted.where("false"), "id").count() == 0


def test_products_of_an_order_are_counted_apart(spark, t):
    """One row an order is shuffled with the sums, also where channel or date is null."""
    p = CleaningBatch(spark, t, "apart")
    fact = p.fact_with_payments()
    fact = fact.withColumn("channel", F.when(F.col("order_id") != 3, F.col("channel")))
    got = marts.orders_360(fact, None)
    want = fact.groupBy("order_id", "customer_id", "channel", "bill_date_timestamp").agg(F.countDistinct("product_id").alias("n"), F.sum(F.col("total_amount") * F.col("_np")).alias("v"))
    assert rows(got.selectExpr("order_id", "customer_id", "channel", "bill_date_timestamp", "distinct_products_in_order", "cast(total_order_value as double)")) == \
        rows(want.selectExpr("order_id", "customer_id", "channel", "bill_date_timestamp", "n", "cast(v as double)"))
    p.store.drop()
