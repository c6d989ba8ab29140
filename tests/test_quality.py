"""Discrepancy checks D1–D10 on hand-made rows."""

from pyspark.sql import functions as F

from conftest import rows
from fixtures import ORDERS_SCHEMA, line, register, tables
from tillroll.operators import quality as Q


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, None), (None, None)], "k long, v string")
    assert rows(Q.exact_duplicates(df)) == sorted([(1, "a", 2), (None, None, 2)], key=repr)


def test_multi_store_orders_counts_rows_and_orders(spark):
    t = tables(spark)
    r = Q.multi_store_orders(t.orders).collect()[0]
    assert (r.no_of_discrepant_orders, r.no_of_distinct_orders) == (2, 1)


def test_cumulative_lines_match_reference_join(spark):
    t = tables(spark)
    register(spark, t)
    keys = "customer_id, product_id, channel, delivered_storeid, bill_date_timestamp, cost_per_unit, mrp, discount"
    on = " AND ".join(f"f.{k} = r.{k}" for k in keys.split(", ") + ["quantity"])
    brute = spark.sql(f"""
        SELECT DISTINCT f.*, r.rnk FROM orders_v f JOIN (
          SELECT {keys}, quantity, rank() OVER (PARTITION BY {keys} ORDER BY quantity DESC) AS rnk FROM orders_v) r
        ON {on} WHERE r.rnk > 1""")
    got = Q.cumulative_lines(t.orders)
    assert rows(got) == rows(brute)
    assert [(r.order_id, r.quantity, r.rnk) for r in got.collect()] == [(6, 1, 2)]


def test_cumulative_rank_counts_ties_like_rank(spark):
    base = [line(1, 1, 1, 1, 1, q, "1", "1", "0", str(q)) for q in (5, 5, 3, 3, 1)]
    got = sorted((r.quantity, r.rnk) for r in Q.cumulative_lines(spark.createDataFrame(base, ORDERS_SCHEMA)).collect())
    # RANK: 5,5 -> 1; 3,3 -> 3; 1 -> 5
    assert got == [(1, 5), (3, 3), (3, 3)]


def test_multi_date_and_multi_customer(spark):
    df = spark.createDataFrame([line(1, 1, 1, 1, 1, 1, "1", "1", "0", "1"),
                                line(2, 1, 2, 1, 2, 1, "1", "1", "0", "1"),
                                line(3, 2, 2, 1, 2, 1, "1", "1", "0", "1")], ORDERS_SCHEMA)
    assert [r.order_id for r in Q.multi_date_orders(df).collect()] == [1, 1]
    assert [r.order_id for r in Q.multi_customer_orders(df).collect()] == [1]


def test_out_of_period_compares_at_midnight(spark):
    df = spark.createDataFrame([line(1, 1, 1, 1, 31, 1, "1", "1", "0", "1", hour=0),
                                line(1, 2, 1, 1, 31, 1, "1", "1", "0", "1", hour=8),
                                line(1, 3, 1, 1, 1, 1, "1", "1", "0", "1")], ORDERS_SCHEMA)
    got = [r.order_id for r in Q.out_of_period(df, "2022-01-01", "2022-01-31").collect()]
    assert got == [2]  # 31 Jan 08:00 is after '2022-01-31' (midnight), as in the reference


def test_product_category_repairs(spark):
    t = tables(spark)
    d9 = {r.product_id: r.category for r in Q.fix_na_category(t.products).collect()}
    assert d9 == {10: "toys", 11: "Others", 12: "food", 13: "food"}
    d10 = {r.product_id: r.category for r in Q.fix_missing_attributes(Q.fix_na_category(t.products)).collect()}
    assert d10 == {10: "toys", 11: "Others", 12: "Others", 13: "Others"}


def test_duplicates_by_digest(spark, monkeypatch):
    """Equal to the plain grouping, also where every row has one digest, and where nulls stand in other columns."""
    df = spark.sql("""select * from values (1, null, 'a', 0.0D), (null, 1, 'a', 0.0D), (1, null, 'a', -0.0D), (2, 2, null, double('NaN')), (2, 2, null, double('NaN')),
                      (2, 2, 'b', 1.0D) as t(x, y, s, d)""")
    want = sorted(map(repr, df.groupBy(*df.columns).count().where("count > 1").withColumnRenamed("count", "duplicate_count").collect()))
    assert len(want) == 2 and sorted(map(repr, Q.exact_duplicates(df).collect())) == want
    assert Q.exact_duplicates(df.where("s = 'b'")).collect() == [] and Q.exact_duplicates(df.where("false")).collect() == []
    monkeypatch.setattr(Q, "row_digest", lambda df: F.struct(F.lit(1).alias("h1"), F.lit(2).alias("h2")))
    assert sorted(map(repr, Q.exact_duplicates(df).collect())) == want


def test_counts_gathered_by_the_writes(spark):
    """What the stage writes observed equals the counts over the written tables; no read of the fact for them."""
    from tillroll.operators import reconcile as C
    from tillroll.plans import dashboard as R
    from tillroll.plans.batch import batch_for
    p = batch_for(spark, "/root/testdata/sf0.001")
    seen, final = p.seen_while_writing(), p.finalised_records()
    want = {"multi_store_rows": Q.rows_of_orders_with_spread(final, "delivered_storeid").count(),
            "multi_date_rows": Q.rows_of_orders_with_spread(final, "bill_date_timestamp").count(),
            "multi_customer_orders": Q.multi_customer_orders(final).count(),
            "store_fixes": final.join(final.groupBy("order_id").agg(F.min("delivered_storeid").alias("m")), "order_id").where("m <> delivered_storeid").count(),
            "date_fixes": final.join(final.groupBy("order_id").agg(F.max("bill_date_timestamp").alias("m")), "order_id").where("m <> bill_date_timestamp").count()}
    assert seen == want and seen["multi_store_rows"] > 0 and seen["date_fixes"] > 0
    # another batch over the same inputs finds the stages and what was seen
    assert p.variant().seen_while_writing() == want
    df = R.data_quality_summary(p, ("1995-09-01", "2001-03-31"))
    counted = {r.check_name: r.affected_rows for r in df.collect()}
    assert {k: counted[k] for k in want} == want
    # the observed aggregate stands above the last exchange, in the job's result stage
    plan = p.clean_fact().observe("x", F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "CollectMetrics" in plan
    assert set(C.ORDER_CHECKS) | set(C.FACT_CHECKS) == set(want)
