"""Rewrites that move fewer bytes: the same rows, and plans without what moved more."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillroll.operators import quality, reconcile
from tillroll.plans.batch import batch_for
from tillroll.sources.tables import ORDER_COLS, fixture_orders

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def batch(spark):
    return batch_for(spark, SMALL)


def test_lowest_supplier_needs_no_shuffle_of_its_own(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(fixture_orders(spark, SMALL)).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def line(order, product, store, quantity, amount):
    return dict(customer_id=1, order_id=order, product_id=product, channel="Online", delivered_storeid=store, bill_date_timestamp=datetime(2023, 1, 1),
                quantity=quantity, cost_per_unit=Decimal("1"), mrp=Decimal("2"), discount=Decimal("0"), total_amount=Decimal(amount))


SCHEMA = ("customer_id long, order_id long, product_id long, channel string, delivered_storeid long, bill_date_timestamp timestamp_ntz, quantity bigint, "
          "cost_per_unit decimal(12,2), mrp decimal(12,2), discount decimal(12,2), total_amount decimal(28,8)")


def attributed(spark, lines):
    df = spark.createDataFrame([tuple(x[c] for c in ORDER_COLS) for x in lines], SCHEMA)
    return df.select("*", F.when(F.col("product_id") != 3, "c").alias("category"), F.lit(4.0).alias("avg_rating"),
                     *[F.lit("x").alias(c) for c in reconcile.ENRICH_COLS[2:]])


def test_finalised_with_insert_equals_the_set_difference(spark):
    lines = attributed(spark, [line(1, 1, 1, 1, "5"), line(1, 1, 1, 1, "5"), line(1, 2, 2, 3, "9"), line(1, 3, 2, 2, "7"), line(1, 5, 2, 2, "6"),
                               line(2, 1, 1, None, "4"), line(None, 1, 1, 1, "1")])
    insert = attributed(spark, [
        line(1, 1, 1, 1, "5"),  # alone in its group: C10 has the same row, which takes C7's line along
        line(1, 2, 2, 1, "3"), line(1, 2, 2, 2, "6"),  # two rows, whose sum is a line of C7
        line(1, 3, 2, 1, "7"), line(1, 3, 2, 1, "7"),  # the same row twice
        line(1, 4, 2, 0, "0"), line(1, 4, 2, 2, "8"),  # the sum is one of the rows
        line(2, 1, 1, None, "4"), line(9, 1, 1, 1, "5"), line(9, 2, 1, 1, "5"), line(9, 2, 1, 2, "5"), line(None, 1, 1, 1, "1"), line(None, 1, 2, 1, "1")])
    made = reconcile.finalised_with_insert(lines, insert)
    was = reconcile.finalised_records(reconcile.append_multi_store(lines, insert), reconcile.multi_store_records(insert), lines)
    appended, right = reconcile.append_multi_store(lines, insert), reconcile.multi_store_records(insert)
    literal = appended.subtract(right.join(lines.select("order_id"), "order_id").select(*reconcile.FACT_COLS))
    assert rows(made, reconcile.FACT_COLS) == rows(was, reconcile.FACT_COLS) == rows(literal, reconcile.FACT_COLS)
    assert made.dtypes == was.dtypes


def test_remaining_orders_with_few_lines_shuffled(spark, tmp_path):
    orders = spark.createDataFrame([(1, 1, "5.2"), (1, 1, "5.4"), (1, 2, "5"), (None, 1, "5"), (2, 3, "7"), (2, None, "5")],
                                   "customer_id long, order_id long, total_amount string").withColumn("total_amount", F.col("total_amount").cast("decimal(18,8)"))
    wanted = spark.createDataFrame([(1, 5), (3, 8), (None, 5)], "order_id long, paymenttotal int").withColumn("paymenttotal", F.col("paymenttotal").cast("decimal(11,0)"))
    kept = []

    def keep(name, df):
        kept.append(name)
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    made = reconcile.remaining_orders(wanted, orders, keep)
    assert rows(made) == rows(reconcile.remaining_orders(wanted, orders)) and made.count() == 3
    assert kept == ["orders_not_matching"]


def test_batch_filters_the_lines_of_c5(batch):
    assert "bitmap" in plan(batch.remaining_orders())


def test_set_difference_shuffles_whole_rows_only_where_digests_repeat(spark, tmp_path):
    """Rows of the insert that share no group and equal no other row stay where they are; the rest as the literal set difference has it."""
    lines = attributed(spark, [line(o, p, 1, 1, str(o)) for o in range(1, 40) for p in (1, 2)] + [line(None, 1, 1, 1, "1"), line(50, 1, 1, 1, "2")])
    lines = lines.withColumns({"quantity": F.col("quantity").cast("int"), "total_amount": F.col("total_amount").cast("decimal(18,8)")})
    insert = attributed(spark, [line(o, 1, 1, 1, str(o)) for o in range(1, 60)] + [
        line(None, 1, 1, 1, "1"), line(None, 2, 1, 1, "1"), line(50, 1, 1, 1, "0"), line(50, 1, 1, 1, "2"), line(90, 1, 1, 1, "2"), line(90, 1, 1, 1, "0"), line(90, 1, 1, 1, "2")])
    kept = {}

    def keep(name, df):
        df.write.parquet(str(tmp_path / name))
        kept[name] = spark.read.parquet(str(tmp_path / name))
        return kept[name]

    made = reconcile.finalised_with_insert(lines, insert, keep)
    was = reconcile.finalised_records(reconcile.append_multi_store(lines, insert), reconcile.multi_store_records(insert), lines)
    assert rows(made, reconcile.FACT_COLS) == rows(was, reconcile.FACT_COLS) and made.dtypes == was.dtypes
    wide = [name for name, df in kept.items() if len(df.columns) > 1]
    assert sum(kept[name].count() for name in wide) <= 4 and kept["insert_orders_outside"].count() == 21


def test_c6_leaves_out_lines_before_products_and_stores(spark, batch):
    t, kept = batch.t, []

    def keep(name, df):
        kept.append(name)
        return df

    args = (t.orders, batch.matched_orders(), batch.remaining_orders(), t.reviews, t.products, t.stores, t.customers)
    made = reconcile.reconciled_integrated(*args, keep=keep)
    assert kept == ["reconcile_plan"] and "bitmap" in plan(made)
    assert rows(made) == rows(reconcile.reconciled_integrated(*args))


def test_cumulative_lines_finds_varied_keys_by_digest(spark, tmp_path, monkeypatch):
    lines = spark.createDataFrame([tuple(x[c] for c in ORDER_COLS) for x in
                                   [line(1, 1, 1, 2, "5"), line(2, 1, 1, 3, "5"), line(3, 1, 1, 3, "5"), line(1, 2, 1, 2, "5"), line(2, 2, 1, 2, "5"), line(1, 3, 1, 1, "5")]], SCHEMA)
    kept = {}

    def keep(name, df):
        path = str(tmp_path / f"{name}{len(kept)}")
        df.write.parquet(path)
        kept[name] = spark.read.parquet(path)
        return kept[name]

    want = [(1, 1, 3)]
    got = lambda: rows(quality.cumulative_lines(lines, keep=keep), ["order_id", "product_id", "rnk"])
    assert got() == want and kept["varied_keys"].columns == ["_d"] and kept["lines_of_varied_keys"].count() == 3
    monkeypatch.setattr(quality, "likely_with", lambda rows, wanted, key: rows)
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.lit(7).cast("long"))  # all keys share one digest
    assert got() == want


def test_mixed_and_unmatched_orders_are_written_once(spark, batch):
    assert rows(batch.mixed_orders().select("order_id")) == rows(reconcile.mixed_orders(batch.order_totals()))
    assert rows(batch.mixed_orders().where("_several").select("order_id")) == rows(reconcile.several_stores(batch.order_totals()))
    for df in (batch.mixed_orders(), batch.unmatched_orders()):
        assert "Exchange" not in plan(df)
    assert rows(batch.unmatched_orders()) == rows(reconcile.orders_not_matching(batch.cust_order_totals(), batch.order_payment_totals()))
