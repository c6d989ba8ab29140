"""A dimension's attributes by broadcast codes: the rows of the join, None where the codes would not fit, and fewer shuffles."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillroll.operators import lookup as L
from tillroll.operators import reconcile
from tillroll.plans.batch import CleaningBatch, batch_for
from tillroll.sources.tables import fixture_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def always(monkeypatch):
    """Lookups of small dimensions too."""
    monkeypatch.setattr(L, "SMALL", -1)


def dim(spark, data, key="long"):
    return spark.createDataFrame(data, f"k {key}, a string, b int")


def test_attributes_as_by_the_join(spark, always):
    made = dim(spark, [(k, None if k % 7 == 0 else f"a{k % 5}", k % 3) for k in range(-300, 900) if k % 11] + [(None, "x", 1), (5, "a0", 2), (5, "a0", 2)])
    found = L.lookup(made, "k", ["a", "b"], "dim")
    lines = spark.createDataFrame([(i, i % 1500 - 400 if i % 13 else None) for i in range(4000)], "i int, k long")
    counted = made.groupBy("k", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    cols = ["i", "k", "a", "b", "n"]
    assert rows(found.attach(lines, "k", "n"), cols) == rows(lines.join(counted, "k"), cols) and not found.once
    assert rows(found.attach(lines, "k", "n", "left"), cols) == rows(lines.join(counted, "k", "left"), cols)
    assert L.lookup(made.distinct(), "k", ["a", "b"], "dim").once


def test_what_does_not_fit_is_left_to_the_join(spark, always, monkeypatch):
    good = [(k, "a", 1) for k in range(500)]
    assert L.lookup(dim(spark, good), "k", ["a", "b"], "dim")
    assert L.lookup(dim(spark, [(str(k), a, b) for k, a, b in good], "string"), "k", ["a", "b"], "dim") is None
    assert L.lookup(dim(spark, []), "k", ["a", "b"], "dim") is None
    assert L.lookup(dim(spark, [*good, (7, "b", 1)]), "k", ["a", "b"], "dim") is None  # a key with two values, in a full bucket
    assert L.lookup(dim(spark, [(1, "a", 1), (1, "b", 1), (2, "a", 1)]), "k", ["a", "b"], "dim") is None  # and in another
    assert L.lookup(dim(spark, [*good, (2**40, "a", 1)]), "k", ["a", "b"], "dim") is None
    monkeypatch.setattr(L, "MOST_VALUES", 20)
    assert L.lookup(dim(spark, [(k, f"a{k % 21}", 1) for k in range(500)]), "k", ["a", "b"], "dim") is None
    monkeypatch.setattr(L, "SMALL", 2**20)
    assert L.lookup(dim(spark, good).coalesce(1), "k", ["a", "b"], "dim") is None or not L.broadcast_by_spark(dim(spark, good))


def test_fact_with_lookups_equals_the_joined_one(spark, always):
    p = CleaningBatch(spark, lambda stage: fixture_tables(spark, SF, stage), key="lookups")
    assert all(p.lookups().values()) and p.lookups()["products"].once
    want = batch_for(spark, SF)
    for name in ("integrated_orders", "multi_store_insert", "clean_fact"):
        assert rows(getattr(p, name)()) == rows(getattr(want, name)()), name
        assert getattr(p, name)().dtypes == getattr(want, name)().dtypes
    assert rows(p.variant(refresh_store_attrs=True).clean_fact()) == rows(want.variant(refresh_store_attrs=True).clean_fact())


def test_c7_shuffles_the_lines_once(spark, always):
    p = CleaningBatch(spark, lambda stage: fixture_tables(spark, SF, stage), key="lookups-plan")
    t = p.t
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        args = (t.orders, p.matched_orders(), p.remaining_orders(), t.reviews, t.products, t.stores, t.customers)
        exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")
        joined, looked = reconcile.reconciled_integrated(*args), reconcile.reconciled_integrated(*args, lookups=p.lookups())
        assert exchanges(looked) <= exchanges(joined) - 6
        assert rows(looked) == rows(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_orders_of_several_customers_are_grouped_apart(spark):
    totals = spark.createDataFrame([
        (1, 1, 1, 1, 1, 1), (1, 2, 1, 2, 1, 1), (1, 3, 1, 1, 1, 2), (1, 4, 1, 1, 1, 1), (2, 4, 1, 1, 1, 1), (1, 5, 1, 1, 1, 1), (2, 5, 2, 2, 1, 1),
        (1, None, 1, 1, 1, 1), (2, None, 2, 2, 1, 1), (1, 6, None, None, None, None), (None, 7, 1, 1, 1, 1), (None, 8, 1, 1, 1, 1), (1, 8, 1, 1, 2, 2)],
        "customer_id int, order_id int, _min_store int, _max_store int, _min_date int, _max_date int")
    kept = []

    def keep(name, df):
        kept.append((name, df.count()))
        return df

    assert rows(reconcile.order_spread(totals, keep)) == rows(reconcile.order_spread(totals)) and kept == [("orders_of_several_customers", 4)]
