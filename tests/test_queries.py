"""Every registered query against its DuckDB oracle on the smallest fixture (sf0.001), the
entry point, and plan properties of the main operators."""

import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def _bag(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else float(f"{v:.12g}")
        return v
    return sorted((tuple(repr(norm(r[i])) for i in order) for r in rows))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    from tillroll.oracle import oracle_sql
    from tillroll.plans.registry import ESTIMATES, QUERIES
    assert set(QUERIES) - ESTIMATES <= set(oracle_sql())


def test_queries_match_oracle(spark, con):
    from tillroll.oracle import oracle_sql
    from tillroll.plans.registry import QUERIES
    sql = oracle_sql()
    bad = []
    for name, fn in QUERIES.items():
        if name not in sql:
            continue
        df = fn(spark, SF)
        got = [tuple(r) for r in df.collect()]
        cur = con.execute(sql[name])
        cols = [d[0] for d in cur.description]
        want = cur.fetchall()
        if sorted(df.columns) != sorted(cols) or _bag(got, df.columns) != _bag(want, cols):
            bad.append(name)
    assert bad == []


def test_entry(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0
    assert "customer_id" in df.columns


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    from tillroll.plans import analysis as A
    from tillroll.plans.batch import batch_for
    p = batch_for(spark, SF)
    assert "LeftAnti" in _plan(p.orders_not_matching())
    assert "WindowGroupLimit" in _plan(A.top_categories_by(p.clean_fact(), "region"))
    assert "TakeOrderedAndProject" in _plan(A.top_stores_by_revenue(p.clean_fact()))
    for df in (p.customer_360(), p.orders_360(), p.store_360(), p.clean_fact()):
        assert "CartesianProduct" not in _plan(df) and "BroadcastNestedLoopJoin" not in _plan(df)


def test_reports_scan_the_fact_once(spark):
    """Totals come from the per-key aggregate: its exchange is reused, or all is one aggregation."""
    from tillroll.plans import analysis as A
    from tillroll.plans.batch import batch_for
    p = batch_for(spark, SF)
    for fn in (A.channel_contribution, A.top_stores_revenue_share, A.top_aov_store_shares, A.top_aov_revenue_share,
               A.gender_customer_share, A.gender_revenue_share):
        df = fn(p.clean_fact())
        df.collect()
        assert "ReusedExchange" in _plan(df), fn.__name__
    share = A.cohort_revenue_share(p.customer_360(), A.repeat_buyers(), ("n", "revenue", "share"))
    assert _plan(share).count("FileScan") == 1
    assert _plan(A.top_mrp_revenue_share(p.clean_fact())).count("FileScan") == 2


def test_marts_and_levels_copy_no_lines(spark):
    """No Expand over fact lines: in the marts none at all, in the reports only small cells are copied for levels."""
    from tillroll.operators import marts as M
    from tillroll.plans import dashboard as R
    from tillroll.plans.batch import batch_for
    p = batch_for(spark, SF)
    fact = p.fact_with_payments()
    for df in (M.customer_360(p.t.customers, fact, None), M.customer_360(p.t.customers, fact, None, True), M.orders_360(fact, None), M.store_360(p.clean_fact(), p.t.stores)):
        assert "Expand" not in _plan(df) and "Generate explode" not in _plan(df.select(df.columns[0]))
    for fn in (R.revenue_drilldown, R.kpi_slicer_cube, R.revenue_drilldown_approx, R.kpi_slicer_cube_approx):
        reads, scans_fact = [], lambda df: any("/clean_fact/" in f for f in df.inputFiles())
        made = fn(p.clean_fact(), lambda name, df: reads.append(scans_fact(df)) or p.keeper("test_levels" + fn.__name__)(name, df))
        assert "Expand" not in _plan(made) and not scans_fact(made)  # cells only
        assert sum(reads) == 1, fn.__name__  # the fact is read once


def test_bitmaps_and_sketches(spark):
    """Levels of bitmaps equal Spark's own rollup, for dense, sparse, negative and text values; sketches stay in bound."""
    from pyspark.sql import functions as F

    from tillroll.operators import distinct as D
    n = F.col("id")
    rows = spark.range(30_000).select((n % 3).alias("a"), F.when(n % 5 > 0, (n % 7).cast("string")).alias("b"), (n * 7919 % 9000 - 4000).alias("dense"), n.alias("v"))
    rows = rows.withColumn("sparse", F.col("dense") * 10**12).withColumn("name", F.concat(F.lit("k"), F.col("dense").cast("string")))
    rows = rows.withColumn("dense", F.when(F.col("v") % 11 > 0, F.col("dense")))
    for value in ("dense", "sparse", "name"):
        want = rows.cube("a", "b").agg(F.grouping_id().alias("_level"), F.sum("v").alias("v"), F.countDistinct(value).alias("n"))
        sums = rows.groupBy("a", "b").agg(F.sum("v").alias("v"))
        bits = D.bitmaps(D.numbered(rows, value, "numbers"), ["a", "b"])
        got = D.merged_levels(sums, ["a", "b"], [0, 1, 2, 3], ["v"], {"n": (bits, [0, 1, 2, 3])})
        bag = lambda df: sorted(map(repr, df.select("_level", "a", "b", "v", "n").selectExpr("int(_level)", "a", "b", "v", "n").collect()))
        assert bag(got) == bag(want), value
        cells = rows.groupBy("a", "b").agg(F.sum("v").alias("v"), D.sketch(value).alias("s"))
        told = {(r._level, r.a, r.b): r.n for r in D.merged_sketches(cells, ["a", "b"], [0, 1, 2, 3], ["v"], {"n": "s"}).collect()}
        exact = {(r._level, r.a, r.b): r.n for r in want.collect()}
        assert told.keys() == exact.keys() and all(abs(told[k] - exact[k]) <= 4 * 1.04 / 2**7 * exact[k] + 1 for k in exact)
    empty = D.bitmaps(D.numbered(rows.where("false"), "dense", "numbers"), ["a", "b"])
    assert D.merged_levels(rows.where("false").groupBy("a", "b").agg(F.sum("v").alias("v")), ["a", "b"], [0, 3], ["v"], {"n": (empty, [0, 3])}).collect() == []


def test_plan_lint(spark):
    """No cartesian / nested-loop join, no Python on the data path, and no Window on a single
    partition except over bounded inputs, in any registered query."""
    from tillroll.plans.registry import QUERIES
    sys_path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts")
    import sys
    sys.path.insert(0, sys_path)
    from plan_lint import lint, plan_text
    bad = {name: lint(name, plan_text(fn(spark, SF))) for name, fn in QUERIES.items()}
    assert {k: v for k, v in bad.items() if v} == {}
