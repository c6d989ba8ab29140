"""Global rankings (H4) against Spark's own window functions: ties, nulls, N < k, N = 1,
ascending and descending; and the plans never put a Window under a single partition."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.operators.ranking import Key, global_ntile, global_row_number, percentile_above


def _df(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.one_of(st.none(), st.integers(0, 5)), min_size=1, max_size=60),
       k=st.integers(1, 7), asc=st.booleans(),
       thresholds=st.lists(st.sampled_from([0, 25, 40, 50, 70, 90, 100]), min_size=1, max_size=3))
def test_ntile_and_percentiles_match_windows(spark, values, k, asc, thresholds):
    df = _df(spark, values)
    key = F.col("v").asc_nulls_first() if asc else F.col("v").desc_nulls_last()
    order = [key, F.col("id").asc()]
    got = {r.id: r.t for r in global_ntile(df, k, [Key("v", asc), Key("id")], "t", num_partitions=3).collect()}
    want = {r.id: r.t for r in df.withColumn("t", F.ntile(k).over(Window.orderBy(*order))).collect()}
    assert got == want
    above = percentile_above(df, Key("v", asc), thresholds, ["id"], num_partitions=3)
    marks = df.select("id", F.array(*above).alias("a"))
    ranks = df.withColumn("p", F.percent_rank().over(Window.orderBy(key)) * 100)
    assert {r.id: r.a for r in marks.collect()} == {r.id: [r.p > t for t in thresholds] for r in ranks.collect()}


def test_row_number_with_heavy_ties(spark):
    random.seed(7)
    values = [None if random.random() < 0.1 else (3 if random.random() < 0.5 else random.randint(0, 1000))
              for _ in range(5000)]
    df = _df(spark, values)
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    got, n = global_row_number(df, order, "rn", num_partitions=8)
    assert n == 5000
    want = df.withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    assert {r.id: r.rn for r in got.collect()} == {r.id: r.rn for r in want.collect()}


def test_one_row_and_none(spark):
    one, none = _df(spark, [42]), _df(spark, [42]).where("v is null")
    for df in (one, none):
        assert df.select(*percentile_above(df, Key("v"), [0, 40])).collect() == [(False, False)] * df.count()
        assert [r.ntile for r in global_ntile(df, 4, [Key("v")]).collect()] == [1] * df.count()


def test_decimals_and_heavy_ties(spark):
    df = _df(spark, [0] * 300 + list(range(100))).withColumn("v", (F.col("v") / 7).cast("decimal(38,8)"))
    want = df.withColumn("t", F.ntile(4).over(Window.orderBy("v", "id")))
    got = global_ntile(df, 4, [Key("v"), Key("id")], "t", num_partitions=5)
    assert {r.id: r.t for r in got.collect()} == {r.id: r.t for r in want.collect()}


def test_no_join_and_no_scratch_left(spark):
    import glob
    df = _df(spark, list(range(100)))
    upper = df.where(percentile_above(df, Key("v"), [40], ["id"])[0])
    out = global_ntile(upper, 4, [Key("v"), Key("id")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "Exchange" not in plan
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not glob.glob(f"{root}/tillroll-scratch/*/borders-*")
