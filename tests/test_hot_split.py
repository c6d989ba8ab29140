"""One order with a third of all lines, broadcasts off: the joins by order are split."""

import statistics

import pytest
from pyspark.sql import functions as F

from tillroll.operators import marts, quality, reconcile
from tillroll.operators.perkey import scratch

LINES, SETTINGS = 120_000, {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "64k",  # as many readers as files
}


@pytest.fixture(scope="module")
def hot(spark):
    """Fact-shaped lines: order 7 has a third of them, at three stores, on many dates and with two quantities."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    n = F.col("id")
    order = F.when(n % 3 == 0, F.lit(7)).otherwise(1000 + n % 20_000).cast("long")
    lines = spark.range(LINES, numPartitions=24).select(
        F.when(n % 3 == 0, 1).otherwise(n % 500).cast("long").alias("customer_id"), order.alias("order_id"),
        F.when(n % 3 == 0, 5).otherwise(n % 700).cast("long").alias("product_id"), F.lit("Online").alias("channel"),
        (n % 7 % 3 + 1).cast("long").alias("delivered_storeid"),
        F.timestamp_add("DAY", (n % 11).cast("int"), F.lit("2022-01-01").cast("timestamp_ntz")).alias("bill_date_timestamp"),
        (n % 2 + 1).cast("int").alias("quantity"), *[(n % 50_000).cast("decimal(12,2)").alias(c) for c in ("cost_per_unit", "mrp")],
        F.lit(0).cast("decimal(12,2)").alias("discount"), n.cast("decimal(18,8)").alias("total_amount"),
        F.lit("c").alias("category"), F.lit(4.0).alias("avg_rating"), *[F.lit(c).alias(c) for c in reconcile.ENRICH_COLS[2:]])
    yield scratch("hot-lines", lines)
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spread(df):
    """Rows in each task of the last stage, and the plan that ran."""
    whole = F.xxhash64(*df.columns)  # no column is pruned: partitions are judged by their bytes
    counts = df.select(F.spark_partition_id().alias("p"), whole.alias("h")).groupBy("p").agg(F.count("*").alias("count"), F.max("h"))
    rows = sorted(r["count"] for r in counts.collect())
    return rows, counts._jdf.queryExecution().executedPlan().toString()


def ran(df):
    """The plan of ``df`` after it ran whole, and its rows."""
    df = df.select(*[F.col(c) for c in df.columns])
    n = len(df.toArrow())
    return df._jdf.queryExecution().executedPlan().toString(), n


@pytest.mark.parametrize("name", ["D3", "D5", "D6", "C12"])
def test_last_join_is_split(hot, name):
    fn = {"D3": reconcile.fix_store_to_min, "D5": quality.multi_date_orders, "D6": reconcile.fix_date_to_latest, "C12": reconcile.clean_fact}[name]
    rows, plan = spread(fn(hot))
    assert "SortMergeJoin(skew=true)" in plan and sum(rows) == LINES
    # D5 moves order ids alone, and those of one order take next to no bytes
    assert rows[-1] <= 2 * statistics.median(rows) or name == "D5" and rows[-1] < LINES / 3 - 10_000, rows


def test_results_with_a_hot_order(hot):
    fixed = reconcile.clean_fact(hot)
    assert fixed.where("order_id = 7").select("delivered_storeid", "bill_date_timestamp").distinct().count() == 1
    orders = {r.order_id: r for r in hot.groupBy("order_id").agg(
        F.count("*").alias("n"), F.countDistinct("delivered_storeid").alias("s"), F.countDistinct("bill_date_timestamp").alias("d")).collect()}
    got = quality.multi_store_orders(hot).first()
    assert (got[0], got[1]) == (sum(r.n for r in orders.values() if r.s > 1), sum(r.s > 1 for r in orders.values()))
    assert quality.multi_date_orders(hot).count() == sum(r.n for r in orders.values() if r.d > 1)
    plan = quality.multi_store_orders(hot)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # one aggregate per order


def test_multi_store_lines_is_split(hot):
    plan, n = ran(reconcile.multi_store_lines(hot))
    assert "SortMergeJoin(skew=true)" in plan
    assert n == hot.select(*reconcile.ORDER_COLS).join(reconcile.orders_with_spread(hot, "delivered_storeid"), "order_id", "left_semi").distinct().count()


def test_insert_and_set_difference_are_split(spark, hot):
    payments = hot.select("order_id").distinct().withColumn("payment_type", F.lit("voucher")).withColumn("payment_value", F.lit(1).cast("decimal(12,2)"))
    products = spark.range(700).selectExpr("id product_id", "'c' category")
    customers = spark.range(500).selectExpr("id custid", "'x' customer_city", "'s' customer_state", "'F' gender")
    reviews = payments.selectExpr("order_id", "4 customer_satisfaction_score")
    stores = spark.range(1, 4).selectExpr("id storeid", "'a' seller_city", "'b' seller_state", "'r' region")
    multi = scratch("multi", reconcile.multi_store_lines(hot))
    made = reconcile.multi_store_insert(multi, products, payments, customers, reviews, stores)
    plan, n = ran(made)
    assert plan.count("SortMergeJoin(skew=true)") >= 2 and n == multi.count()  # payments and reviews, by order
    made = scratch("insert", made)
    plan, n = ran(reconcile.finalised_records(made, made, hot))
    assert "SortMergeJoin(skew=true)" in plan and n == 0


def test_cumulative_lines_is_split(hot):
    """The hot key group (order 7's lines have one value of each key here) is met by written tables only."""
    same = hot.withColumn("bill_date_timestamp", F.lit("2022-01-01").cast("timestamp_ntz"))
    for c in ("cost_per_unit", "mrp"):
        same = same.withColumn(c, F.when(F.col("order_id") == 7, F.lit(1)).otherwise(F.col(c)).cast("decimal(12,2)"))
    same, kept = scratch("same", same.withColumn("delivered_storeid", F.lit(1).cast("long"))), {}

    def keep(name, df):
        if name == "lines_of_varied_keys":
            kept["rows"], kept["plan"] = spread(df)
        return scratch(name, df)

    plan, n = ran(quality.cumulative_lines(same, keep=keep))
    assert "SortMergeJoin(skew=true)" in kept["plan"] and "SortMergeJoin(skew=true)" in plan
    assert n >= LINES // 6 and kept["rows"][-1] <= 2 * statistics.median(kept["rows"]), kept["rows"]


def test_paid_lines_is_split(hot):
    payments = hot.select("order_id").distinct().withColumn("payment_type", F.lit("voucher"))
    rows, plan = spread(marts.paid_lines(hot, payments))
    assert "SortMergeJoin(skew=true)" in plan and rows[-1] < LINES / 3 / 4
