"""Source readers: any DataFrameReader format, original column names mapped case-insensitively."""

import pytest

from conftest import rows
from fixtures import tables
from tillroll.sources.tables import CANONICAL, canonicalise, jdbc_partitions, jdbc_ranges, read_retail_tables

# Column names as the original tables spell them (mixed case, 'StoreID', 'Custid', …).
ORIGINAL = {
    "orders": ["Customer_id", "Order_id", "product_id", "Channel", "Delivered_StoreID", "Bill_date_timestamp",
               "Quantity", "Cost_Per_Unit", "MRP", "Discount", "Total_Amount"],
    "payments": ["order_id", "payment_type", "payment_value"],
    "reviews": ["ORDER_id", "Customer_Satisfaction_Score"],
    "products": ["product_id", "Category", "product_name_lenght", "product_description_lenght", "product_photos_qty",
                 "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"],
    "stores": ["StoreID", "seller_city", "seller_state", "Region"],
    "customers": ["Custid", "customer_city", "customer_state", "Gender"],
}


def test_read_csv_with_original_names(spark, tmp_path):
    t = tables(spark)
    paths = {}
    for name, df in t.as_dict().items():
        path = str(tmp_path / name)
        df.toDF(*ORIGINAL[name]).write.option("header", True).csv(path)
        paths[name] = path
    back = read_retail_tables(spark, paths, fmt="csv", options={"header": "true", "inferSchema": "true"})
    for name, df in back.as_dict().items():
        assert df.columns == CANONICAL[name]
        assert df.count() == t.as_dict()[name].count()
    assert rows(back.stores) == rows(t.stores)


def test_rename_map(spark, tmp_path):
    t = tables(spark)
    path = str(tmp_path / "cust")
    t.customers.toDF("cust_no", "city", "state", "sex").write.parquet(path)
    got = canonicalise(spark.read.parquet(path), "customers",
                       {"CUST_NO": "custid", "city": "customer_city", "state": "customer_state", "sex": "gender"})
    assert got.columns == CANONICAL["customers"] and rows(got) == rows(t.customers)


def test_untyped_csv_gives_the_same_tables_and_fact(spark, tmp_path):
    from tillroll.plans.batch import CleaningBatch
    t = tables(spark)
    paths = {}
    for name, df in t.as_dict().items():
        paths[name] = str(tmp_path / name)
        df.write.option("header", True).csv(paths[name])
    back = read_retail_tables(spark, paths, fmt="csv", options={"header": "true"})
    assert dict(back.orders.dtypes)["total_amount"] == "decimal(18,8)" and dict(back.orders.dtypes)["quantity"] == "int"
    typed, untyped = CleaningBatch(spark, t, "typed"), CleaningBatch(spark, back, "untyped")
    for mart in ("clean_fact", "customer_360"):
        want, got = getattr(typed, mart)(), getattr(untyped, mart)()
        # keys stay as they are read: strings from an untyped CSV
        as_text = [f"cast({c} as string) {c}" for c in want.columns]
        assert rows(got.selectExpr(*as_text)) == rows(want.selectExpr(*as_text)) != []


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("value", ["many", "1.5"])
def test_a_value_that_does_not_convert_fails(spark, ansi, value):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        bad = canonicalise(spark.createDataFrame([("1", value)], "order_id string, customer_satisfaction_score string"), "reviews")
        with pytest.raises(Exception, match="is no int"):
            bad.collect()
        fine = canonicalise(spark.createDataFrame([("1", "4.0"), ("2", None)], "order_id string, customer_satisfaction_score string"), "reviews")
        assert rows(fine) == [("1", 4), ("2", None)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


class Reader:
    """Stands in for a DataFrameReader on a database, which no test may start: keeps the options of each load and
    answers from frames. Options are checked by Spark's own rule (all four partitioning options or none)."""

    def __init__(self, frames, loads, opts=None):
        self.frames, self.loads, self.opts = frames, loads, opts or {}

    @property
    def read(self):
        return Reader(self.frames, self.loads)

    def format(self, fmt):
        assert fmt == "jdbc"
        return self

    def options(self, **kw):
        return Reader(self.frames, self.loads, {**self.opts, **kw})

    def option(self, k, v):
        return self.options(**{k: v})

    def load(self):
        self.loads.append(self.opts)
        parts = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"} & set(self.opts)
        assert len(parts) in (0, 4)
        if "query" in self.opts:
            column, table = self.opts["query"].split("min(")[1].split(")")[0], self.opts["query"].split(" from ")[1].split()[0]
            return self.frames[table].selectExpr(f"min({column})", f"max({column})", "count(*)")
        return self.frames[self.opts["dbtable"]]


def test_database_tables_are_read_in_parts(spark):
    t, loads = tables(spark), []
    paths = {name: f"dbo.{name}" for name in CANONICAL}
    db = Reader({f"dbo.{name}": df for name, df in t.as_dict().items()}, loads)
    base = {"url": "jdbc:sqlserver://host", "driver": "d"}
    cuts = jdbc_ranges(db, paths, base, rows_per_partition=2, max_partitions=4)
    assert all("query" in o and o["url"] == base["url"] for o in loads) and len(loads) == 6
    loads.clear()
    back = read_retail_tables(db, paths, "jdbc", base, table_options=cuts)
    by_table = {o["dbtable"]: o for o in loads}
    n = t.orders.count()
    lo, hi = t.orders.selectExpr("min(order_id)", "max(order_id)").first()
    got = by_table["dbo.orders"]
    assert (got["partitionColumn"], got["lowerBound"], got["upperBound"], got["numPartitions"]) == ("order_id", str(lo), str(hi), str(min(4, -(-n // 2))))
    assert by_table["dbo.customers"]["partitionColumn"] == "custid" and all(o["fetchsize"] == "10000" for o in loads)
    assert rows(back.orders) == rows(t.orders)
    with pytest.raises(ValueError):
        read_retail_tables(db, paths, "jdbc", base, table_options={"order": {}})


def test_database_table_without_rows_or_cuts():
    assert jdbc_partitions("order_id", None, None, 8) == {"fetchsize": "10000"}
    assert jdbc_partitions("order_id", 1, 9, 1) == {"fetchsize": "10000"}
    assert jdbc_partitions("bill_date_timestamp", "2021-01-01", "2023-01-01", 12, 5)["numPartitions"] == "12"
    with pytest.raises(ValueError):
        jdbc_partitions("order_id", 1, 9, 0)
