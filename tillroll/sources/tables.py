"""The six point-of-sale source tables, as DataFrames with canonical column names.

Two ways in:

* :func:`read_retail_tables` reads real tables (parquet, csv, orc, json or jdbc through
  ``DataFrameReader``) and renames their columns to the canonical lower-case names.
* :func:`fixture_tables` derives the six tables from the driver's TPC-H-like parquet files
  (``lineitem orders part supplier customer nation region``), following FIXTURES.md §2.

Canonical schemas (keys and names keep the type they come with; the others are cast):

====================  ===========================================================================
orders                customer_id, order_id, product_id, channel, delivered_storeid,
                      bill_date_timestamp, quantity int, cost_per_unit, mrp, discount
                      decimal(12,2), total_amount decimal(18,8)
payments              order_id, payment_type, payment_value decimal(12,2)
reviews               order_id, customer_satisfaction_score int
products              product_id, category, product_name_lenght, product_description_lenght,
                      product_photos_qty, product_weight_g, product_length_cm,
                      product_height_cm, product_width_cm (int, nullable)
stores                storeid, seller_city, seller_state, region (may hold duplicate rows)
customers             custid, customer_city, customer_state, gender
====================  ===========================================================================
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER_COLS = [
    "customer_id", "order_id", "product_id", "channel", "delivered_storeid",
    "bill_date_timestamp", "quantity", "cost_per_unit", "mrp", "discount", "total_amount",
]
PRODUCT_ATTRS = [
    "product_name_lenght", "product_description_lenght", "product_photos_qty",
    "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
]
PAYMENT_COLS = ["order_id", "payment_type", "payment_value"]
REVIEW_COLS = ["order_id", "customer_satisfaction_score"]
PRODUCT_COLS = ["product_id", "category", *PRODUCT_ATTRS]
STORE_COLS = ["storeid", "seller_city", "seller_state", "region"]
CUSTOMER_COLS = ["custid", "customer_city", "customer_state", "gender"]

CANONICAL = {
    "orders": ORDER_COLS,
    "payments": PAYMENT_COLS,
    "reviews": REVIEW_COLS,
    "products": PRODUCT_COLS,
    "stores": STORE_COLS,
    "customers": CUSTOMER_COLS,
}

#: Types of the columns that are computed on; money is decimal, so sums and equality are exact.
TYPES = {
    "bill_date_timestamp": "timestamp_ntz", "quantity": "int", "cost_per_unit": "decimal(12,2)", "mrp": "decimal(12,2)",
    "discount": "decimal(12,2)", "total_amount": "decimal(18,8)", "payment_value": "decimal(12,2)",
    "customer_satisfaction_score": "int", **{c: "int" for c in PRODUCT_ATTRS},
}
DATE_TYPES = ("date", "timestamp", "timestamp_ntz")


@dataclass(frozen=True)
class RetailTables:
    orders: DataFrame
    payments: DataFrame
    reviews: DataFrame
    products: DataFrame
    stores: DataFrame
    customers: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def replace(self, **kw: DataFrame) -> "RetailTables":
        return RetailTables(**{**self.as_dict(), **kw})


def _typed(name: str, source: str) -> Column:
    """``name`` cast to its type; a value that does not convert fails the query, whatever the session's
    ANSI setting (a whole number may be written with a fraction of zeros)."""
    c, target = F.col(name), TYPES.get(name, source)
    if source == target or (target == "timestamp_ntz" and source in DATE_TYPES):
        return c
    if target == "int":
        exact = c.try_cast("decimal(38,6)")
        value = F.when(exact == F.floor(exact), exact.try_cast("int"))
    else:
        value = c.try_cast(target)
    message = F.concat(F.lit(f"{name} is no {target}: "), c.cast("string"))
    return F.when(c.isNotNull() & value.isNull(), F.raise_error(message)).otherwise(value).alias(name)


def canonicalise(df: DataFrame, table: str, rename: dict[str, str] | None = None) -> DataFrame:
    """Lower-case the column names, apply ``rename`` and keep the canonical columns in order,
    cast to the canonical types."""
    rename = {k.lower(): v for k, v in (rename or {}).items()}
    df = df.toDF(*[rename.get(c.lower(), c.lower()) for c in df.columns])
    types = dict(df.dtypes)
    return df.select(*[_typed(c, types[c]) for c in CANONICAL[table]])


def read_retail_tables(
    spark: SparkSession,
    paths: dict[str, str],
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
    renames: dict[str, dict[str, str]] | None = None,
    table_options: dict[str, dict[str, str]] | None = None,
) -> RetailTables:
    """Read the six tables with any ``DataFrameReader`` format.

    ``paths`` maps each canonical table name to a path (or, for ``fmt='jdbc'``, a table name
    passed as ``dbtable``). ``renames`` maps a table to ``{source column: canonical column}``,
    e.g. ``{"orders": {"Customer_id": "customer_id"}}``; matching is case-insensitive, as in
    the reference's SQL Server collation. ``options`` hold for all tables, ``table_options`` for one: a
    database table is read by many tasks with those of :func:`jdbc_partitions` or :func:`jdbc_ranges`.
    """
    renames, table_options = renames or {}, table_options or {}
    unknown = [t for t in table_options if t not in CANONICAL]
    if unknown:
        raise ValueError(f"options for unknown tables: {', '.join(unknown)}")
    out = {}
    for name in CANONICAL:
        reader = spark.read.format(fmt).options(**{**(options or {}), **table_options.get(name, {})})
        df = reader.option("dbtable", paths[name]).load() if fmt == "jdbc" else reader.load(paths[name])
        out[name] = canonicalise(df, name, renames.get(name))
    return RetailTables(**out)


#: Column by which each database table is read in parts, where it has one of its own.
PARTITION_COLUMNS = {"orders": "order_id", "payments": "order_id", "reviews": "order_id", "products": "product_id", "customers": "custid", "stores": "storeid"}


def jdbc_partitions(column: str, lower, upper, partitions: int, fetchsize: int = 10_000) -> dict[str, str]:
    """Reader options that read a database table in ``partitions`` parts by ranges of ``column`` (a number, date or
    timestamp). The bounds only place the cuts: rows outside them, or without a value, are in the first or last part."""
    if partitions < 1:
        raise ValueError("at least one partition")
    if lower is None or upper is None or partitions == 1:  # an empty table, or nothing to cut
        return {"fetchsize": str(fetchsize)}
    return {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions), "fetchsize": str(fetchsize)}


def jdbc_ranges(spark: SparkSession, paths: dict[str, str], options: dict[str, str], rows_per_partition: int = 1_000_000, max_partitions: int = 1_000,
                columns: dict[str, str] | None = None) -> dict[str, dict[str, str]]:
    """``table_options`` for a database: the least and largest value of each table's column and its number of rows, asked
    of the database by one aggregate a table (one row back), cut into parts of about ``rows_per_partition`` rows.
    ``max_partitions`` bounds the connections that the database sees at once."""
    out = {}
    for name, column in {**PARTITION_COLUMNS, **(columns or {})}.items():
        query = f"select min({column}) as lo, max({column}) as hi, count(*) as n from {paths[name]} t"
        low, high, n = spark.read.format("jdbc").options(**options).option("query", query).load().first()
        out[name] = jdbc_partitions(column, low, high, max(1, min(max_partitions, -(-int(n) // rows_per_partition))))
    return out


# --------------------------------------------------------------------------------------------
# Fixture mapping from the driver's TPC-H-like tables (FIXTURES.md §2).
# Money goes through integer cents and floor() so that every engine agrees to the cent.
# --------------------------------------------------------------------------------------------

def _tpch(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _money(cents_expr: Column, precision: int = 12, scale: int = 2) -> Column:
    return (cents_expr / F.lit(100)).cast(f"decimal({precision},{scale})")


def fixture_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    # small numbers before the join, which shuffles them
    li = _tpch(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("int").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("ext_c"),
        F.round(F.col("l_discount") * 100).cast("int").alias("pct"),
        F.when(F.col("l_orderkey") % 50 == 1, F.col("l_shipdate")).alias("l_shipdate"))
    od = _tpch(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    lines = (
        li.join(od, li.l_orderkey == od.o_orderkey)
        # Lowest supplier of each order: the store that normally delivers the whole order. The join has the order's lines together.
        .withColumn("s0", F.min("l_suppkey").over(Window.partitionBy("l_orderkey")))
        .withColumn(
            "disc_c",
            F.when(F.col("o_custkey") % 3 == 0, F.lit(0).cast("bigint"))
            .otherwise(F.floor((F.col("ext_c") * F.col("pct")).cast("double") / 100)),
        )
    )
    unit_c = F.col("ext_c").cast("double") / F.col("qty")
    base = lines.select(
        F.col("o_custkey").alias("customer_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Online")
        .when(F.col("o_orderpriority") == "5-LOW", "Phone Delivery")
        .otherwise("Instore").alias("channel"),
        F.when(F.col("l_orderkey") % 10 == 0, F.col("l_suppkey")).otherwise(F.col("s0")).alias("delivered_storeid"),
        F.when(F.col("l_orderkey") % 50 == 1, F.col("l_shipdate")).otherwise(F.col("o_orderdate"))
        .alias("bill_date_timestamp"),
        F.col("qty").alias("quantity"),
        _money(F.floor(unit_c * 0.6)).alias("cost_per_unit"),
        _money(F.floor(unit_c)).alias("mrp"),
        _money(F.col("disc_c")).alias("discount"),
        _money(F.col("ext_c") - F.col("disc_c"), 18, 8).alias("total_amount"),
    )
    # Cumulative lines: one order in a hundred repeats a line with one more unit.
    cumulative = base.where(F.col("order_id") % 100 == 8).select(
        *[c for c in ORDER_COLS if c not in ("quantity", "total_amount")],
        (F.col("quantity") + 1).alias("quantity"),
        (F.col("total_amount") + F.col("mrp")).cast("decimal(18,8)").alias("total_amount"),
    )
    return base.unionByName(cumulative).select(*ORDER_COLS)


def fixture_payments(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    od = _tpch(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    per_order = orders.groupBy("order_id").agg(
        F.sum("total_amount").alias("sm"), F.max("total_amount").alias("mx"))
    k = F.col("o_orderkey")
    target = (
        od.join(per_order, od.o_orderkey == per_order.order_id, "left")
        .select(
            k.alias("order_id"),
            F.when(k % 10 == 8, F.col("mx"))
            .when(k % 10 == 9, F.col("sm") + 100)
            .otherwise(F.coalesce(F.col("sm"), F.col("o_totalprice").cast("decimal(12,2)")))
            .cast("decimal(12,2)").alias("amt"),
        )
        .where(F.col("amt").isNotNull())
    )
    split = F.col("order_id") % 5 == 0
    voucher_part = F.floor(F.col("amt").cast("double") * 30) / 100
    voucher_part = voucher_part.cast("decimal(12,2)")
    ptype = (
        F.when(F.col("order_id") % 4 == 0, "credit_card")
        .when(F.col("order_id") % 4 == 1, "debit_card")
        .when(F.col("order_id") % 4 == 2, "voucher")
        .otherwise("UPI/Cash")
    )
    first = target.select(
        "order_id",
        ptype.alias("payment_type"),
        F.when(split, F.col("amt") - voucher_part).otherwise(F.col("amt")).cast("decimal(12,2)").alias("payment_value"),
    )
    second = target.where(split).select(
        "order_id", F.lit("voucher").alias("payment_type"), voucher_part.alias("payment_value"))
    return first.unionByName(second)


def fixture_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    od = _tpch(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    first = od.select("order_id", (1 + F.col("order_id") % 5).cast("int").alias("customer_satisfaction_score"))
    second = od.where(F.col("order_id") % 20 == 0).select(
        "order_id", (5 - F.col("order_id") % 5).cast("int").alias("customer_satisfaction_score"))
    return first.unionByName(second)


def fixture_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tpch(spark, sf_dir, "part")
    k = F.col("p_partkey")
    size = F.col("p_size").cast("int")
    return p.select(
        k.alias("product_id"),
        F.when(k % 50 == 0, "#N/A").otherwise(F.col("p_brand")).alias("category"),
        F.when(k % 40 == 1, F.lit(None).cast("int")).otherwise(F.length("p_name")).alias("product_name_lenght"),
        *[size.alias(c) for c in PRODUCT_ATTRS[1:]],
    )


def fixture_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _tpch(spark, sf_dir, "supplier")
    n = _tpch(spark, sf_dir, "nation")
    r = _tpch(spark, sf_dir, "region")
    base = (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("s_suppkey").alias("storeid"),
            F.concat(F.lit("CITY_"), (F.col("s_suppkey") % 15).cast("string")).alias("seller_city"),
            F.col("n_name").alias("seller_state"),
            F.col("r_name").alias("region"),
        )
    )
    return base.unionByName(base.where(F.col("storeid") % 25 == 0))


def fixture_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _tpch(spark, sf_dir, "customer")
    n = _tpch(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("custid"),
        F.concat(F.lit("CITY_"), (F.col("c_custkey") % 20).cast("string")).alias("customer_city"),
        F.col("n_name").alias("customer_state"),
        F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("gender"),
    )


def fixture_tables(spark: SparkSession, sf_dir: str, stage=None) -> RetailTables:
    """The six source tables derived from the driver's parquet files.

    ``stage(name, df) -> df``, when given, materialises each table as it is derived; payments
    are derived from the staged orders, so the order lines are computed once.
    """
    keep = stage or (lambda name, df: df)
    orders = keep("orders", fixture_orders(spark, sf_dir))
    return RetailTables(
        orders=orders,
        payments=keep("payments", fixture_payments(spark, sf_dir, orders)),
        reviews=keep("reviews", fixture_reviews(spark, sf_dir)),
        products=keep("products", fixture_products(spark, sf_dir)),
        stores=keep("stores", fixture_stores(spark, sf_dir)),
        customers=keep("customers", fixture_customers(spark, sf_dir)),
    )
