"""Small hand-written source tables covering the traps of the cleaning batch."""

from datetime import datetime
from decimal import Decimal as D

ORDERS_SCHEMA = ("customer_id long, order_id long, product_id long, channel string, delivered_storeid long, "
                 "bill_date_timestamp timestamp_ntz, quantity int, cost_per_unit decimal(12,2), mrp decimal(12,2), "
                 "discount decimal(12,2), total_amount decimal(18,8)")
PAYMENTS_SCHEMA = "order_id long, payment_type string, payment_value decimal(12,2)"
REVIEWS_SCHEMA = "order_id long, customer_satisfaction_score int"
PRODUCTS_SCHEMA = ("product_id long, category string, product_name_lenght int, product_description_lenght int, "
                   "product_photos_qty int, product_weight_g int, product_length_cm int, product_height_cm int, "
                   "product_width_cm int")
STORES_SCHEMA = "storeid long, seller_city string, seller_state string, region string"
CUSTOMERS_SCHEMA = "custid long, customer_city string, customer_state string, gender string"


def t(day, hour=0):
    return datetime(2022, 1, day, hour)


def line(c, o, p, store, day, qty, cost, mrp, disc, amt, channel="Instore", hour=0):
    return (c, o, p, channel, store, t(day, hour), qty, D(cost), D(mrp), D(disc), D(amt))


ORDERS = [
    # order 1: matched, two lines, one store
    line(1, 1, 10, 100, 1, 1, "5.00", "10.00", "0.00", "10.00"),
    line(1, 1, 11, 100, 1, 2, "2.00", "4.00", "0.50", "7.50"),
    # order 2: payment does not match the total but one line matches (corrected); two lines of
    # equal amount, so the reference duplicates them
    line(2, 2, 10, 100, 2, 1, "5.00", "10.00", "0.00", "10.00"),
    line(2, 2, 12, 100, 2, 1, "5.00", "10.00", "0.00", "10.00"),
    line(2, 2, 11, 100, 2, 1, "2.00", "4.00", "0.00", "3.00"),
    # order 3: split over two stores and two dates, paid in two parts, matched
    line(3, 3, 10, 100, 3, 2, "5.00", "10.00", "1.00", "19.00"),
    line(3, 3, 11, 200, 5, 3, "2.00", "4.00", "0.00", "12.00", hour=8),
    # order 4: payment matches nothing
    line(4, 4, 12, 200, 6, 1, "5.00", "10.00", "0.00", "10.00"),
    # order 5: weekend (2022-01-08 is a Saturday), null store on one line
    line(5, 5, 13, 300, 8, 4, "1.00", "2.50", "0.00", "10.00", channel="Online"),
    line(5, 5, 10, None, 8, 1, "5.00", "10.00", "0.00", "10.00", channel="Online"),
    # order 6: cumulative line (same keys, more quantity)
    line(6, 6, 10, 100, 9, 1, "5.00", "10.00", "0.00", "10.00"),
    line(6, 6, 10, 100, 9, 2, "5.00", "10.00", "0.00", "20.00"),
]
PAYMENTS = [
    (1, "credit_card", D("17.50")),
    (2, "UPI/Cash", D("10.00")),
    (3, "voucher", D("10.00")), (3, "debit_card", D("21.00")),
    (4, "credit_card", D("99.00")),
    (5, "upi/cash", D("20.00")),
    (6, "credit_card", D("30.00")),
    (7, "voucher", D("5.00")),  # payment without order lines
]
REVIEWS = [(1, 5), (2, 4), (2, 3), (3, 2), (4, 1), (5, 5), (6, 3), (6, 3)]
PRODUCTS = [
    (10, "toys", 10, 10, 1, 100, 1, 1, 1),
    (11, "#N/A", 10, 10, 1, 100, 1, 1, 1),
    (12, "food", None, 10, 1, 100, 1, 1, 1),
    (13, "food", 10, 10, 1, 100, 1, None, 1),
]
STORES = [
    (100, "A-city", "A-state", "North"),
    (200, "B-city", "B-state", "South"),
    (200, "B-city", "B-state", "South"),  # duplicate row
    (300, "C-city", "C-state", "North"),
]
CUSTOMERS = [(i, f"city{i}", "S1" if i % 2 else "S2", "F" if i % 2 else "M") for i in range(1, 7)]


def tables(spark):
    from tillroll.sources.tables import RetailTables
    return RetailTables(
        orders=spark.createDataFrame(ORDERS, ORDERS_SCHEMA),
        payments=spark.createDataFrame(PAYMENTS, PAYMENTS_SCHEMA),
        reviews=spark.createDataFrame(REVIEWS, REVIEWS_SCHEMA),
        products=spark.createDataFrame(PRODUCTS, PRODUCTS_SCHEMA),
        stores=spark.createDataFrame(STORES, STORES_SCHEMA),
        customers=spark.createDataFrame(CUSTOMERS, CUSTOMERS_SCHEMA),
    )


def register(spark, t):
    """The six tables as temp views under the reference's names, for brute-force SQL."""
    for name, df in {"orders_v": t.orders, "orderpayments": t.payments, "orderreview_ratings": t.reviews,
                     "productsinfo": t.products, "storesinfo": t.stores, "customers_v": t.customers}.items():
        df.createOrReplaceTempView(name)
