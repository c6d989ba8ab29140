"""Breakdowns, shares, top-k and dashboard views on a tiny hand-made fact with hand-computed answers."""

from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tillroll.plans import analysis as A
from tillroll.plans import dashboard as R

FACT_SCHEMA = ("customer_id long, order_id long, product_id long, channel string, delivered_storeid long, "
               "bill_date_timestamp timestamp_ntz, quantity int, mrp decimal(12,2), total_amount decimal(18,8), "
               "category string, seller_state string, region string, gender string")


@pytest.fixture(scope="module")
def fact(spark):
    def r(c, o, p, ch, s, month, q, mrp, amt, cat, region, g):
        return (c, o, p, ch, s, datetime(2022, month, 1), q, D(mrp), D(amt), cat, f"{region}-state", region, g)
    data = [
        r(1, 1, 10, "Online", 100, 1, 1, "50.00", "60.00", "toys", "North", "F"),
        r(1, 1, 11, "Online", 100, 1, 2, "10.00", "20.00", "food", "North", "F"),
        r(2, 2, 12, "Instore", 200, 2, 3, "90.00", "30.00", "food", "South", "M"),
        r(3, 3, 10, "Instore", 200, 2, 1, "50.00", "40.00", "toys", "South", "M"),
        r(3, 4, 13, "Instore", 300, 3, 4, "90.00", "50.00", "food", "South", "M"),
    ]
    return spark.createDataFrame(data, FACT_SCHEMA)


def test_channel_contribution(fact):
    got = {r.channel: r for r in A.channel_contribution(fact).collect()}
    assert got["Online"].total_quantity == 3 and got["Instore"].total_quantity == 8
    assert got["Online"].revenue_percentage == pytest.approx(80 * 100 / 200)
    assert got["Instore"].quantity_percentage == pytest.approx(8 * 100 / 11)


def test_top_stores_and_shares(fact):
    # store revenue: 100 → 80, 200 → 70, 300 → 50; lines: 2, 2, 1
    assert [tuple(r) for r in A.top_stores_by_revenue(fact, 2).collect()] == [(100, D("80.00000000")), (200, D("70.00000000"))]
    share = A.top_stores_revenue_share(fact, 2).first()
    assert share.top10_total_revenue == D("150.00000000") and share.top10_contribution_percentage == 75.0
    aov = [(r.delivered_storeid, r.average_order_value) for r in A.top_stores_by_aov(fact, 3).collect()]
    assert aov == [(300, 50.0), (100, 40.0), (200, 35.0)]


def test_top_categories_per_group_breaks_ties_by_name(fact):
    got = [(r.region, r.category, r.order_count, r.rn) for r in A.top_categories_by(fact, "region", 1).collect()]
    # North: food 1, toys 1 (tie → 'food' first); South: food 2
    assert sorted(got) == [("North", "food", 1, 1), ("South", "food", 2, 1)]


def test_top_mrp_rows_and_revenue_share(fact):
    top = [tuple(r) for r in A.top_mrp_products(fact, 2).collect()]
    assert top == [(12, D("90.00")), (13, D("90.00"))]
    r = A.top_mrp_revenue_share(fact, 2).first()
    assert r.total_revenue_from_top_10 == D("80.00000000") and r.contribution_percentage == pytest.approx(40.0)


def test_gender_shares_round_to_two_places(fact):
    got = {r.gender: r.percentage for r in A.gender_customer_share(fact).collect()}
    assert got == {"F": 33.33, "M": 66.67}


def test_rollup_levels(fact):
    out = R.revenue_drilldown(fact).collect()
    total = [r for r in out if r.level == 7]
    assert len(total) == 1 and total[0].revenue == D("200.00000000") and total[0].orders == 4
    assert sorted((r.region, r.revenue) for r in out if r.level == 3) == [("North", D("80.00000000")),
                                                                        ("South", D("120.00000000"))]


def test_monthly_growth_and_lead_ratio(fact):
    months = [(r.month, r.revenue, r.prev_revenue, r.mom_growth_pct, r.peak_rank)
              for r in R.monthly_growth(fact).collect()]
    assert months[0][:3] == (1, D("80.00000000"), None)
    # revenue by month: 80, 70, 50 → February is 12.5% down and second by revenue
    assert months[1][3] == pytest.approx(-12.5) and [m[4] for m in months] == [1, 2, 3]
    lead = [(r.store_rank, r.delivered_storeid, r.lead_ratio) for r in R.store_lead_ratio(fact, 3).collect()]
    assert lead[0] == (1, 100, pytest.approx(80 / 70)) and lead[-1][2] is None


def test_avg_revenue_by_month_is_mean_line_amount(fact):
    got = {r.month_number: r.avg_monthly_revenue for r in A.avg_revenue_by_month(fact).collect()}
    assert got == {1: 40.0, 2: 35.0, 3: 50.0}


def test_cohorts(spark):
    c360 = spark.createDataFrame(
        [(1, "S1", D("0.00"), 1, D("10")), (2, "S1", D("5.00"), 3, D("30")), (3, "S2", D("1.00"), 1, D("60"))],
        "customer_id long, customer_state string, total_discount_taken decimal(12,2), "
        "total_distinct_transactions long, total_revenue decimal(18,8)")
    assert A.cohort_count(c360, A.discount_seekers(), "n").first().n == 2
    r = A.cohort_revenue_share(c360, A.repeat_buyers(), ("n", "rev", "pct")).first()
    assert (r.n, r.rev, r.pct) == (1, D("30.00000000"), pytest.approx(30.0))
    by_state = {x.customer_state: x.n for x in A.cohort_by_state(c360, A.one_time_buyers(), "n").collect()}
    assert by_state == {"S1": 1, "S2": 1}


def test_order_and_customer_kpis(spark):
    from tillroll.plans import kpis as K
    o360 = spark.createDataFrame(
        [(1, "Online", 3, D("100.00"), D("10.00"), 10.0, D("40.00"), 1),
         (2, "Instore", 1, D("50.00"), D("0.00"), 0.0, D("20.00"), 2),
         (3, "Instore", 2, D("50.00"), D("5.00"), 10.0, D("10.00"), 1)],
        "order_id long, channel string, total_quantity_in_order long, total_order_value decimal(38,8), "
        "total_discount_on_order decimal(38,2), discount_percent double, profit decimal(38,8), "
        "distinct_categories_in_order long")
    k = K.order_kpis(o360).first()
    assert (k.total_unique_orders, k.total_quantity, k.total_channels) == (3, 6, 2)
    assert k.avg_order_value == pytest.approx(200 / 3) and k.avg_items_per_order == 2.0
    assert k.pct_single_category_orders == pytest.approx(200 / 3) and k.pct_multi_category_orders == pytest.approx(100 / 3)
    assert k.total_cost == D("130.00000000") and k.discount_percentage == pytest.approx(7.5)
    assert k.profit_percentage == pytest.approx(35.0) and k.avg_discount_percent == pytest.approx(20 / 3)
    approx = K.order_kpis(o360, approx=True).first()
    assert approx.total_unique_orders == 3  # HyperLogLog++ is exact at this size
    c360 = spark.createDataFrame([(1, 1, 2, 3), (2, 3, 0, 1), (3, 1, 1, 0)],
                                 "customer_id long, total_distinct_transactions long, weekend_transactions long, "
                                 "weekday_transactions long")
    c = K.customer_kpis(c360.withColumn("total_revenue", F.lit(D("1.00"))).withColumn("profit", F.lit(D("0.50")))).first()
    assert c.repeat_purchase_rate == pytest.approx(100 / 3) and c.one_time_buyer_percentage == pytest.approx(200 / 3)
    assert (c.total_weekend_transactions, c.total_weekday_transactions) == (3, 4)
