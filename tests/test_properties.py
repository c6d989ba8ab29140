
import os

import pytest
from pyspark.sql import functions as F

from tillroll.operators import marts, quality, reconcile
from tillroll.plans import analysis as A
from tillroll.plans import segments as S
from tillroll.plans.batch import batch_for

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def p(spark):
    return batch_for(spark, SF)


def test_matched_plus_not_matching_is_all_payment_totals(p):
    # each order has one customer in the fixture, so every payment total is one or the other
    assert p.matched_orders().count() + p.orders_not_matching().count() == p.order_payment_totals().count()


def test_fact_has_no_duplicates_and_repairs_are_idempotent(p):
    f8 = p.clean_fact()
    assert quality.exact_duplicates(p.finalised_records()).count() == 0
    assert reconcile.clean_fact(f8).subtract(f8).count() == 0
    assert quality.orders_with_spread(f8, "delivered_storeid").count() == 0
    assert quality.orders_with_spread(f8, "bill_date_timestamp").count() == 0


def test_channel_percents_sum_to_100(p):
    r = A.channel_contribution(p.clean_fact()).agg(F.sum("quantity_percentage"), F.sum("revenue_percentage")).first()
    assert r[0] == pytest.approx(100.0) and r[1] == pytest.approx(100.0)


@pytest.mark.parametrize("seg, measure", [(S.revenue_segments, "total_revenue"), (S.profit_segments, "profit")])
def test_percentile_segments_partition_customers(p, seg, measure):
    c360 = p.customer_360()
    out = seg(c360).collect()
    assert sum(r[1] for r in out) == c360.count()
    assert sum(r[2] for r in out) == c360.agg(F.sum(measure)).first()[0]


def test_rfm_segments_partition_customers(p):
    f8 = p.clean_fact()
    out = S.rfm_segments(p.rfm_base()).collect()
    assert sum(r.customer_count for r in out) == f8.select("customer_id").distinct().count()
    assert sum(r.total_revenue for r in out) == f8.agg(F.sum("total_amount")).first()[0]
    scores = S.rfm_scores(p.rfm_base())
    for c in ("recency_score", "frequency_score", "monetary_score"):
        sizes = sorted(r[1] for r in scores.groupBy(c).count().collect())
        assert sizes[-1] - sizes[0] <= 1  # NTILE(4): quartiles differ by at most one row


def test_cohorts_cover_all_customers(p):
    c360 = p.customer_360()
    n = c360.count()
    disc = A.cohort_count(c360, A.discount_seekers(), "n").first()[0]
    nodisc = A.cohort_count(c360, A.non_discount_seekers(), "n").first()[0]
    assert disc + nodisc == n  # discounts are never negative
    once = A.cohort_count(c360, A.one_time_buyers(), "n").first()[0]
    repeat = A.cohort_count(c360, A.repeat_buyers(), "n").first()[0]
    assert once + repeat == n


def test_segment_plans_have_no_single_partition_window(p):
    for df in (S.revenue_segments(p.customer_360()), S.rfm_segments(p.rfm_base())):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Join" not in plan  # the borders are literals


def test_after_d3_projection_equals_the_repair(p):
    by_operator = reconcile.fix_store_to_min(p.finalised_records())
    projected = p.store_fixed()
    assert projected.count() == by_operator.count()
    assert projected.subtract(by_operator).count() == 0 and by_operator.subtract(projected).count() == 0


def test_marts_read_the_payments_the_fact_carries(p):
    df = marts.customer_360(p.t.customers, p.fact_with_payments(), None)
    assert "payment_type" not in df._jdf.queryExecution().optimizedPlan().toString().replace("different_payment_types", "")
    joined = marts.customer_360(p.t.customers, p.clean_fact(), p.t.payments)
    assert df.subtract(joined).count() == 0 and joined.subtract(df).count() == 0
    with pytest.raises(ValueError):
        marts.customer_360(p.t.customers, p.clean_fact(), None)
    # payments that are given count, whatever the fact carries
    none = marts.customer_360(p.t.customers, p.fact_with_payments(), p.t.payments.where("order_id is null"))
    assert none.count() == 0


def test_options_have_stages_of_their_own(p):
    approx, fresh, clean = p.variant(approx=True), p.variant(refresh_store_attrs=True), p.variant(clean_categories=True)
    assert approx.customer_360().count() == p.customer_360().count()
    assert approx.customer_360().inputFiles() != p.customer_360().inputFiles()
    assert approx.clean_fact().inputFiles() == p.clean_fact().inputFiles()
    attrs = ["delivered_storeid", "seller_city", "seller_state", "region"]
    stores = p.t.stores.withColumnRenamed("storeid", "delivered_storeid")
    assert fresh.clean_fact().select(*attrs).subtract(stores.select(*attrs)).count() == 0
    assert p.clean_fact().select(*attrs).subtract(stores.select(*attrs)).count() > 0
    assert clean.clean_fact().where("category = '#N/A'").count() == 0 < p.clean_fact().where("category = '#N/A'").count()
