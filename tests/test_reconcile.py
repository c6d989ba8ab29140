"""Cleaning batch C1–C12 on hand-made rows, each against nested loops over the collected tables."""

from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal as D
from itertools import product

import pytest

from conftest import rows
from fixtures import register, tables
from tillroll.operators import reconcile as C
from tillroll.sources.tables import ORDER_COLS

FACT = ORDER_COLS + ["category", "avg_rating", "seller_city", "seller_state", "region",
                     "customer_city", "customer_state", "gender"]


@pytest.fixture(scope="module")
def t(spark):
    tb = tables(spark)
    register(spark, tb)
    return tb


@pytest.fixture(scope="module")
def stages(spark, t):
    co = C.cust_order_totals(t.orders)
    op = C.order_payment_totals(t.payments)
    matched = C.matched_orders(co, op)
    nm = C.orders_not_matching(co, op)
    rem = C.remaining_orders(nm, t.orders)
    rec = C.reconciled_orders(t.orders, matched, rem)
    integ = C.integrated_orders(rec, t.reviews, t.products, t.stores, t.customers)
    multi = C.multi_store_lines(t.orders)
    ins = C.multi_store_insert(multi, t.products, t.payments, t.customers, t.reviews, t.stores)
    app = C.append_multi_store(integ, ins)
    add = C.multi_store_records(ins)
    fin = C.finalised_records(app, add, integ)
    return dict(co=co, op=op, matched=matched, nm=nm, rem=rem, rec=rec, integ=integ, multi=multi, ins=ins,
                app=app, add=add, fin=fin, f8=C.clean_fact(fin))


def test_totals_and_matching(spark, stages):
    assert rows(stages["matched"]) == [(1, 1, D("18")), (3, 3, D("31")), (5, 5, D("20")), (6, 6, D("30"))]
    # order 2 (10 vs 23), 4 (99 vs 10) and 7 (no lines) do not match
    assert sorted(r[0] for r in rows(stages["nm"])) == [2, 4, 7]
    # order 2 has two lines of amount 10 = payment total: two rows
    assert rows(stages["rem"]) == [(2, 2, D("10")), (2, 2, D("10"))]


def test_reconciled_repeats_single_lines(t, stages):
    orders, totals, paid = t.orders.collect(), defaultdict(D), defaultdict(D)
    for o in orders:
        totals[o.customer_id, o.order_id] += o.total_amount
    for p in t.payments.collect():
        paid[p.order_id] += p.payment_value

    def whole(x):
        return x.quantize(D(1), ROUND_HALF_UP)

    settled = {k for k, v in totals.items() if k[1] in paid and whole(paid[k[1]]) == whole(v)}
    unsettled = {o: whole(v) for o, v in paid.items() if o not in {k[1] for k in settled}}
    want = []
    for o in orders:
        key, amount = (o.customer_id, o.order_id), whole(o.total_amount)
        if key in settled:
            want.append(tuple(o))
        elif unsettled.get(o.order_id) == amount:
            want += [tuple(o)] * sum((x.customer_id, x.order_id) == key and whole(x.total_amount) == amount for x in orders)
    assert rows(stages["rec"]) == sorted(want, key=repr)
    # the two 10.00 lines of order 2 each come out twice
    assert sum(1 for r in rows(stages["rec"]) if r[1] == 2) == 4


def _multi_store(lines):
    """The different lines with a line of the same order at another store, and their unit amounts."""
    return {(a, (a.total_amount / a.quantity).quantize(D("1e-8"), ROUND_HALF_UP)) for a in lines for b in lines
            if a.order_id == b.order_id and None not in (a.delivered_storeid, b.delivered_storeid)
            and a.delivered_storeid != b.delivered_storeid}


def test_multi_store_lines(t, stages):
    want = [(*a, unit, a.quantity // a.quantity) for a, unit in _multi_store(t.orders.collect())]
    assert rows(stages["multi"]) == sorted(want, key=repr)
    assert {r[1] for r in rows(stages["multi"])} == {3}  # order 5's null store does not count


def _brute_insert(t, group_all: bool):
    """The multi-store rows by nested loops over the collected tables."""
    lines, products, payments, customers, reviews, stores = (
        df.collect() for df in (t.orders, t.products, t.payments, t.customers, t.reviews, t.stores))
    keys = [c for c in FACT if c not in ("quantity", "total_amount")]
    groups = {}
    for line, unit in _multi_store(lines):
        for p, pay, c, r, s in product(products, payments, customers, reviews, stores):
            if (p.product_id != line.product_id or pay.order_id != line.order_id or c.custid != line.customer_id
                    or r.order_id != line.order_id or s.storeid != line.delivered_storeid):
                continue
            row = {**line.asDict(), **p.asDict(), **c.asDict(), **s.asDict(), "avg_rating": float(r.customer_satisfaction_score)}
            key = tuple(row[k] for k in keys) + ((line.quantity, line.total_amount) if group_all else ())
            n, amount = groups.get(key, (0, D(0)))
            groups[key] = (n + line.quantity // line.quantity, amount + unit)
    out = []
    for key, (n, amount) in groups.items():
        row = {**dict(zip(keys, key)), "quantity": n, "total_amount": amount}
        out.append(tuple(row[c] for c in FACT))
    return sorted(out, key=repr)


def test_insert_equals_fanout_join(stages, t):
    assert rows(stages["ins"], FACT) == _brute_insert(t, True)
    assert rows(stages["add"], FACT) == _brute_insert(t, False)
    # order 3 has two payments and store 200 is listed twice: the 200 line is counted 4 times
    qty = {r[2]: r[6] for r in stages["ins"].collect()}
    assert qty == {10: 2, 11: 4}


def test_finalised_is_a_set_difference(stages):
    kept = {r.order_id for r in stages["integ"].collect()}
    right = {tuple(r) for r in stages["add"].select(*FACT).collect() if r.order_id in kept}
    got = rows(stages["fin"], FACT)
    assert got == sorted({tuple(r) for r in stages["app"].select(*FACT).collect()} - right, key=repr)


def test_clean_fact_repairs_are_idempotent(spark, stages):
    f8 = stages["f8"]
    per_order = f8.groupBy("order_id").agg({"delivered_storeid": "min", "bill_date_timestamp": "max"})
    once = rows(f8, FACT)
    assert rows(C.clean_fact(f8), FACT) == once
    spread = (f8.groupBy("order_id").agg({"delivered_storeid": "count"}))
    assert per_order.count() == spread.count()
    for o in (3,):
        stores = {r.delivered_storeid for r in f8.where(f"order_id = {o}").collect()}
        dates = {r.bill_date_timestamp for r in f8.where(f"order_id = {o}").collect()}
        assert len(stores) == 1 and len(dates) == 1


def test_store_fix_keeps_null_store(spark):
    from fixtures import line, ORDERS_SCHEMA
    df = spark.createDataFrame([line(1, 9, 1, None, 1, 1, "1", "1", "0", "1"),
                                line(1, 9, 2, 300, 1, 1, "1", "1", "0", "1"),
                                line(1, 9, 3, 200, 1, 1, "1", "1", "0", "1")], ORDERS_SCHEMA)
    got = sorted((r.product_id, r.delivered_storeid) for r in C.fix_store_to_min(df).collect())
    assert got == [(1, None), (2, 200), (3, 200)]


def test_order_lookup_pushes_filter(spark, tmp_path, t):
    path = str(tmp_path / "f")
    t.orders.write.parquet(path)
    plan = C.order_lookup(spark.read.parquet(path), 3)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(order_id), EqualTo(order_id,3)]" in plan


def test_fused_reconcile_and_enrich_equals_two_steps(spark, t, stages):
    dup_customers = t.customers.unionByName(t.customers.where("custid = 1"))
    m = C.matched_orders(stages["co"], stages["op"])
    fused = C.copies(C.reconciled_integrated(t.orders, m, stages["rem"], t.reviews, t.products, t.stores, dup_customers))
    two = C.integrated_orders(stages["rec"], t.reviews, t.products, t.stores, dup_customers)
    assert rows(fused, FACT) == rows(two, FACT)
    assert sum(1 for r in rows(fused, FACT) if r[0] == 1) == 2 * sum(1 for r in rows(stages["integ"], FACT) if r[0] == 1)


def test_copies_are_carried_as_a_number(spark, t):
    """300 equal lines that each carry the payment total stay 300 rows in C7's stage (90,000 in its
    output), and C11 has the line once."""
    from tillroll.plans.batch import CleaningBatch
    one = t.orders.where("order_id = 2 and product_id = 10")
    many = one.crossJoin(spark.range(300)).drop("id")
    p = CleaningBatch(spark, t.replace(orders=many), "copies")
    assert p.integrated_lines().count() == 300
    assert p.integrated_orders().count() == 90_000
    assert p.finalised_records().count() == 1
