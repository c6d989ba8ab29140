"""The fact merged from increments: equal to one full run, untouched files kept, versions, conflicts, months pruned."""

import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillroll.operators import quality, reconcile
from tillroll.plans import dashboard, registry
from tillroll.plans.batch import batch_for
from tillroll.plans.incremental import IncrementalFact
from tillroll.sources.stage import scratch_path
from tillroll.sources.versions import Conflict, Manifest, Versions

SF = "/root/testdata/sf0.001"


def files(inc):
    """Every file of the fact with its time of change."""
    out = {}
    for f in inc.versions.manifest().files["fact"]:
        path = re.sub("^file:/*", "/", f"{inc.versions.root}/data/fact/{f}")
        out[f] = os.stat(path).st_mtime_ns
    return out


@pytest.fixture(scope="module")
def made(spark):
    """An incremental fact after each of three increments: (increments, state by version)."""
    p = batch_for(spark, SF)
    inc, seen = IncrementalFact(spark, scratch_path(spark, "incremental")), {}
    for name, new in registry.increments(p.t):
        version = inc.apply(name, new)
        seen[version] = files(inc)
    return inc, seen


def test_increments_equal_one_run(spark, made):
    inc, seen = made
    want = batch_for(spark, SF).clean_fact()
    assert sorted(seen) == [1, 2, 3] and rows(inc.fact()) == rows(want)
    # the third increment brings lines only, and does change orders of the earlier years
    old, new = (inc.fact(v).select("order_id").distinct() for v in (2, 3))
    assert new.join(old, "order_id", "left_anti").count() > 0
    assert rows(inc.fact(2)) != rows(inc.fact(3))


def test_untouched_files_stay(spark, made):
    inc, seen = made
    kept = set(seen[2]) & set(seen[3])
    assert kept and all(seen[2][f] == seen[3][f] for f in kept)
    gone = set(seen[2]) - set(seen[3])
    touched = inc.versions.read("orders", inc.versions.manifest(3), [f for f in inc.versions.manifest(3).files["orders"] if f.startswith("v=3_")])
    touched = touched.select("order_id").distinct()
    manifest = inc.versions.manifest(2)
    for part, has in ((gone, True), (kept, False)):
        for f in part:
            assert (inc.versions.read("fact", manifest, [f]).join(touched, "order_id", "left_semi").count() > 0) == has, f


def test_applied_once_and_empty_increment(spark, made):
    inc, seen = made
    p = batch_for(spark, SF)
    assert inc.apply("third", registry.increments(p.t)[2][1]) == 3 and files(inc) == seen[3]
    nothing = p.t.replace(**{k: v.where("false") for k, v in p.t.as_dict().items()})
    other = IncrementalFact(spark, scratch_path(spark, "incremental"))
    assert other.apply("nothing", nothing) == 1 and other.fact().count() == 0
    assert other.apply("all", p.t) == 2 and rows(other.fact()) == rows(p.clean_fact())


def test_conflict(spark):
    root = scratch_path(spark, "versions")
    a, b = Versions(spark, root), Versions(spark, root)
    a.commit(Manifest(1, ["x"]))
    with pytest.raises(Conflict):
        b.commit(Manifest(1, ["y"]))
    assert b.manifest().applied == ["x"] and b.versions() == [1]
    with pytest.raises(ValueError):
        a.manifest(7)


def _months_read(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if "bill_month" in x]


def test_only_the_months_asked_for_are_read(spark, made):
    p = batch_for(spark, SF)
    fact = p.fact_by_month()
    first, last = "1995-09-01", "2001-03-31"
    out = quality.out_of_period(fact, first, last)
    assert _months_read(out) and rows(out) == rows(quality.out_of_period(p.clean_fact(), first, last))
    one = reconcile.in_months(fact, "1997-05-01", "1997-05-31")
    assert _months_read(one)
    month = lambda f: int(re.search(r"bill_month=(\w+)", f).group(1))
    assert {month(f) for f in one.inputFiles()} >= {199705} and {month(r.f) for r in one.select(F.col("_metadata.file_path").alias("f")).distinct().collect()} == {199705}
    growth = dashboard.monthly_growth(fact, "1997-01-01", "1997-12-31")
    assert _months_read(growth) and growth.count() == 12
    whole = {(r.year, r.month): r.revenue for r in dashboard.monthly_growth(p.clean_fact()).collect()}
    assert all(whole[r.year, r.month] == r.revenue for r in growth.collect())
    # the incremental fact prunes the same way
    assert _months_read(reconcile.in_months(made[0].fact_by_month(), "1997-05-01", "1997-05-31"))
