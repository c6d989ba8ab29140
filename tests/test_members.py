"""Rows of wanted keys found without a shuffle, and increments that move and write less."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillroll.operators import perkey
from tillroll.operators.perkey import marked, members
from tillroll.plans import incremental, registry
from tillroll.plans.batch import batch_for
from tillroll.plans.incremental import IncrementalFact
from tillroll.sources.stage import StageStore, scratch_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("wanted", [[], [0], [3, 40_000, 70_001], [-5, 2**40, 2**40 + 9], [None, 32_768, 32_769], [-(2**63), 2**63 - 1]])
def test_members_equal_the_joins(spark, wanted):
    keys = spark.createDataFrame([(k,) for k in wanted], "k long")
    df = spark.createDataFrame([(k, i) for i, k in enumerate([None, 0, 1, 3, -1, -5, 39_999, 40_000, 70_001, 2**40, 2**40 + 9, 32_768, 32_769, -(2**63), 2**63 - 1])], "k long, i int")
    assert rows(members(df, keys, "k")) == rows(df.join(keys, "k", "left_semi"))
    assert rows(members(df, keys, "k", has=False)) == rows(df.join(keys, "k", "left_anti"))
    told = marked(df, keys, "k")
    if told is not None:
        assert "hashpartitioning(k" not in told._jdf.queryExecution().executedPlan().toString()


def test_other_keys_are_joined(spark):
    keys, df = (spark.createDataFrame([(k,) for k in ks], "k string") for ks in (["a", "b"], ["a", "c", None]))
    assert marked(df, keys, "k") is None and rows(members(df, keys, "k")) == [("a",)] and len(rows(members(df, keys, "k", has=False))) == 2


def test_likely_rows_are_as_before(spark):
    df = spark.range(5000).select((F.col("id") * 37).alias("k"))
    keys = df.where("k % 5 = 0")
    assert rows(perkey.likely_with(df, keys, "k").where("k % 5 = 0")) == rows(keys) and perkey.likely_with(df, keys, "k").count() < 1100


def test_an_increment_lays_its_rows_out_once(spark, monkeypatch):
    p = batch_for(spark, SF)
    p.clean_fact()
    written, staged = [], []
    monkeypatch.setattr(incremental, "write_stage", lambda df, path, was=incremental.write_stage: written.append(path) or was(df, path))
    monkeypatch.setattr(StageStore, "stage", lambda self, name, *a, was=StageStore.stage, **k: staged.append(name) or was(self, name, *a, **k))
    inc = IncrementalFact(spark, scratch_path(spark, "incremental"))
    parts = registry.increments(p.t)
    inc.apply(*parts[0])
    assert not written and "clean_fact" not in staged  # all orders are new: none is looked for, none written again
    inc.apply(*parts[1])
    assert len(written) >= 4 and "clean_fact" not in staged
    inc.apply(*parts[2])
    assert rows(inc.fact()) == rows(p.clean_fact())
