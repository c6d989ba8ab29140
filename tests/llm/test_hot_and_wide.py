"""Joins on hot keys, windows of any length, components beyond a long, near copies behind the line stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SPACED, got, texts, words
from tests.llm.test_stages import near_brute, rows, table
from tillroll.llm import mips, split, substring
from tillroll.llm.ship import ship


def test_join_split_equals_join(spark, monkeypatch):
    left = spark.createDataFrame([(1 if i % 3 == 0 else i, i) for i in range(300)] + [(None, 5)], "k long, x long")
    keys = left.groupBy("k").agg(F.count("*").alias("n")).where("k is null or k % 2 = 1")
    want = got(left.join(keys, "k"), "k", "x", "n")
    for heavy in (1000, 2):
        monkeypatch.setattr(split, "HEAVY", heavy)
        assert got(split.join_split(left, keys, "k", "n"), "k", "x", "n") == want
    assert split.join_split(left, keys.where("false"), "k", "n").count() == 0


@pytest.mark.parametrize("n", [5, 10, 33, 50])
def test_windows_of_any_length(spark, n):
    ship(spark)
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(4)
    first, want = {}, []
    for d, x in enumerate(texts()):
        w = words(x, SPACED, False)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first.setdefault(tuple(w[k:k + n]), (d, k)) != (d, k):
                gone[k:k + n] = [True] * n
        want.append((d, len(w), sum(gone), b" ".join(a for a, g in zip(w, gone) if not g).decode()))
    assert got(substring.dedup(docs, n), "doc_id", "n_words", "n_removed", "kept") == sorted(want, key=repr)


def test_too_short_windows(spark):
    with pytest.raises(ValueError, match="shorter than a gram"):
        substring.dedup(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), 4)


def test_scores_beyond_a_long_are_refused(spark):
    ship(spark)
    schema, query = "vec_id long, embedding array<double>", F.col("vec_id") % 50 == 0
    for large in (1e18, 1e300, -1e9):
        with pytest.raises(ValueError, match="do not fit a long"):
            mips.top_k(spark.createDataFrame([(50, [large, 1.0]), (51, [1.0, 2.0])], schema), query)
    fits = mips.top_k(spark.createDataFrame([(50, [1e6, 1.0]), (51, [1.0, -2e6]), (52, [1e6, 0.5])], schema), query)
    assert got(fits, "rank", "vec_id", "score") == [(1, 52, 256 * 10**6 * 256 * 10**6 + 256 * 128), (2, 51, 256 * 256 * 10**6 - 256 * 256 * 2 * 10**6)]


def copies():
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice(["lamp", "oak", "river", "stone", "wind", "blue", "seven", "x"]) + str(rng.randrange(99)) for _ in range(9))
    out = []
    for i in range(12):
        body = [line() for _ in range(12)]
        near = [*body[:5], body[5].replace(" ", " new ", 1), *body[6:]]  # one line differs: the others go in the line stage
        out += [(10 * i, "\n".join(body)), (10 * i + 1, "\n".join(near)), (10 * i + 2, "\n".join([*body[:4], *(line() for _ in range(9))]))]
    return out


def test_near_copies_behind_the_line_stage(spark, tmp_path):
    docs = table(spark, copies())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = spark.createDataFrame(corpus_pipeline.line_dedupe(spark, docs, str(tmp_path)).collect(), docs.schema)
    assert {10 * i + 1 for i in range(12)} <= {r["doc_id"] for r in left.collect()}
    out = rows(corpus_pipeline.near_dedupe(spark, left, str(tmp_path)))
    by_rest = {r[0] for r in near_brute(sorted(tuple(r) for r in left.collect()))}
    want = {i for i in by_rest if i % 10 != 1}
    assert {r[0] for r in out} == want == {x for i in range(12) for x in (10 * i, 10 * i + 2)}
    extra = left.unionByName(table(spark, [(999, "not in the table at all"), (998, "not in the table at all")]))
    assert {r[0] for r in rows(corpus_pipeline.near_dedupe(spark, extra, str(tmp_path)))} == want | {998}
    assert corpus_pipeline.near_dedupe(spark, left.where("false"), str(tmp_path)).count() == 0
