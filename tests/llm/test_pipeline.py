"""The pipeline's stages on a small table: decisions, columns, and what must stay."""

from pyspark.sql import functions as F

import corpus_pipeline
from tillroll.llm.ship import ship
from tillroll.llm.queries import ORACLE_SQL, QUERIES


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_stages(spark):
    ship(spark)
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(10_001, None, None, "x", 0), (10_002, "123 456", None, "x", 7)], docs.schema)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where(F.size(F.split("text", " ")) > 20).first()["text"]
    clean = docs.where("n_chars > 400").orderBy("doc_id").first()
    more = more.unionByName(spark.createDataFrame([
        (10_003, clean["text"], clean["lang"], "x", 0), (10_004, "Some words ahead of it. " + item, "en", "x", 0)], docs.schema))
    left = docs.unionByName(more)
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, sf_dir)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        ids = {r[0] for r in out.select("doc_id").collect()}
        seen.append(ids)
        left = out
    assert not {10_001, 10_002} & seen[0] and {10_003, 10_004, clean["doc_id"]} <= seen[0]
    assert 10_003 not in seen[1] and clean["doc_id"] in seen[1]  # an exact copy has no line left
    assert 10_004 in seen[2] and 10_004 not in seen[3]
    pieces = corpus_pipeline.packed(spark, left, sf_dir)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == seen[3]
