"""The corpus pipeline: five stages over the documents table, each one of the library's operators.

Each stage function takes ``(spark, docs, sf_dir)`` and returns what it keeps, with the columns of
documents (the last returns packed pieces); ``run`` writes every stage as Parquet under the session's
shared checkpoint folder and reads it again, so a lost executor costs tasks of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import decontaminate, hyperminhash, langid, line_dedup, packing
from tillroll.llm.components import components
from tillroll.llm.queries import table, vocabulary
from tillroll.sources.stage import scratch_path, write_stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: texts without letters and texts far from every language
    go. A missing lang is filled with the prediction."""
    model = langid.fit(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    told = langid.predict(docs, model).where(~F.col("rejected"))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def line_dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has. One that lost lines goes if no word
    is left of it, or if all its lines (as keys, in order) are those of a document with a smaller
    doc_id: a copy whose lines are partly too short to be judged. Every other remainder stays."""
    keys = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line_dedup.line_key), "\n")
    kept = line_dedup.dedup(docs.withColumn("_h1", F.xxhash64(keys)).withColumn("_h2", F.xxhash64(F.lit(1), keys)))
    # a copy of an earlier document has lost all its lines of MIN_CHARS and more
    judged = F.exists(F.split("text", "\n"), lambda x: F.char_length(line_dedup.line_key(x)) >= line_dedup.MIN_CHARS)
    kept = write_stage(kept.withColumn("_rest", (F.col("n_dropped") > 0) & ~judged), scratch_path(spark, "lines"))
    first = kept.where("doc_id is not null").groupBy("_h1", "_h2").agg(F.min("doc_id").alias("doc_id"))
    rest = kept.where(F.col("_rest") & (F.btrim("text", F.lit(line_dedup.BLANK)) != ""))
    # by document as well as by hash, so that many copies of one document are spread
    kept = kept.where(~F.col("_rest")).unionByName(rest.join(first, ["_h1", "_h2", "doc_id"], "left_semi"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest doc_id. Two documents are linked by
    what is left of their texts (five-word shingles, similarity of 0.8) or by their texts as read from
    ``documents`` (two-word shingles, as op10): the stage before has taken the lines that copies share
    out of all but the first, so what is left of a near copy is often unlike its original. A document
    that is not in the table, or any if ``sf_dir`` is empty, is judged by what is left alone."""
    links = _grouped(docs, 5)
    if sf_dir:
        read = table(spark, sf_dir, "documents").join(docs.select("doc_id"), "doc_id", "left_semi")
        links = links.unionByName(_grouped(read, 2))
    gone = components(links).where("node <> component").select(F.col("node").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def _grouped(docs: DataFrame, k: int) -> DataFrame:
    """Documents (a) with the first of their group (b), where that is another."""
    return hyperminhash.group(docs, k=k, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten benchmark words and no whole item of fewer. Exempt are
    only items of one to three words that are common in these documents (single numbers, say)."""
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(F.size("telling_items") == 0).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of 1024."""
    return packing.pack(packing.cut(docs, vocabulary("byte_bpe_50k.json"), added=True))


STAGES = [("language_id", language_id), ("line_dedup", line_dedupe), ("near_dedup", near_dedupe), ("decontamination", decontaminated), ("packing", packed)]

#: Centroids, components and token ids cannot be said in SQL. tests/llm/test_stages.py holds the whole
#: outputs of the line, near-duplicate and decontamination stages against brute force, and
#: test_added_tokens.py the packed ids against the tokenizers library; the language stage has
#: single assertions only (test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir), scratch_path(spark, name))
    return docs
