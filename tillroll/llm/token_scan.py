"""Token counts of flat, unindexed token files by a separator scan.

A token file is a run of unsigned 16-bit ids: each document's ids and one end-of-document id,
nothing else. ``scan`` reads the files in blocks of a fixed size, in parallel and in any order;
numpy finds the end ids of a block at once. What is left of a document at a block's two ends is
stitched with a prefix scan over one small row a block: the documents ended and the place of the
last end before the block. No block needs another block's ids. The blocks' ends are stored and
meet the scan's result by (file, block), so one large file's ends are not one task's; the scan of a
file is one task, with a row of four numbers for each block of it.

``write`` makes such files from a documents table, in one pass and without a shuffle: a task
appends its documents to a file of its own (the name has the task attempt, so a task that runs
again after a lost executor never meets a half-written file) and returns the order of their
doc_ids, which is kept as a table of (file, ordinal, doc_id). Files of attempts that did not count
are in no table and never read.

Cases: null and empty texts are documents of 0 ids; ids after the last end id of a file (a cut-off
document) are returned as a document of their own with ``ended`` false; rows that repeat a doc_id
stay; no files and empty files give no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tillroll.llm.tokens import encoder, slices, with_end
from tillroll.sources.stage import scratch_path, write_stage

ITEM = np.dtype("<u2")
#: Ids of a block.
BLOCK_IDS = 1 << 20


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a shared folder named as Spark names it."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, vocabulary: str, kind: str = "word", end_id: int = 49407) -> DataFrame:
    """Write the token files of ``docs`` (doc_id, text) to ``folder`` on the shared file system;
    returns the table file, ordinal, doc_id, size (bytes of the file), stored beside them."""
    spark = docs.sparkSession

    def encode(batches):
        from pyspark import TaskContext

        enc, store, out, n = encoder(vocabulary, kind), None, None, 0
        task = TaskContext.get()
        name = f"tokens-{task.partitionId():05d}-{task.taskAttemptId()}.u16"
        order = []
        for part in slices(batches):
            if out is None:
                store, path = _opened(folder)
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}")
            ids, bounds = with_end(*enc.encode(part.column(1).to_pylist()), end_id)
            out.write(ids.astype(ITEM).tobytes())
            order.append(part.column(0))
            n += int(bounds[-1])
        if out is not None:
            out.close()
            at = 0
            for col in order:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(col)), pa.array(np.arange(at, at + len(col)), pa.int64()), col, pa.array(np.full(len(col), n * ITEM.itemsize), pa.int64())],
                    ["file", "ordinal", "doc_id", "size"])
                at += len(col)

    order = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        encode, "file string, ordinal long, doc_id long, size long")
    order.write.mode("overwrite").parquet(f"{folder}/order")
    return spark.read.parquet(f"{folder}/order")


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """file and size of all token files in ``folder`` (for files that came without a table)."""
    store, path = _opened(folder)
    found = [(os.path.basename(x.path), x.size) for x in store.get_file_info(fs.FileSelector(path)) if x.is_file]
    return spark.createDataFrame(found, "file string, size long")


def scan(files: DataFrame, folder: str, end_id: int = 49407, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Per document of the token files (file, size): file, ordinal, start (ids before it in its file),
    n_tokens (without the end id), ended."""
    step = block_ids * ITEM.itemsize
    blocks = (files.select("file", "size").where("size > 0")
              .select("file", "size", F.explode(F.sequence(F.lit(0), F.expr(f"(size - 1) div {step}"))).alias("block")))
    blocks = blocks.repartition(F.col("file"), F.col("block"))

    def find(batches):
        store, path = _opened(folder)
        for b in batches:
            for name, size, block in zip(*(b.column(i).to_pylist() for i in range(3))):
                with store.open_input_file(f"{path}/{name}") as f:
                    f.seek(block * step)
                    ids = np.frombuffer(f.read(min(step, size - block * step)), ITEM)
                ends = np.flatnonzero(ids == end_id) + block * block_ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([ends[-1] if len(ends) else None], pa.int64()),
                     pa.array([block * block_ids + len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    ["file", "block", "n", "last", "to", "ends"])

    found = blocks.mapInArrow(find, "file string, block long, n long, last long, to long, ends array<long>")
    found = write_stage(found, scratch_path(files.sparkSession, "ends"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select("file", "block", "n", "last").select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("done"),
        F.coalesce(F.last("last", ignorenulls=True).over(before) + 1, F.lit(0)).alias("open"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("final"))
    stitched = found.select("file", "block", "ends", "to").join(scanned, ["file", "block"])
    each = stitched.select("file", F.col("done"), "open", "ends", F.posexplode("ends").alias("i", "end")).select(
        "file", (F.col("done") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("open")).otherwise(F.expr("ends[i - 1] + 1")).alias("start"), "end", F.lit(True).alias("ended"))
    rest = stitched.where("final").select(
        "file", (F.col("done") + F.size("ends")).alias("ordinal"),
        F.coalesce(F.expr("try_element_at(ends, -1) + 1"), F.col("open")).alias("start"), F.col("to").alias("end"), F.lit(False).alias("ended")).where("start < end")
    return each.unionByName(rest).select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "ended")


def token_counts(order: DataFrame, folder: str, end_id: int = 49407, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``scan`` of the files that ``write`` made, with their doc_ids."""
    counts = scan(order.groupBy("file").agg(F.max("size").alias("size")), folder, end_id, block_ids)
    return order.select("file", "ordinal", "doc_id").join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
