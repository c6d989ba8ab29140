"""Token ids as ORC: written in document order, read back stripe by stripe.

``write`` range-partitions the documents by id, sorts each partition, encodes the texts in Arrow
batches and writes ORC files whose id lists are integer run-length encoded, with a row index every
``row_index_stride`` rows and a Bloom filter on ``doc_id``. ``lookup`` reads chosen documents with
the ids pushed down to the stripes; ``read`` scans all stripes in parallel. The one shuffle moves
the texts; file totals (one row a file) are all that reaches the driver.

Cases: a null text is an empty document (its end id only); rows that repeat a doc_id stay, one
after the other, ordered by text; null doc_ids come first; no rows give no rows. Other columns of
the input are not read.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.tokens import encoder, list_array, slices, with_end

SCHEMA = "doc_id long, start_in_file long, ids array<int>"


def write(docs: DataFrame, path: str, vocabulary: str, kind: str = "word", end_id: int = 1,
          partitions: int | None = None, row_index_stride: int = 1000, stripe_bytes: int = 16 << 20, added: bool = False) -> None:
    """Encode ``docs`` (doc_id, text) and write one ORC file for each range of ids, in order. With
    ``added`` the strings of added tokens become those tokens (the library's default)."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches):
        enc, start = encoder(vocabulary, kind, added), 0
        for part in slices(batches):
            ids, bounds = with_end(*enc.encode(part.column(1).to_pylist()), end_id)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(start + bounds[:-1], pa.int64()), list_array(ids.view(np.int32), bounds, pa.int32())],
                ["doc_id", "start_in_file", "ids"])
            start += int(bounds[-1])

    (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
     .repartitionByRange(n, F.col("doc_id").asc_nulls_first())
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
     .mapInArrow(encode, SCHEMA)
     .write.mode("overwrite").option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id")
     .option("orc.row.index.stride", row_index_stride).option("orc.stripe.size", stripe_bytes).orc(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All documents: doc_id, ids and the file they are in."""
    return spark.read.schema(SCHEMA).orc(path).select("*", F.col("_metadata.file_name").alias("file"))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Chosen documents; stripes and row groups without them are skipped by their index."""
    return read(spark, path).where(F.col("doc_id").isin(list(doc_ids))).select("doc_id", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens and the
    crc32 of its ids as little-endian unsigned 32-bit integers."""

    def crc(batches):
        for b in batches:
            col = b.column(3)
            ends = np.asarray(col.offsets)
            data = memoryview(np.ascontiguousarray(col.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            sums = [zlib.crc32(data[4 * a:4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64())],
                                             ["doc_id", "start_in_file", "file", "n_tokens", "ids_crc32"])

    each = read(spark, path).select("doc_id", "start_in_file", "file", "ids").mapInArrow(
        crc, "doc_id long, start_in_file long, file string, n_tokens long, ids_crc32 long")
    ends = (read(spark, path).groupBy("file").agg(F.max(F.col("start_in_file") + F.size("ids")).alias("n"))
            .orderBy("file").collect())  # one row a file; files are named in the order of their ranges
    offsets = list(zip([r["file"] for r in ends], accumulate([0, *(int(r["n"]) for r in ends)])))
    before = spark.createDataFrame(offsets or [("", 0)], "file string, before long")
    return (each.join(F.broadcast(before), "file")
            .select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32"))
