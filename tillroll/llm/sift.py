"""Leave out most rows that a join on doc_id would drop, before their texts are shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter, whatever the data (2 MB): what the driver gathers and broadcasts is bounded.
#: With far more ids than bits it lets everything pass, and the join does the work alone.
BITS = 1 << 24


def sift(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) whose doc_id may be in ``ids`` (doc_id): a Bloom filter with
    two bits an id, so a join with ``ids`` must follow."""
    h = F.xxhash64("doc_id")
    places = F.array(h.bitwiseAND(BITS - 1), F.shiftrightunsigned(h, 32).bitwiseAND(BITS - 1))
    words = (ids.select(F.explode(places).alias("p")).groupBy((F.col("p") / 64).cast("long").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("bits")))
    held = np.zeros(BITS // 64, np.uint64)
    for b in words.toArrow().to_batches():  # BITS / 64 rows at most
        held[b.column(0).to_numpy()] = b.column(1).to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        bits = sent.value
        for b in batches:
            x = b.column(2).to_numpy().view(np.uint64)
            ok = np.ones(len(x), bool)
            for p in (x & np.uint64(BITS - 1), x >> np.uint64(32) & np.uint64(BITS - 1)):
                ok &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
            yield b.select(["doc_id", "text"]).filter(pa.array(ok))

    return docs.select("doc_id", "text", h.alias("h")).mapInArrow(run, "doc_id long, text string")
