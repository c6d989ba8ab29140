"""Packing by minimum bin slack over counts of lengths.

Every document (its ids and an end id) is cut at multiples of the capacity; the last, shorter
piece is what has to be packed. The plan works on how many pieces there are of each length (at
most ``capacity`` numbers, whatever the corpus holds): for the longest length left, a bitset
subset-sum over the remaining multiset finds the sum closest to the capacity, backtracking gives
the count of each length in that window, and the window is repeated as often as the counts allow.
Windows with more than ``max_slack`` empty places are not made; the lengths concerned (say, a
third of all documents with one length that fits nothing) are laid end to end instead and cut at
the capacity, so only the very last window can be padded.

Spark numbers the pieces of each length (global range partitioning, no hot task) and looks the
plan up by number: piece k of a length belongs to one window of one pattern. The plan's table has
rows by lengths and patterns, not by pieces; it is broadcast, and its size is checked.

Cases: null or empty texts are a lone end id; rows that repeat a doc_id are packed as documents of
their own; no rows give no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.tokens import binary_array, encoder, slices, with_end
from tillroll.operators.ranking import global_row_number
from tillroll.sources.stage import scratch_path, write_stage

CAPACITY = 1024
#: Rows of the plan that may be broadcast; a plan has a few rows a length.
MAX_PLAN_ROWS = 1_000_000
#: Pieces cut once more that are broadcast to where their ids lie (some 100 bytes each); more are joined by a shuffle.
MAX_SPLIT_ROWS = 100_000


def cut(docs: DataFrame, vocabulary: str, kind: str = "byte", end_id: int = 0, capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, start, length, doc_tokens, ids (uint32, little-endian).
    With ``added`` the strings of added tokens become those tokens (the library's default)."""

    def encode(batches):
        enc = encoder(vocabulary, kind, added)
        for part in slices(batches):
            ids, bounds = with_end(*enc.encode(part.column(1).to_pylist()), end_id)
            n = np.diff(bounds)
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(n[doc] - start, capacity)
            at = np.concatenate([[0], np.cumsum(length)])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(n[doc], pa.int64()), binary_array(ids.astype("<u4"), at)],
                ["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        encode, "doc_id long, start long, length long, doc_tokens long, ids binary")


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset (length: count) with the largest sum up to ``room``: a subset-sum over a bitset,
    longer lengths first, stopped as soon as ``room`` is met, then traced back."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:
            size = min(size, left)
            steps.append((reach, length, size))
            reach |= (reach << (length * size)) & mask
            left, size = left - size, size * 2
        if reach >> room:
            break
    total, found = reach.bit_length() - 1, {}
    for before, length, size in reversed(steps):
        if not before >> total & 1:
            total -= length * size
            found[length] = found.get(length, 0) + size
    return found


def plan(counts: dict[int, int], capacity: int = CAPACITY, max_slack: int = 0) -> tuple[list[tuple], dict[int, int], int]:
    """(rows, left, windows). A row: length, first and end of the numbers of its pieces, count in a
    window, id of the first window, offset in the window. ``left``: pieces of each length in no window."""
    counts = {x: c for x, c in counts.items() if c}
    used, rows, left, windows = dict.fromkeys(counts, 0), [], {}, 0
    for seed in sorted(counts, reverse=True):
        while counts[seed]:
            counts[seed] -= 1
            window = fill(counts, capacity - seed)
            counts[seed] += 1
            window[seed] = window.get(seed, 0) + 1
            total = sum(x * c for x, c in window.items())
            if capacity - total > max_slack:
                left[seed], counts[seed] = counts[seed], 0
                break
            times, offset = min(counts[x] // c for x, c in window.items()), 0
            for x, c in sorted(window.items(), reverse=True):
                rows.append((x, used[x], used[x] + times * c, c, windows, offset))
                used[x] += times * c
                counts[x] -= times * c
                offset += x * c
            windows += times
    return rows, left, windows


def pack(pieces: DataFrame, capacity: int = CAPACITY, max_slack: int = 0) -> DataFrame:
    """Place ``pieces`` (of ``cut``, with any other columns of theirs) into sequences: adds
    ``sequence_id`` and ``offset``, both gapless from 0; pieces cut once more keep their ids' order.
    """
    spark = pieces.sparkSession
    stored = write_stage(pieces.withColumn("_piece", F.monotonically_increasing_id()), scratch_path(spark, "pieces"))
    light = stored.select("_piece", "doc_id", "start", "length", "doc_tokens", F.crc32("ids").alias("ids_crc32"))
    ranked, _ = global_row_number(light, [F.col("length"), F.col("_piece")], "_row")
    counts = {int(r[0]): int(r[1]) for r in stored.groupBy("length").count().collect()}  # at most ``capacity`` rows
    rows, left, windows = plan(dict(counts), capacity, max_slack)
    if len(rows) > MAX_PLAN_ROWS:
        raise ValueError(f"a plan of {len(rows)} rows")
    first, at = {}, 0
    for x in sorted(counts):
        first[x], at = at, at + counts[x]
    # pieces in no window: laid end to end from the first free window, after the numbers that windows took
    loose, place = [], windows * capacity
    for x in sorted(left):
        loose.append((x, counts[x] - left[x], counts[x], 0, 0, place))
        place += x * left[x]
    table = spark.createDataFrame([(x, first[x] + a, first[x] + b, a, c, w, o) for x, a, b, c, w, o in rows + loose] or [(0,) * 7],
                                  "length long, _from long, _to long, _first long, _count long, _window long, _offset long")
    k, row = F.col("_row") - 1 - F.col("_from"), F.col("_row") - 1
    placed = (ranked.join(F.broadcast(table), "length").where((row >= F.col("_from")) & (row < F.col("_to")))
              .withColumn("_loose", F.col("_count") == 0).withColumn("_k", k))
    whole = placed.where(~F.col("_loose")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_window") + F.expr("_k div _count")).alias("sequence_id"), (F.col("_offset") + F.col("_k") % F.col("_count") * F.col("length")).alias("offset"))
    laid = placed.where("_loose").withColumn("_at", F.col("_offset") + F.col("_k") * F.col("length"))
    laid = laid.withColumn("_room", F.lit(capacity) - F.col("_at") % capacity)
    fits = laid.where("_room >= length").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.expr(f"_at div {capacity}").alias("sequence_id"), (F.col("_at") % capacity).alias("offset"))
    # one piece a window at most lies across its end: its ids are fetched and cut there
    split = write_stage(laid.where("_room < length"), scratch_path(spark, "split"))
    few = split.count() <= MAX_SPLIT_ROWS
    across = (F.broadcast(split) if few else split).join(stored.select("_piece", "ids"), "_piece").select(
        "doc_id", "start", "doc_tokens", "ids", F.col("length").alias("_length"), "_at", "_room", F.explode(F.array(F.lit(0), F.lit(1))).alias("_half"))
    head = F.col("_half") == 0
    part = F.when(head, F.expr("substring(ids, 1, int(4 * _room))")).otherwise(F.expr("substring(ids, int(4 * _room + 1), int(4 * (_length - _room)))"))
    across = across.select(
        "doc_id", F.when(head, F.col("start")).otherwise(F.col("start") + F.col("_room")).alias("start"),
        F.when(head, F.col("_room")).otherwise(F.col("_length") - F.col("_room")).alias("length"), F.crc32(part).alias("ids_crc32"), "doc_tokens",
        (F.expr(f"_at div {capacity}") + F.col("_half")).alias("sequence_id"), F.when(head, F.col("_at") % capacity).otherwise(F.lit(0)).alias("offset"))
    return whole.unionByName(fits).unionByName(across)


def sequences(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """The packed ids: sequence_id and its pieces' ids joined in order of their offsets. ``ids`` has
    doc_id and ids (all ids of a document as bytes); a sequence has ``capacity`` ids at most."""
    part = F.expr("substring(ids, int(4 * start + 1), int(4 * length))")
    return (placed.join(ids.select("doc_id", "ids"), "doc_id").groupBy("sequence_id")
            .agg(F.array_sort(F.collect_list(F.struct("offset", part.alias("ids")))).alias("p"))
            .select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids")))
