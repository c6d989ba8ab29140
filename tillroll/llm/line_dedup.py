"""Exact line dedup over levelled sorted runs of line hashes; DataFrame functions only.

A run is a table of (key hash, smallest doc_id), hash-distributed into a fixed number of buckets
and sorted in each. Documents come in batches of ascending doc_id. A batch's distinct keys are
anti-joined with every run (bucket by bucket, the runs are not shuffled); what is left is new and
becomes a run of its own, so a key is in exactly one run, with the smallest document holding it.
Whenever ``fanout`` runs stand on a level they are compacted into one run of the next level, so
there are O(fanout · log batches) runs to join.

A line of a batch stays if its key is new in this batch and this document is the key's smallest:
dropped lines are the anti-join of the batch's lines with the new run on (key, document). That
join is distributed by key *and* document, so a line that stands in a third of all documents is
spread like any other. Keys are pre-aggregated before they are shuffled.

Key: the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased; keys of fewer
than ``min_chars`` code points are never dropped. Keys are compared by two 64-bit hashes.

Cases: a null or empty text is one empty line; rows that repeat a doc_id are one document (its
lines never drop one another); a row without doc_id claims and loses nothing; other columns pass
through, and columns named as the results are replaced.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources.stage import scratch_path

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCHES, FANOUT, MIN_CHARS = 4, 2, 10


def _stripped(line: Column) -> Column:
    """``line`` without blanks at its ends. ``btrim`` walks the whole line, so only lines that have one there take it."""
    ends = reduce(lambda a, b: a | b, [F.startswith(line, F.lit(c)) | F.endswith(line, F.lit(c)) for c in BLANK])
    return F.when(ends, F.btrim(line, F.lit(BLANK))).otherwise(line)


def _lowered(line: Column) -> Column:
    """A-Z lower-cased. ``lower`` is faster than ``translate`` and the same on ASCII lines."""
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def line_key(line: Column) -> Column:
    """The key of a line."""
    return _lowered(_stripped(line))


class LineRuns:
    """The runs of one dedup job, under the session's shared checkpoint folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made = 0
        self.prefix = f"line_run_{os.urandom(6).hex()}"

    def _write(self, keys: DataFrame) -> str:
        name = f"{self.prefix}_{self.made}"
        self.made += 1
        (keys.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", scratch_path(self.spark, name)).saveAsTable(name))
        return name

    def add(self, keys: DataFrame) -> DataFrame:
        """Anti-join a batch's (h1, h2, first) with all runs, store the rest as a run, return it."""
        for run in (r for level in self.levels for r in level):
            keys = keys.join(self.spark.table(run), ["h1", "h2"], "left_anti")
        name = self._write(keys)
        new = self.spark.table(name)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        return new

    def compact(self) -> None:
        """Merge full levels upwards. Files of merged runs stay for results not yet computed."""
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fanout:
                merged = self.spark.table(self.levels[i][0])
                for run in self.levels[i][1:]:
                    merged = merged.unionByName(self.spark.table(run))
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._write(merged))
                self.levels[i] = []


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, _t (which text), pos and key hash of every line that can be dropped."""
    lines = docs.where("doc_id is not null").select(
        "doc_id", F.xxhash64("text").alias("_t"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    # lower-casing keeps the length, so short lines go before it
    long = lines.select("doc_id", "_t", "pos", _stripped(F.col("line")).alias("line")).where(F.char_length("line") >= min_chars)
    keyed = long.select("doc_id", "_t", "pos", _lowered(F.col("line")).alias("key"))
    return keyed.select("doc_id", "_t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dedup_batch(runs: LineRuns, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One batch (all its doc_ids above those of earlier batches): adds its keys to ``runs`` and
    returns its documents with ``text`` = the lines that stay, n_lines (before) and n_dropped."""
    lines = _lines(docs, min_chars)
    new = runs.add(lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first")))
    dropped = (lines.join(new.withColumnRenamed("first", "doc_id"), ["h1", "h2", "doc_id"], "left_anti")
               .groupBy("doc_id", "_t").agg(F.array_sort(F.collect_set("pos")).alias("_gone")))
    rows = docs.drop("n_lines", "n_dropped", "_gone", "_t").withColumn("_t", F.xxhash64("text"))
    joined = rows.join(dropped, ["doc_id", "_t"], "left").withColumn("_all", F.split(F.coalesce("text", F.lit("")), "\n"))
    # the lines between one dropped line and the next, as slices: linear in the lines of a document
    kept = F.expr("""flatten(transform(sequence(0, size(_gone)), i -> slice(_all,
        if(i = 0, 1, _gone[i - 1] + 2), if(i = size(_gone), size(_all), _gone[i]) - if(i = 0, 0, _gone[i - 1] + 1))))""")
    out = joined.select(
        *[F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(c) for c in rows.columns if c != "_t"],
        F.size("_all").cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))
    runs.compact()
    return out


def dedup(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` (doc_id, text, …) in ``batches`` ranges of doc_id, through one set of runs."""
    runs = LineRuns(docs.sparkSession, fanout)
    cuts = docs.agg(F.expr(f"approx_percentile(doc_id, array({', '.join(str(i / batches) for i in range(1, batches))}))")).first()[0] if batches > 1 else None
    cuts, out = sorted(set(cuts or [])), None
    for i in range(len(cuts) + 1):
        where = F.lit(True)
        if i:
            where = where & (F.col("doc_id") > cuts[i - 1])
        if i < len(cuts):
            where = where & (F.col("doc_id") <= cuts[i])
        if not i:
            where = where | F.col("doc_id").isNull()
        part = dedup_batch(runs, docs.where(where), min_chars)
        out = part if out is None else out.unionByName(part)
    return out
