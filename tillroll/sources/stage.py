"""Stage tables: the tables that the cleaning steps leave behind.

Every cleaning step of the reference writes a physical table. We do the same: a stage is written
as parquet under the shared folder the cluster names in ``spark.checkpoint.dir`` and read back.
That cuts the lineage (a lost executor recomputes from the last stage, not from the sources),
keeps plans short (a chain of ~30 views ran the driver out of heap while printing the plan), and
gives the next step a columnar, pruned, pushed-down scan.

The folder is read from the session. Only where it is unset on a local master (unit tests, ad-hoc
runs) do we make one of our own with ``tempfile.mkdtemp``; on a cluster that is an error, since
every executor would write to its own disk.

A stage belongs to the inputs it was built from: its folder's name holds a fingerprint of them
(analysed plans, and paths, sizes and modification times of their files).
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import tempfile
import threading

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCKS: dict[str, threading.RLock] = {}
_GUARD = threading.Lock()


def _lock(path: str) -> threading.RLock:
    """One lock a stage, so that independent stages are built side by side."""
    with _GUARD:
        return _LOCKS.setdefault(path, threading.RLock())


#: Spark's setting by which an execution drops its shuffle files at its end.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITERS: dict[str, tuple[int, str | None]] = {}


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Executions that end inside drop their shuffle files then, not when the driver's collector finds the plan. A written table
    is read back from its files, so no one asks for the shuffles of its write again; kept, those of all stages would lie on
    disk together. The session's own setting is put back when the last write that runs at the same time has ended."""
    session = spark.sparkContext.applicationId
    with _GUARD:
        n, own = _WRITERS.get(session) or (0, spark.conf.get(_DROP_SHUFFLES, None))
        _WRITERS[session] = n + 1, own
        spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        with _GUARD:
            n, own = _WRITERS.pop(session)
            if n > 1:
                _WRITERS[session] = n - 1, own
            elif own is None:
                spark.conf.unset(_DROP_SHUFFLES)
            else:
                spark.conf.set(_DROP_SHUFFLES, own)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session (set one only when none is configured)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tillroll-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):
    """The Hadoop file system and path of ``path``."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def _exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _path(spark, path + "/_SUCCESS")
    return fs.exists(jpath)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    fs, jpath = _path(spark, path)
    fs.delete(jpath, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that must not be there yet."""
    fs, jpath = _path(spark, path)
    out = fs.create(jpath, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is none."""
    fs, jpath = _path(spark, path)
    if not fs.exists(jpath):
        return None
    stream = fs.open(jpath)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def files_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Names, sizes and modification times of files or folders of files."""
    found = []
    for path in sorted(paths):
        fs, jpath = _path(spark, path)
        for st in fs.listStatus(jpath) if fs.exists(jpath) else ():
            found.append(f"{st.getPath()}:{st.getLen()}:{st.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()


def input_fingerprint(frames: list[DataFrame]) -> str:
    """A fingerprint of what ``frames`` read: their analysed plans and their files as they are now."""
    parts = []
    for df in frames:
        parts += [str(df.semanticHash()), files_fingerprint(df.sparkSession, df.inputFiles())]
    return hashlib.sha1(":".join(parts).encode()).hexdigest()


class StageStore:
    """Writes and re-reads named stage tables under one run folder.

    ``key`` names the run and ``inputs`` its inputs (``input_fingerprint``); together with the
    application id they name the folder, so every Spark application builds its stages once, the
    ~90 registered queries share them, and a run over other inputs never finds them.
    """

    def __init__(self, spark: SparkSession, key: str, inputs: str = ""):
        self.spark = spark
        app = spark.sparkContext.applicationId
        self.digest = hashlib.sha1(f"{app}:{key}:{inputs}".encode()).hexdigest()[:12]
        self.root = f"{checkpoint_root(spark)}/tillroll-stages/{app}/{self.digest}"
        self._cache: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def seen(self, name: str) -> dict[str, int]:
        """What was observed while stage ``name`` was written (it must have been, with ``observe``)."""
        return json.loads(read_text(self.spark, f"{self.path(name)}.seen.json"))

    def stage(self, name: str, build, lookup_by: str | None = None, partition_by: str | None = None,
              observe: dict[str, str] | None = None, packed: bool = False) -> DataFrame:
        """Return stage ``name``; build and write it (``build()`` → DataFrame) on first use.

        ``lookup_by`` names a column that is looked up by value: its row groups get Bloom filters, so
        a pushed-down equality skips the ones without it (their min and max do not help, since the
        rows come out of a hash shuffle). ``partition_by`` names a column of few values: a filter on it
        reads only the folders of its values. ``observe`` names aggregates (SQL) over the rows that are gathered
        by the write itself (:meth:`seen`): they stand right below it, in the job's last stage, and of a
        partition written twice, by a retry or a speculative task, Spark counts one. ``packed`` is for tables of line size:
        they are written with zstd. Smaller ones are not, since Spark judges what it may broadcast by the files' size.

        Stages are plain parquet, not bucketed tables: a bucket holds every row of its keys, so
        one hot key (an order or customer with a third of the rows) would sit in one task in
        every later scan, where AQE cannot split it; a shuffle on the key can be split.
        """
        with _lock(self.path(name)):
            if name in self._cache:
                return self._cache[name]
            path = self.path(name)
            df = None
            if not _exists(self.spark, path):
                df = build()
                watch = Observation(name) if observe else None
                watched = df.observe(watch, *[F.expr(c).alias(k) for k, c in observe.items()]) if observe else df
                writer = watched.write.mode("overwrite")
                if packed:
                    writer = writer.option("compression", "zstd")
                if lookup_by:
                    writer = (writer.option(f"parquet.bloom.filter.enabled#{lookup_by}", "true")
                              .option("parquet.bloom.filter.adaptive.enabled", "true"))
                if partition_by:
                    writer = writer.partitionBy(partition_by)
                with shuffles_dropped(self.spark):
                    writer.parquet(path)
                if watch:
                    drop_path(self.spark, f"{path}.seen.json")
                    write_text(self.spark, f"{path}.seen.json", json.dumps({k: int(v or 0) for k, v in watch.get.items()}))
            # a partitioned table without rows has no file to tell its columns
            reader = self.spark.read.schema((df or build()).schema) if partition_by else self.spark.read
            out = reader.parquet(path)
            self._cache[name] = out
            return out

    def drop(self) -> None:
        """Delete all stages of this store."""
        self._cache.clear()
        drop_path(self.spark, self.root)


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """One-off stage: write ``df`` to ``path`` as parquet and return the re-read table."""
    with shuffles_dropped(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint root for a one-off stage. It stays until the :func:`scratch_scope` around
    the call ends, or :func:`drop_scratch` is called."""
    token = os.urandom(6).hex()
    path = f"{checkpoint_root(spark)}/tillroll-scratch/{spark.sparkContext.applicationId}/{name}-{token}"
    for scope in _SCOPES:
        scope.append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Scratch folders taken inside are deleted at the end. Results must have been written elsewhere by then (to a path
    taken before): DataFrames that still read the scratch no longer work."""
    scope: list[str] = []
    _SCOPES.append(scope)
    try:
        yield
    finally:
        _SCOPES[:] = [s for s in _SCOPES if s is not scope]
        for path in scope:
            drop_path(spark, path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch folder of this application, once its results are written."""
    drop_path(spark, f"{checkpoint_root(spark)}/tillroll-scratch/{spark.sparkContext.applicationId}")
