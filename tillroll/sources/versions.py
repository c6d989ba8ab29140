"""Versioned tables: immutable parquet files under one folder and a manifest for each version.

A version of the data set is a manifest, a small JSON file that lists the files of every table. A
change writes new files, then the next manifest; a reader follows the newest manifest it finds, so
it sees either all of a change or nothing, and older versions stay readable. Files that a change
does not touch are listed again, never rewritten.

Layout under ``root``::

    data/<table>/v=<version>_<token>/[column=value/]part-….parquet
    manifests/<version>.json

The manifest appears by a rename that fails where the name is taken: of two writers that start from
one version the second gets :class:`Conflict` and leaves files that no manifest lists. (An object
store needs a file system whose rename checks this; otherwise keep writers apart.) The driver holds
the lists of files, never rows.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tillroll.sources.stage import read_text, shuffles_dropped, write_text


class Conflict(RuntimeError):
    """Another writer has made this version."""


@dataclass
class Manifest:
    """``files``: paths relative to data/<table>, by table; ``schemas``: JSON schemas by table (with the partition
    columns); ``applied``: the names of the changes that made this version, oldest first."""

    version: int = 0
    applied: list[str] = field(default_factory=list)
    files: dict[str, list[str]] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs_lib = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        jpath = self._fs_lib.Path(path)
        return jpath.getFileSystem(self._conf), jpath

    # -- manifests ------------------------------------------------------------------------------
    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/{version:09d}.json"

    def versions(self) -> list[int]:
        fs, folder = self._path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of ``version``; version 0 has no tables."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return Manifest()
        if version not in known:
            raise ValueError(f"there is no version {version}")
        return Manifest(**json.loads(read_text(self.spark, self._manifest_path(version))))

    def commit(self, manifest: Manifest) -> None:
        """Make ``manifest`` the next version, or raise :class:`Conflict`."""
        fs, final = self._path(self._manifest_path(manifest.version))
        name = f"{self.root}/manifests/.draft-{os.urandom(6).hex()}"
        _, draft = self._path(name)
        write_text(self.spark, name, json.dumps(manifest.__dict__))
        gateway = self.spark.sparkContext._gateway
        rename = self._fs_lib.Options.Rename
        context = self._fs_lib.FileContext.getFileContext(final.toUri(), self._conf)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), gateway.new_array(rename, 0))
        except Exception as e:  # a Java exception whose class depends on the file system
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {manifest.version} exists already") from e
            raise

    # -- tables ---------------------------------------------------------------------------------
    def _data(self, table: str) -> str:
        return f"{self.root}/data/{table}"

    def write(self, table: str, df: DataFrame, version: int, partition_by: str | None = None, bloom: str | None = None) -> list[str]:
        """Write ``df`` as new files of ``table``; no version lists them yet. Returns their paths."""
        folder = f"v={version}_{os.urandom(6).hex()}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        if bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        with shuffles_dropped(self.spark):
            writer.parquet(f"{self._data(table)}/{folder}")
        fs, base = self._path(f"{self._data(table)}/{folder}")
        found, prefix = [], fs.makeQualified(base).toString() + "/"
        listed = fs.listFiles(base, True)
        while listed.hasNext():
            path = listed.next().getPath()
            if path.getName().endswith(".parquet"):
                found.append(f"{folder}/{path.toString().removeprefix(prefix)}")
        return sorted(found)

    def read(self, table: str, manifest: Manifest, files: list[str] | None = None) -> DataFrame:
        """``table`` as ``manifest`` has it, or only ``files`` of it."""
        schema = StructType.fromJson(manifest.schemas[table])
        files = manifest.files[table] if files is None else files
        if not files:
            return self.spark.createDataFrame([], schema)
        base = self._data(table)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{f}" for f in files]).drop("v")

    def relative(self, table: str, path: str) -> str:
        """A file's path, as a scan's ``_metadata.file_path`` has it, relative to its table's folder."""
        return path.split(f"/data/{table}/", 1)[1]
