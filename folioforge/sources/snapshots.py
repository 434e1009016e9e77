"""Versions of a table in one folder: Parquet by bucket, and one small file a version that tells which folders are in it.

A writer stages the buckets that it changes, checks them, and then creates the file of the next version. That file may be created once
only, so of two writers that began from the same version one wins and the other is refused; a reader of an earlier version keeps
reading it until its folders are released. Nothing but the list of buckets (a fixed number) ever is on the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has made a version since the base was read."""


class Refused(RuntimeError):
    """The staged rows failed their check, or the base may not be built upon."""


@dataclass(frozen=True)
class Snapshot:
    version: int
    folders: dict[int, str]
    meta: dict


class SnapshotTable:
    """Rows of ``schema`` by bucket of ``key``. All paths may lie on any file system that Spark reads; the folder must be shared."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("versions") if n.endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot | None:
        """The newest version, or the given one; None while there is none. A file that cannot be read is refused, not skipped."""
        found = self.versions()
        if not found or (version is not None and version not in found):
            return None
        number = found[-1] if version is None else version
        stream = self._fs.open(self._path(f"versions/{number:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            kept = json.loads(text)
            return Snapshot(number, {int(b): f for b, f in kept["folders"].items()}, kept["meta"])
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise Refused(f"version {number} cannot be read: {e}") from e

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def rows(self, snapshot: Snapshot | None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, or those of some of its buckets: other buckets' files are not opened."""
        paths = [f"{self.root}/{f}" for b, f in sorted(snapshot.folders.items()) if buckets is None or b in buckets] if snapshot else []
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame, base: Snapshot | None, meta: dict, touched: set[int] | None = None, check: Callable[[DataFrame], str | None] | None = None) -> Snapshot:
        """Make the next version from ``base``: ``rows`` replace its ``touched`` buckets, or all of them.

        ``check`` gets the staged rows as read back and returns what is wrong with them, or None. A failed check and a lost race
        leave the newest version as it was and delete what was staged. Without rows a touched bucket is empty afterwards. Large buckets are written by several
        tasks, so no task holds one whole.
        """
        folder = f"data/{uuid.uuid4().hex}"
        try:
            rows.select(*self.schema.names).withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/{folder}")
            written = {int(n.split("=")[1]): f"{folder}/{n}" for n in self._names(folder) if n.startswith("bucket=")}
            if touched is not None and not set(written) <= touched:
                raise Refused("rows lie outside the touched buckets")
            kept = {b: f for b, f in base.folders.items() if b not in touched} if base is not None and touched is not None else {}
            if check is not None and (wrong := check(self.rows(Snapshot(0, written, {})))):
                raise Refused(wrong)
            number = base.version + 1 if base is not None else 1
            made = Snapshot(number, kept | written, meta)
            self._publish(made)
        except BaseException:
            self._fs.delete(self._path(folder), True)
            raise
        return made

    def _publish(self, s: Snapshot) -> None:
        newest = self.versions()
        if newest and newest[-1] >= s.version:
            raise Conflict(f"version {newest[-1]} was made meanwhile")
        try:
            out = self._fs.create(self._path(f"versions/{s.version:012d}.json"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {s.version} was made meanwhile") from e
            raise
        out.write(bytearray(json.dumps({"folders": s.folders, "meta": s.meta}, ensure_ascii=False).encode()))
        out.close()

    def release(self, keep: int = 1) -> int:
        """Forget all but the ``keep`` newest versions and delete the folders that no kept version reads; returns how many folders went."""
        found = self.versions()
        kept = [self.snapshot(v) for v in found[-keep:]] if keep else []
        used = {f for s in kept for f in s.folders.values()}
        for v in found[: len(found) - len(kept)]:
            self._fs.delete(self._path(f"versions/{v:012d}.json"), False)
        gone = 0
        for batch in self._names("data"):
            for name in self._names(f"data/{batch}"):
                if name.startswith("bucket=") and f"data/{batch}/{name}" not in used:
                    gone += bool(self._fs.delete(self._path(f"data/{batch}/{name}"), True))
        return gone
