"""A keyed table on shared storage that changes bucket by bucket, with optimistic commits.

Rows lie in `buckets` folders by a hash of their key. A change reads and writes only the
buckets that it touches, into a folder of its own, and then commits a manifest that names the
folder of every bucket. Manifests are numbered; creating one that exists fails, so of two
writers one starts again from the other's state. Readers see whole states alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import VersionConflict

BUCKETS = 64  # a table's buckets are best a few GB each; large ones are written by several tasks
_BUCKET = "__bucket"


class Table:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    # -- manifests

    def _at(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    @property
    def _fs(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The numbers of the states that still exist."""
        at = self._at("_log")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith((".", "_")))

    def manifest(self, number: int) -> dict:
        jvm = self.spark.sparkContext._jvm
        stream = self._fs.open(self._at("_log", f"{number:020d}.json"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, number: int, manifest: dict) -> None:
        to = self._at("_log", f"{number:020d}.json")
        try:
            stream = self._fs.create(to, False)
        except Exception as e:
            if self._fs.exists(to):
                raise VersionConflict(f"state {number} of {self.path} was committed by another") from e
            raise
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()

    # -- states

    def read(self, number: int | None = None) -> DataFrame | None:
        """The state of that number, or the last one; null if there is none."""
        known = self.numbers()
        if not known:
            return None
        found = self.manifest(known[-1] if number is None else number)
        return self._rows(found, list(found["buckets"]))

    def as_of(self, batch: int) -> DataFrame | None:
        """The last state of batches up to that one."""
        for n in reversed(self.numbers()):
            if self.manifest(n)["batch"] <= batch:
                return self.read(n)
        return None

    def last_batch(self) -> int:
        known = self.numbers()
        return self.manifest(known[-1])["batch"] if known else -1

    def _rows(self, manifest: dict, buckets: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = sorted({f"{self.path}/{manifest['buckets'][b]}/{_BUCKET}={b}" for b in buckets if b in manifest["buckets"]})
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def change(self, new: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], batch: int = 0, retries: int = 5) -> int:
        """Commits merge(stored rows of the touched buckets or null, new rows); the state's number.

        merge must keep rows in their buckets, so it may not change keys. After a conflict it
        is done again on the state that won.
        """
        for attempt in range(retries + 1):
            known = self.numbers()
            before = self.manifest(known[-1]) if known else None
            buckets = before["count"] if before else self.buckets
            number = known[-1] + 1 if known else 0
            placed = new.withColumn(_BUCKET, self.bucket(buckets))
            touched = [str(r[0]) for r in placed.select(_BUCKET).distinct().collect()]  # `buckets` rows at most
            stored = self._rows(before, touched) if before else None
            out = merge(stored, new)
            folder = f"g{number:020d}-{uuid.uuid4().hex}"
            out.withColumn(_BUCKET, self.bucket(buckets)).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
            written = {s.getPath().getName().partition("=")[2] for s in self._fs.listStatus(self._at(folder)) if "=" in s.getPath().getName()}
            places = {b: p for b, p in (before["buckets"] if before else {}).items() if b not in touched} | dict.fromkeys(sorted(written), folder)
            try:
                self._commit(number, {"count": buckets, "batch": batch, "schema": out.schema.jsonValue(), "buckets": places})
                return number
            except VersionConflict:
                self._fs.delete(self._at(folder), True)
                if attempt == retries:
                    raise
        raise AssertionError

    def expire(self, keep: int = 2) -> None:
        """Deletes all states but the last `keep`, and the folders that only they use."""
        known = self.numbers()
        used = {p for n in known[-keep:] for p in self.manifest(n)["buckets"].values()}
        gone = {p for n in known[:-keep] for p in self.manifest(n)["buckets"].values()} - used
        for n in known[:-keep]:
            self._fs.delete(self._at("_log", f"{n:020d}.json"), False)
        for p in gone:
            self._fs.delete(self._at(p), True)
