"""Tables with keys that several writers change at once: whole versions, copy-on-write by bucket.

Rows lie in buckets by the hash of their keys. A write merges its rows with those of the buckets that they
touch, writes these buckets anew, and makes the result visible by creating the next numbered manifest (which
folder holds each bucket), for which only one writer can succeed. One that comes too late takes over what
others did to other buckets, or merges again if they touched its own. So a writer that dies leaves nothing
visible, a reader sees one version throughout, and the number of files doesn't grow with that of the writes.

Manifests are created by a hard link on a local or mounted file system and by a rename that fails if the name
is taken elsewhere (as on HDFS); stores that have neither need a lock around `_created`.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.revisions import first_per_key, latest
from .scratch import written

ATTEMPTS = 100
BUCKET = "__bucket"


class AlreadyExists(ValueError):
    """A record that is never to change was there already."""


class KeyedTable:
    """A table under path. buckets: enough that one fits a few tasks; keys that are written together share one."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema: StructType = spark.createDataFrame([], schema).schema
        jvm = spark._jvm
        self._path, self._text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # Versions

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}" if folder else self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def manifest(self, version: int | None = None) -> dict:
        """version, files (bucket to folder) and batches (stream to the last one written); the newest unless one is named."""
        if version is None:
            version = max((int(n.split(".")[0]) for n in self._names("log") if n.endswith(".json")), default=0)
        if not version:
            return {"version": 0, "files": {}, "batches": {}}
        stream = self._fs.open(self._path(f"{self.path}/log/{version:020}.json"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _created(self, manifest: dict) -> bool:
        """Whether the manifest's version is this writer's; false if another was there first."""
        log = f"{self.path}/log"
        own, name = f"{log}/{uuid.uuid4().hex}.tmp", f"{log}/{manifest['version']:020}.json"
        out = self._fs.create(self._path(own), False)
        try:
            self._text.write(json.dumps(manifest), out, "UTF-8")
        finally:
            out.close()
        if self._fs.getScheme() != "file":
            done = not self._fs.exists(self._path(name)) and self._fs.rename(self._path(own), self._path(name))
        else:
            local = lambda p: self._path(p).toUri().getPath()
            try:
                os.link(local(own), local(name))
                done = True
            except FileExistsError:
                done = False
        self._fs.delete(self._path(own), False)
        return done

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        files = {int(b): f for b, f in manifest["files"].items()}
        paths = [f"{self.path}/{f}/{BUCKET}={b}" for b, f in sorted(files.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    # Writes

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _merge(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> int:
        """The version that holds merge(rows of the touched buckets, new). batch: a stream and its number, which is written once."""
        new = written(new.withColumn(BUCKET, self._bucket()), "changes")
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # one a bucket at most
        new = new.drop(BUCKET)
        for _ in range(ATTEMPTS):
            base = self.manifest()
            if batch is not None and base["batches"].get(batch[0], -1) >= batch[1]:
                return base["version"]
            folder = f"data-{uuid.uuid4().hex}"
            out = merge(self._rows(base, touched), new).select(*self.schema.names).withColumn(BUCKET, self._bucket())
            out.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
            filled = {n.split("=")[1] for n in self._names(folder) if n.startswith(BUCKET)}
            last = base
            while all(last["files"].get(str(b)) == base["files"].get(str(b)) for b in touched):
                files = {b: f for b, f in last["files"].items() if int(b) not in touched} | dict.fromkeys(sorted(filled), folder)
                batches = last["batches"] | ({batch[0]: batch[1]} if batch is not None else {})
                if self._created({"version": last["version"] + 1, "files": files, "batches": batches}):
                    return last["version"] + 1
                last = self.manifest()
                if batch is not None and last["batches"].get(batch[0], -1) >= batch[1]:
                    return last["version"]
        raise RuntimeError(f"{ATTEMPTS} other writers came first")

    def upsert(self, new: DataFrame, order: list[str], batch: tuple[str, int] | None = None) -> int:
        """Of all rows of a key the largest by order stays."""
        return self._merge(new, lambda old, own: latest(old.unionByName(own.select(*old.columns)), self.keys, order), batch)

    def insert_absent(self, new: DataFrame, order: list[str]) -> int:
        """Rows whose keys the table lacks; of several such the first by order."""
        return self._merge(new, lambda old, own: old.unionByName(first_per_key(own, [F.col(k) for k in self.keys], order).join(old.select(*self.keys), self.keys, "left_anti").select(*old.columns)))

    def delete(self, gone: DataFrame) -> int:
        """Rows with these keys are really gone: the new version's files don't hold them."""
        return self._merge(gone.select(*self.keys).distinct(), lambda old, own: old.join(own, self.keys, "left_anti"))

    def archive(self, new: DataFrame, number: str, order: list[str]) -> int:
        """Appends records that never change. One with a number of its own keeps it, if no other has it; others get the next ones of their keys, by order."""

        def numbered(old: DataFrame, own: DataFrame) -> DataFrame:
            last = old.groupBy(*self.keys).agg(F.max(number).alias("__last"))
            given = own.groupBy(*self.keys).agg(F.max(number).alias("__given"))
            at = Window.partitionBy(*self.keys, F.col(number).isNull()).orderBy(*order)
            rows = own.join(last, self.keys, "left").join(given, self.keys, "left")
            following = F.greatest(F.coalesce("__last", F.lit(0)), F.coalesce("__given", F.lit(0))) + F.row_number().over(at)
            rows = rows.withColumn(number, F.coalesce(number, following).cast(self.schema[number].dataType)).select(*old.columns)
            every = old.unionByName(rows)
            if not every.groupBy(*self.keys, number).count().where("count > 1").isEmpty():
                raise AlreadyExists(f"a {number} of these records is taken")
            return every

        return self._merge(new, numbered)

    # Old versions

    def vacuum(self, keep: int = 2, grace_seconds: float = 3600.0) -> int:
        """Deletes data that the last `keep` versions don't hold and that is older than readers and writers take; the number of folders."""
        newest = self.manifest()["version"]
        kept = range(max(1, newest - keep + 1), newest + 1)
        used = {f for v in kept for f in self.manifest(v)["files"].values()}
        before = (time.time() - grace_seconds) * 1000
        old = [s for s in self._fs.listStatus(self._path(self.path)) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in used and s.getModificationTime() <= before]
        for s in old:
            self._fs.delete(s.getPath(), True)
        for name in self._names("log"):
            if name.endswith(".json") and int(name.split(".")[0]) not in kept:
                self._fs.delete(self._path(f"{self.path}/log/{name}"), False)
        return len(old)
