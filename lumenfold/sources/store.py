"""A versioned store of keyed values: buckets of files by key, and a manifest for each version that is written last.

Each change rewrites the buckets of its keys only. A version is there as soon as its manifest is, which one writer alone can create; another
that has worked on the same version takes its change to the newer one. So nothing is lost between writers, a writer that fails leaves the version
before, and old versions stay readable.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, value string, version long"


class KeyedStore:
    """Values by key under a path of any file system that Spark has, in a number of buckets that the first writer settles."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        first = self._manifest(1)
        self.buckets = first["buckets"] if first else buckets

    # Manifests: a few lines for each bucket, through the file system of the path.

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _name(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def _manifest(self, version: int) -> dict | None:
        fs, p = self._fs(self._name(version))
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> bool:
        """Whether the manifest is the version now. It is written under a name of its own, whose link to the version one writer alone can make.

        Renaming never replaces a file here, as the options say; so it fails if another was faster.
        """
        fs, p = self._fs(self._name(version))
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        _, beside = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(beside, p, never)
            return True
        except Exception as e:
            fs.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/versions")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def latest(self) -> int:
        """The newest version; 0 if there is none."""
        return max(self.versions(), default=0)

    # Values.

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None) -> DataFrame:
        """(key, value, version): each key as of a version, by default the newest, with the version that wrote it."""
        version = self.latest() if version is None else version
        manifest = self._manifest(version) if version else {"files": {}}
        if manifest is None:
            raise ValueError(f"there is no version {version}")
        paths = sorted(manifest["files"].values())
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def _apply(self, changes: DataFrame, tries: int) -> int:
        """A version with changes (key, value, gone) on the newest one; of equal keys the larger value stays."""
        changes = changes.groupBy("key", "gone").agg(F.max("value").alias("value")).withColumn("bucket", self._bucket(F.col("key")))
        new = f"{self.path}/data/{uuid.uuid4().hex}"
        changes.write.parquet(f"{new}/changes")
        changes = self.spark.read.parquet(f"{new}/changes")
        touched = sorted(r.bucket for r in changes.select("bucket").distinct().collect())
        for n in range(tries):
            base = self.latest()
            files = dict((self._manifest(base) or {"files": {}})["files"]) if base else {}
            if not touched:
                return base
            old = [files[str(b)] for b in touched if str(b) in files]
            kept = self.spark.read.schema(SCHEMA).parquet(*old) if old else self.spark.createDataFrame([], SCHEMA)
            stay = kept.join(changes.select("key"), "key", "left_anti").withColumn("bucket", self._bucket(F.col("key")))
            put = changes.where("NOT gone").select("key", "value", F.lit(base + 1).cast("long").alias("version"), "bucket")
            at = f"{new}/{n}"
            # The bucket is a folder's name, and each is written by one task: a bucket is a small part of the store.
            stay.unionByName(put).repartition("bucket").write.partitionBy("bucket").parquet(at)
            fs, p = self._fs(at)
            there = {f.getPath().getName().removeprefix("bucket="): f.getPath().toString() for f in fs.listStatus(p) if f.isDirectory()}
            files = {b: f for b, f in files.items() if int(b) not in touched} | there
            if self._commit(base + 1, {"buckets": self.buckets, "files": files}):
                return base + 1
        raise RuntimeError(f"other writers were faster {tries} times")

    def put(self, changes: DataFrame, tries: int = 20) -> int:
        """The version with the rows of changes (key, value) put in."""
        return self._apply(changes.where("key IS NOT NULL").select("key", "value", F.lit(False).alias("gone")), tries)

    def remove(self, keys: DataFrame, tries: int = 20) -> int:
        """The version without the keys."""
        return self._apply(keys.where("key IS NOT NULL").select("key", F.lit(None).cast("string").alias("value"), F.lit(True).alias("gone")), tries)

    def reset(self) -> int:
        """An empty version; those before stay."""
        while not self._commit(version := self.latest() + 1, {"buckets": self.buckets, "files": {}}):
            pass
        return version
