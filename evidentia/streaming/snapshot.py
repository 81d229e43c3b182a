"""A keyed table that batches are merged into.

Layout under one shared folder: data/version=V/bucket=B holds the rows of a bucket as version V wrote them, and
manifest/version=V tells, for each bucket, which version holds it, and the last batch that is part of V. A merge reads and rewrites only the
buckets that its rows fall into, then writes the manifest; a manifest is one file and is there or is not, so readers see
whole versions, and a merge that broke off before it leaves nothing that is read. A batch number that the newest manifest
has already is left out.

Readers open the buckets of one version: one row per key, without grouping. compacted() rewrites all buckets, a file each, and
drops the versions that are neither the new one nor among the last `keep`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "bucket int, held_by long, batch long, version long"


class Snapshot:
    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 16):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def files(self):
        """Hadoop's file system and path class for the folder."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self, part: str = "manifest") -> list[int]:
        """The versions that have a whole manifest (or, for part "data", any data), the oldest first."""
        store, path = self.files()
        top = path(f"{self.folder}/{part}")
        if not store.exists(top):
            return []
        found = [x.getPath() for x in store.listStatus(top) if x.isDirectory() and x.getPath().getName().startswith("version=")]
        if part == "manifest":
            found = [p for p in found if store.exists(path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in found)

    def manifest(self, version: int) -> tuple[int, dict[int, int]]:
        """The last batch of a version, and the version that holds each bucket; one row per bucket."""
        rows = self.spark.read.schema("bucket int, held_by long, batch long").parquet(f"{self.folder}/manifest/version={version}").collect()
        return max(r["batch"] for r in rows), {r["bucket"]: r["held_by"] for r in rows if r["bucket"] is not None}

    def state(self) -> tuple[int, int, dict[int, int]]:
        """Version, last batch and holders of the newest version; -1, -1 and none before the first."""
        versions = self.versions()
        return (versions[-1], *self.manifest(versions[-1])) if versions else (-1, -1, {})

    def opened(self, holders: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/data/version={v}/bucket={b}" for b, v in sorted(holders.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def written(self, rows: DataFrame, version: int) -> list[int]:
        """Writes rows as a version's data, one file a bucket; the buckets that have rows."""
        folder = f"{self.folder}/data/version={version}"
        rows.repartition(self.buckets, "bucket").write.partitionBy("bucket").mode("overwrite").parquet(folder)
        store, path = self.files()
        return sorted(int(x.getPath().getName().split("=")[1]) for x in store.listStatus(path(folder)) if x.getPath().getName().startswith("bucket="))

    def committed(self, version: int, batch: int, holders: dict[int, int]) -> None:
        rows = [(b, v, batch) for b, v in sorted(holders.items())] or [(None, None, batch)]
        frame = self.spark.createDataFrame(rows, "bucket int, held_by long, batch long").coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")

    def merge(self, rows: DataFrame, batch: int, combine: Callable[[DataFrame], DataFrame]) -> bool:
        """Merges rows (one per key) as a batch; combine() makes one row per key of old and new ones. False if the batch is part of
        the table already."""
        version, last, holders = self.state()
        if batch <= last:
            return False
        new = self.bucketed(rows.select(*self.spark.createDataFrame([], self.schema).columns)).persist()
        try:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # `buckets` rows at most
            old = self.bucketed(self.opened({b: v for b, v in holders.items() if b in touched}))
            merged = combine(old.drop("bucket").unionByName(new.drop("bucket")))
            changed = self.written(self.bucketed(merged), version + 1)
        finally:
            new.unpersist()
        self.committed(version + 1, batch, holders | dict.fromkeys(changed, version + 1))
        return True

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an older one that is still there."""
        if version is None:
            return self.opened(self.state()[2])
        return self.opened(self.manifest(version)[1])

    def compacted(self, keep: int = 2) -> None:
        """Rewrites the table as one version of one file a bucket, and drops what none of the last `keep` versions needs."""
        version, last, holders = self.state()
        if version < 0:
            return
        changed = self.written(self.bucketed(self.opened(holders)), version + 1)
        self.committed(version + 1, last, dict.fromkeys(changed, version + 1))
        kept = self.versions()[-max(1, keep) :]
        needed = {v for k in kept for v in self.manifest(k)[1].values()}
        store, path = self.files()
        for k in self.versions():
            if k not in kept:
                store.delete(path(f"{self.folder}/manifest/version={k}"), True)
        for v in self.versions("data"):
            if v not in needed and v <= version:
                store.delete(path(f"{self.folder}/data/version={v}"), True)
