"""Tables kept as versions, with snapshots that are checked when they are restored.

A table is a folder of Parquet folders ``v=<number>``; the highest complete one counts. Writers add a
version and readers see the old one until the new one is complete, as Spark marks it with ``_SUCCESS``.
A snapshot is a version of its own under ``snapshots`` with the number of rows, a content hash and a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.sources import shared


class Table:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self, under: str, prefix: str) -> list[str]:
        """Names of complete folders, by Spark's own file access, so any store will do."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(under)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        found = [s.getPath() for s in files.listStatus(root)]
        done = [p for p in found if p.getName().startswith(prefix) and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(p.getName() for p in done)

    def versions(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self._folders(self.path, "v="))

    def write(self, rows: DataFrame, partition_by: str | None = None) -> int:
        """Adds a version. ``rows`` may be computed from an older version of the table."""
        number = (self.versions() or [0])[-1] + 1
        writer = rows.write.partitionBy(partition_by) if partition_by else rows.write
        writer.parquet(f"{self.path}/v={number}")
        return number

    def read(self, version: int | None = None) -> DataFrame:
        number = version or (self.versions() or [0])[-1]
        if not number:
            raise ValueError(f"no version in {self.path}")
        return self.spark.read.parquet(f"{self.path}/v={number}")

    @staticmethod
    def content(rows: DataFrame) -> DataFrame:
        """One row: number of rows and a hash that does not depend on their order."""
        return rows.select(F.xxhash64(*rows.columns).alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash"))

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the newest ``keep`` versions, which readers may still have open; returns how many went."""
        gone = self.versions()[: -max(1, keep)]
        for number in gone:
            shared.delete(self.spark, f"{self.path}/v={number}")
        return len(gone)

    def snapshot(self, name: str) -> None:
        rows = self.read()
        rows.write.parquet(f"{self.path}/snapshots/{name}")
        manifest = self.content(self.spark.read.parquet(f"{self.path}/snapshots/{name}")).withColumn("made_at", F.current_timestamp())
        manifest.write.parquet(f"{self.path}/manifests/{name}")

    def snapshots(self) -> DataFrame:
        """(name, rows, hash, made_at) of all snapshots, newest first."""
        out = self.spark.createDataFrame([], "name string, rows long, hash long, made_at timestamp")
        for name in self._folders(f"{self.path}/manifests", ""):
            out = out.unionByName(self.spark.read.parquet(f"{self.path}/manifests/{name}").withColumn("name", F.lit(name)))
        return out.orderBy(F.desc("made_at"), "name")

    def delete_snapshot(self, name: str) -> None:
        if name not in self._folders(f"{self.path}/manifests", ""):
            raise ValueError(f"no snapshot {name}")
        for part in ("manifests", "snapshots"):
            shared.delete(self.spark, f"{self.path}/{part}/{name}")

    def restore(self, name: str) -> int:
        """Checks a snapshot against its manifest and makes it the newest version."""
        if name not in self._folders(f"{self.path}/manifests", ""):
            raise ValueError(f"no snapshot {name}")
        rows = self.spark.read.parquet(f"{self.path}/snapshots/{name}")
        if self.content(rows).first() != self.spark.read.parquet(f"{self.path}/manifests/{name}").select("rows", "hash").first():
            raise ValueError(f"snapshot {name} does not match its manifest")
        return self.write(rows)
