"""Sharding by size-tiered compaction under a versioned manifest, in DataFrame functions only.

Arrivals are appended as small immutable Parquet shards.  Shards of a similar size (a
tier spans a factor of ``fan_in``) are merged once ``fan_in`` of them are there: one scan
packs them into target-sized groups, and each group is written as one file, without a
shuffle.  A version of the store is a Parquet table of its shards; it becomes visible by
one atomic rename of a small commit file that must not exist yet, so readers see whole
versions and writers that raced try again or give up, never overwrite.

Edge cases: an arrival without rows adds no shard but keeps the schema; nulls, empty
and very long texts, repeated rows and any columns are kept as they are; compaction
never changes the rows of a snapshot; an old version can be read until it is vacuumed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 128 << 20
FAN_IN = 4
#: Shards below this size share the lowest tier.
SMALLEST = 1 << 20
SHARD_ROWS = 4000
#: Shards merged by one job; the others wait for the next.
MOST_PER_JOB = 50_000

SHARDS = "file string, bytes long, tier int, since long"


class CommitConflict(RuntimeError):
    """Another writer replaced a shard that this commit wanted to replace."""


class ShardStore:
    """A table kept as shards below ``path``, which all executors and the driver can reach."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.path, self.target_bytes, self.fan_in = spark, path.rstrip("/"), target_bytes, fan_in
        self._jvm = spark._jvm

    # commits

    def _fs(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version; -1 for a store without one."""
        where, fs = self._fs(f"{self.path}/commits")
        if not fs.exists(where):
            return -1
        return max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json")), default=-1)

    def commit_info(self, version: int) -> dict:
        where, fs = self._fs(f"{self.path}/commits/{version:012d}.json")
        return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(where), "UTF-8"))

    def shards(self, version: int | None = None) -> DataFrame:
        """The shards of a version: file, bytes, tier and the version that added it."""
        version = self.version() if version is None else version
        if version < 0:
            return self.spark.createDataFrame([], SHARDS)
        return self.spark.read.schema(SHARDS).parquet(self.commit_info(version)["shards"])

    def _publish(self, version: int, info: dict) -> bool:
        """Make ``version`` visible unless it exists; the rename is atomic and never replaces."""
        tmp, fs = self._fs(f"{self.path}/tmp/{uuid.uuid4().hex}.json")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(info).encode()))
        out.close()
        final, _ = self._fs(f"{self.path}/commits/{version:012d}.json")
        fs.mkdirs(final.getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(tmp), fs.makeQualified(final), options)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(tmp, False)
            return False
        return True

    def _commit(self, added: DataFrame, removed: DataFrame | None, schema: StructType, reason: str) -> int:
        """Commit the current shards without ``removed`` and with ``added``; on a race, try on top of the winner."""
        gone = None if removed is None else removed.select("file")
        while True:
            version = self.version()
            current = self.shards(version)
            if gone is not None and (lost := gone.join(current, "file", "left_anti").count()):
                raise CommitConflict(f"{lost} shards were replaced by another writer")
            kept = current if gone is None else current.join(gone, "file", "left_anti")
            table = f"{self.path}/versions/{uuid.uuid4().hex}"
            kept.unionByName(added.withColumn("since", F.lit(version + 1).cast("long"))).coalesce(1).write.parquet(table)
            if self._publish(version + 1, {"shards": table, "schema": schema.json(), "reason": reason}):
                return version + 1

    # data

    def _tier(self, size):
        """Number of the tier, by powers of ``fan_in`` above the smallest size."""
        return F.greatest(F.lit(0), F.floor(F.log(size / F.lit(float(SMALLEST))) / F.log(F.lit(float(self.fan_in)))) + 1).cast("int")

    def _write(self, df: DataFrame, rows_per_file: int | None) -> DataFrame:
        """Write ``df`` to new files and describe them; empty files aren't shards."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(folder)
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
        if not df.columns:
            return files.limit(0).withColumn("tier", F.lit(0))
        filled = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n")).where("n > 0")
        return files.join(filled, F.replace(files["file"], F.lit("file:///"), F.lit("file:/")) == F.replace(filled["path"], F.lit("file:///"), F.lit("file:/")), "left_semi").withColumn("tier", self._tier(F.col("bytes")))

    def append(self, df: DataFrame, shard_rows: int = SHARD_ROWS) -> int:
        """Add rows as small shards; returns the version they are part of."""
        return self._commit(self._write(df, shard_rows), None, df.schema, "append")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        version = self.version() if version is None else version
        schema = StructType.fromJson(json.loads(self.commit_info(version)["schema"]))
        files = [r["file"] for r in self.shards(version).select("file").collect()]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def _packing(self) -> SparkSession:
        """A session whose scans fill partitions with small files up to the target size."""
        session = self.spark.newSession()
        for key, value in {"spark.sql.files.maxPartitionBytes": self.target_bytes, "spark.sql.files.openCostInBytes": 0, "spark.sql.files.minPartitionNum": 1}.items():
            session.conf.set(key, str(value))
        return session

    def compact(self) -> int:
        """Merge tiers of at least ``fan_in`` shards until there is none; returns the version reached."""
        done: set[int] = set()
        while True:
            small = self.shards().where(F.col("bytes") < self.target_bytes // 2)
            counts = {r["tier"]: r["n"] for r in small.groupBy("tier").agg(F.count("*").alias("n")).collect()}
            ready = sorted(t for t, n in counts.items() if n >= self.fan_in and t not in done)
            if not ready:
                return self.version()
            tier = ready[0]
            runs = small.where(F.col("tier") == tier).orderBy("since", "file").limit(MOST_PER_JOB)
            files = [r["file"] for r in runs.select("file").collect()]
            schema = StructType.fromJson(json.loads(self.commit_info(self.version())["schema"]))
            merged = self._write(self._packing().read.schema(schema).parquet(*files), None)
            before = self.shards().join(self.spark.createDataFrame([(f,) for f in files], "file string"), "file", "left_semi")
            if merged.count() >= len(files):
                done.add(tier)  # the scan could not pack them further
                continue
            self._commit(merged, before, schema, f"merge tier {tier}")

    def vacuum(self) -> int:
        """Delete the files that the newest version doesn't hold; returns how many.  Older versions can't be read any more."""
        live = {r["file"].replace("file:///", "file:/") for r in self.shards().select("file").collect()}
        where, fs = self._fs(f"{self.path}/data")
        gone = 0
        for folder in fs.listStatus(where) if fs.exists(where) else []:
            for f in fs.listStatus(folder.getPath()):
                name = f.getPath().toString()
                if name.endswith(".parquet") and name.replace("file:///", "file:/") not in live:
                    gone += bool(fs.delete(f.getPath(), False))
        return gone
