"""Size-tiered compaction of immutable shards under versioned manifests.

A store is a folder: ``data`` has Parquet shards that never change, ``manifests`` has one folder per version, a small
Parquet table of the shards that make it up, and ``schema`` the columns. A version is first written aside and then moved to
its number in one step that fails if the number is taken, so readers see whole versions and two writers cannot both commit
one.

Rows go in and come out as they are: nulls, repeated rows and columns of any name are kept. A table without rows makes a
version without new shards; a store of such versions alone reads as no rows with the columns of the first.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import fresh

MANIFEST = "shard string, path string, rows long, bytes long, tier int"


class ConflictError(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """Shards of up to about ``target_bytes``; ``fan_in`` shards of one size tier are worth a merge.

    Tier t holds shards of base * fan_in**t bytes up to the next; shards of at least 3/4 of the target are sealed.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_in: int = 4, base_bytes: int = 1 << 16):
        self.spark, self.root, self.target, self.fan_in, self.base = spark, root.rstrip("/"), target_bytes, fan_in, base_bytes
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._files = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), conf)
        self._rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def version(self) -> int:
        """The latest committed version; 0 for a new store."""
        folder = self._path(f"{self.root}/manifests")
        if not self._files.exists(folder):
            return 0
        return max((int(x.getPath().getName()[1:]) for x in self._files.listStatus(folder)), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/v{version:06d}")

    def commit(self, shards: DataFrame, base: int) -> int:
        """Make ``shards`` the version after ``base``; raises ConflictError where that is taken."""
        aside = f"{self.root}/staging/{uuid.uuid4().hex}"
        shards.coalesce(1).write.parquet(aside)
        self._files.mkdirs(self._path(f"{self.root}/manifests"))
        try:
            self._context.rename(self._path(aside), self._path(f"{self.root}/manifests/v{base + 1:06d}"), self._rename)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise ConflictError(f"version {base + 1} is taken") from None
            raise
        return base + 1

    def _found(self, rows: DataFrame, version: int, *kept: str) -> DataFrame:
        """The shards that ``rows``, read from a folder of data, lie in, by the file metadata that Spark gives with each row;
        also the columns ``kept``, which are the same all through a shard."""
        files = rows.groupBy(F.col("_metadata.file_path").alias("path"), *kept).agg(F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes"))
        tier = F.floor(F.log(float(self.fan_in), F.greatest(F.col("bytes") / self.base, F.lit(1.0)))).cast("int")
        return files.select(F.concat(F.lit(f"v{version:06d}-"), F.md5("path")).alias("shard"), "path", "rows", "bytes", tier.alias("tier"), *kept)

    def _new_folder(self, rows: DataFrame) -> str:
        rows.limit(0).coalesce(1).write.mode("ignore").parquet(f"{self.root}/schema")
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def append(self, rows: DataFrame) -> int:
        """Write the rows as new shards and commit them; the version then."""
        base, folder = self.version(), self._new_folder(rows)
        rows.write.option("compression", "zstd").parquet(folder)
        found = self._found(self.spark.read.schema(rows.schema).parquet(folder), base + 1)
        return self.commit(self.manifest(base).unionByName(found), base)

    def append_each(self, rows: DataFrame, arrival: Column) -> int:
        """Append the rows of each value of ``arrival`` (an int, null being one too) as an arrival of its own: shards and a
        version for each, in order; without rows there is none. All are written in one pass. ``arrival`` is not stored unless it is a column already."""
        folder, name = self._new_folder(rows), fresh(rows, "_arrival")
        out = rows.withColumn(name, arrival.cast("int"))
        out.write.option("compression", "zstd").partitionBy(name).parquet(folder)
        held = f"{self.root}/staging/{uuid.uuid4().hex}"
        self._found(self.spark.read.schema(out.schema).parquet(folder), self.version() + 1, name).write.parquet(held)
        found = self.spark.read.parquet(held)
        for row in found.select(name).distinct().orderBy(name).collect():  # the arrivals' numbers
            base = self.version()
            one = found.where(F.col(name).eqNullSafe(F.lit(row[0]).cast("int"))).drop(name)
            self.commit(self.manifest(base).unionByName(one.withColumn("shard", F.concat(F.lit(f"v{base + 1:06d}-"), F.md5("path")))), base)
        return self.version()

    def plan(self, manifest: DataFrame) -> DataFrame:
        """path, shard and bin (a number from 0) of the shards to merge: open shards of a tier that holds ``fan_in`` of them or
        more, in order of name, each bin up to the target. The windows run over a row per shard, not over data."""
        tier = Window.partitionBy("tier")
        before = F.sum("bytes").over(tier.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
        chosen = manifest.where(F.col("bytes") < 0.75 * self.target).withColumn("_n", F.count(F.lit(1)).over(tier)).where(F.col("_n") >= self.fan_in)
        place = F.floor(F.coalesce(before, F.lit(0)) / self.target)
        return chosen.withColumn("_place", place).select("path", "shard", (F.dense_rank().over(Window.orderBy("tier", "_place")) - 1).alias("bin"))

    def compact(self) -> int:
        """Merge until no tier is worth it; the version then. Rows move once for each tier they climb."""
        for _ in range(1 + max(1, math.ceil(math.log(max(self.target / self.base, self.fan_in), self.fan_in)))):
            base = self.version()
            shards = self.manifest(base)
            plan = self.plan(shards)
            paths = [r.path for r in plan.select("path").collect()]  # names of files, as the reader has to be told them
            if not paths:
                break
            held = f"{self.root}/staging/{uuid.uuid4().hex}"
            plan.coalesce(1).write.parquet(held)
            plan = self.spark.read.schema("path string, shard string, bin int").parquet(held)
            bins = plan.agg(F.max("bin")).first()[0] + 1
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            rows = self.spark.read.parquet(*paths)
            file, bin_ = fresh(rows, "_file"), fresh(rows, "_bin")
            moved = rows.withColumn(file, F.col("_metadata.file_path")).join(plan.select(F.col("path").alias(file), F.col("bin").alias(bin_)), file).drop(file)
            moved.repartitionById(bins, bin_).drop(bin_).write.option("compression", "zstd").parquet(folder)  # a task for each bin
            kept = shards.join(plan.select("shard"), "shard", "left_anti")
            self.commit(kept.select(*shards.columns).unionByName(self._found(self.spark.read.schema(rows.schema).parquet(folder), base + 1)), base)
        return self.version()

    def read(self, version: int | None = None, with_shard: bool = False) -> DataFrame:
        """The rows of a version; with ``with_shard``, also the columns shard, shard_rows and tier,
        in place of any of these names."""
        shards = self.manifest(version)
        paths = [r.path for r in shards.select("path").collect()]
        if not paths and not self._files.exists(self._path(f"{self.root}/schema")):
            raise ValueError("the store is empty")
        rows = self.spark.read.parquet(*(paths or [f"{self.root}/schema"]))
        if with_shard:
            rows = rows.drop("shard", "shard_rows", "tier")
            file = fresh(rows, "_file")
            named = shards.select(F.col("path").alias(file), "shard", F.col("rows").alias("shard_rows"), "tier")
            rows = rows.withColumn(file, F.col("_metadata.file_path")).join(named, file).drop(file)
        return rows

    def vacuum(self, older_than: float = 86_400) -> int:
        """Delete folders of data that the latest version does not use, and staged tables, both only where they were last
        changed ``older_than`` seconds ago or more; the number deleted. Older versions can't be read then. An append or a
        merge that is not committed yet keeps its folders as long as it takes less time than that."""
        used = {r.path.split("/data/")[1].split("/")[0] for r in self.manifest().select("path").collect()}
        latest, gone = time.time() - older_than, 0
        for kind in ("data", "staging"):
            folder = self._path(f"{self.root}/{kind}")
            for x in self._files.listStatus(folder) if self._files.exists(folder) else ():
                inside = [x, *self._files.listStatus(x.getPath())] if x.isDirectory() else [x]
                if x.getPath().getName() not in used and max(f.getModificationTime() for f in inside) / 1000 <= latest:
                    gone += bool(self._files.delete(x.getPath(), True))
        return gone
