"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group of this fraction of all rows is hot.
SHARE = 1024


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="granary-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes and not by rows alone, as rows hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


class Scratch:
    """Tables written once and read back, so that a lost executor costs one task and not a lineage."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bounded_batches(spark)
        self.root = f"{shared_dir(spark)}/granary-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._granary_path = path
        return out

    def release(self) -> None:
        """Let go of the shuffle files of steps whose results are written; Spark deletes them once the plans
        that made them are collected, which a driver with memory to spare may put off for long. Some plans are
        held until the first round's references are dealt with, and go in the second."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.5)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._granary_path)
            path.getFileSystem(conf).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str) -> DataFrame:
    """rows.join(groups, key), in which no group of many rows is one task.

    groups(key, size, ...) is a table with a row for each group and the number of its rows. Groups of a SHARE-th
    of all rows or more, of which there can be no more than SHARE, are salted: their rows are dealt by a hash of
    the column `spread` to as many parts as their share of the partitions, and their row is copied to each, so
    there are fewer copies than partitions and such groups together. What is broadcast is a hash and a number
    for each of them.
    """
    spark = rows.sparkSession
    total = groups.agg(F.sum(size)).first()[0] or 0
    parts = F.ceil(F.col(size) * F.lit(float(shuffle_partitions(spark))) / F.lit(max(1.0, float(total)))).cast("long")
    sized = groups.withColumn("_parts", F.when(F.col(size) * SHARE >= total, parts).otherwise(1))
    hot = sized.where("_parts > 1").groupBy(F.xxhash64(key).alias("_hash")).agg(F.max("_parts").alias("_parts"))
    dealt = rows.withColumn("_hash", F.xxhash64(key)).join(F.broadcast(hot), "_hash", "left")
    dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64(spread, F.lit(3)), F.coalesce("_parts", F.lit(1)))).drop("_hash", "_parts")
    copies = sized.withColumn("_hash", F.xxhash64(key)).drop("_parts").join(F.broadcast(hot), "_hash", "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hash", "_parts")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
