"""Encoded codes and metrics on storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may fall back to a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="rastermill-")


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there: what follows neither plans nor runs its making again."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


class Steps:
    """Tables that the steps of a piece of work write to the shared folder, packed closer than checkpoints, and remove when a later one is written.

    Shuffle files of a step go when it is written, where Spark can do so.
    """

    _CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.home, self.at = spark, f"{shared_dir(spark)}/steps-{uuid.uuid4().hex}", {}

    def put(self, df: DataFrame) -> DataFrame:
        path, before = f"{self.home}/{len(self.at)}", self.spark.conf.get(self._CLEAN, None)
        if before is not None:
            self.spark.conf.set(self._CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is not None:
                self.spark.conf.set(self._CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = (path, out)
        return out

    def remove(self, made: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at[id(made)][0])
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int = 16, dealt: bool = False) -> DataFrame:
    """df as a table of the warehouse in buckets by keys, and read from it: joins of such tables by these keys shuffle neither.

    dealt: df is in `buckets` partitions by keys already. A checkpoint would not do, as an adaptive plan's partitioning is not kept in it.
    """
    (df if dealt else df.repartition(buckets, *keys)).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def write_codes(codes: DataFrame, path: str, shards: int = 16, mode: str = "overwrite") -> None:
    """Codes by shards of images: a reader of one image opens one shard, and many images don't make many folders."""
    codes.withColumn("shard", F.pmod(F.col("image_id"), F.lit(shards)).cast("int")).repartition("shard").write.mode(mode).partitionBy("shard").parquet(path)


def read_codes(spark: SparkSession, path: str, image_id: int | None = None, shards: int = 16) -> DataFrame:
    df = spark.read.parquet(path)
    if image_id is not None:
        df = df.where((F.col("shard") == image_id % shards) & (F.col("image_id") == image_id))
    return df.drop("shard")


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Adds rows to a table of metrics; earlier ones stay."""
    metrics.write.mode("append").parquet(path)
