"""Reading the given tables and keeping intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table as its files split it: one plan at every size."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables, as the cluster names it.

    Only a local master may fall back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="lectern-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: lost executors re-read files instead of recomputing the plan,
    and every later use prunes columns and pushes filters into the scan.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The written intermediate tables of one call, all under one shared folder.

    ``keep`` writes a table and reads it back, ``forget`` deletes one that later steps
    replaced, ``drop`` deletes the folder once the caller has stored its result.  A ``lean`` one has
    Spark drop the shuffle files of a table as soon as it is written, instead of when the driver next collects garbage.
    """

    def __init__(self, spark: SparkSession, name: str, lean: bool = False):
        self.spark, self.lean = spark, lean
        self.path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        before = self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        if self.lean:
            self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            if self.lean:
                self.spark.conf.set(SHUFFLE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, name: str) -> None:
        delete(self.spark, f"{self.path}/{name}")

    def drop(self) -> None:
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system Spark can write to; one that does not exist is no error."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
