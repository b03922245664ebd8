"""Table updates on immutable files: upsert, child replacement, staging."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """New rows added, given fields of known rows replaced, null fields left alone."""
    a, b = current.alias("a"), changes.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")

    def pick(c: str):
        return F.coalesce(f"b.{c}", f"a.{c}") if c in changes.columns else F.col(f"a.{c}")

    return both.select(*[pick(c).alias(c) for c in current.columns])


def replace_children(current: DataFrame, fresh: DataFrame, parents: DataFrame, key: str = "product_id") -> DataFrame:
    """Children of reprocessed parents replaced as a whole, others kept."""
    kept = current.join(parents.select(key).distinct(), key, "left_anti")
    return kept.unionByName(fresh.select(*current.columns))


def overwrite_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace only the partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path))


def shared_folder(spark, name: str) -> str:
    """Fresh folder in the one that ``spark.checkpoint.dir`` names. Only a local session without one gets a temporary folder.

    The folder goes when the session ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def _at(spark, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def path_exists(spark, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def subfolders(spark, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it does not exist."""
    fs, p = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []


def remove_folder(spark, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


class Staging:
    """Intermediate tables used by several consumers, written to the shared folder: a lost executor costs a read."""

    def __init__(self, spark, folder: str | None = None):
        self.spark = spark
        self.folder = folder or shared_folder(spark, "shelfmark")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Removes the staged tables; only once nothing reads them any more."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
