"""What the operators share: staged tables, word classes, connected groups."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"
MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_unset: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see. Only a local session without one gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _unset:
        _unset[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _unset[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again; the folder goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_in = str(folder)
    return out


def discard(*tables: DataFrame) -> None:
    """Removes staged tables whose readers are all written."""
    for t in tables:
        spark = t.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.staged_in)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def freed(spark) -> None:
    """Lets Spark delete the shuffle files of finished plans now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_between(text: Column, gaps: str) -> Column:
    """Words between runs of ``gaps``; a null or empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), gaps), lambda w: w != "")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Names a row by id and content, so null and repeated ids do no harm; equal rows share it, and get equal results."""
    return [F.coalesce(doc_id.cast("long"), F.lit(-1)).alias("key_id"), F.xxhash64(text, doc_id.isNull()).alias("key_text")]


KEY = ["key_id", "key_text"]


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable over (a, b) rows of any order.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). Both are a minimum per node, combined before the
    shuffle, and one join; every round is staged, so lost executors repeat one round. Nodes may be any ordered type.
    """
    spark = edges.sparkSession
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.*").where("a <> b").distinct())
        last, now = now, stage(small, "links")
        discard(last)
        freed(spark)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots).distinct()
