"""Session settings this package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # call-site capture costs more than building the plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.localRelationThreshold": "48MB",
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    # written tables are compressed: the optimizer must not take a file's size for what a broadcast of it takes in the driver
    "spark.sql.sources.fileCompressionFactor": "10.0",
    # generated methods above 8000 bytes are never JIT-compiled; let Spark split them instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # shuffle files go when the query that made them is done, so a job of many written steps holds those of one
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

FACTOR = "spark.sql.sources.fileCompressionFactor"
RUNTIME = ("spark.sql.codegen.hugeMethodLimit", "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")


def tune(spark: SparkSession, stored: bool = True) -> SparkSession:
    """The settings that can still be changed on a session made elsewhere; without ``stored``, files count by their size."""
    for k in RUNTIME:
        spark.conf.set(k, SETTINGS[k])
    spark.conf.set(FACTOR, SETTINGS[FACTOR] if stored else "1.0")
    return spark


def local_session(cores: int = 8, memory: str = "8g", name: str = "shelfmark") -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    spark = (b.config("spark.ui.enabled", "false").config("spark.driver.memory", memory)
             .config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
