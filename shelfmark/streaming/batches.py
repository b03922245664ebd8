"""Feeds processed chunk by chunk with Structured Streaming, and a ledger of what was committed.

A micro-batch writes its tables into ``batch_id`` folders and its ledger rows last: they commit it. A batch killed before that
is done again by the stream's checkpoint and overwrites its folders; one that is committed already is left alone, so a
replay changes nothing. An output folder belongs to one checkpoint; another one is refused. Readers see committed batches only.

Rows are known by file and row number (from 1, headers not counted). A row without a required field is rejected; of rows with one
product id, the first by (file, row) of the first batch is kept, and every other one is rejected naming it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.plans.enrich import Rules, RunLog, enrich
from shelfmark.sources.feed import canonical_header, natural_id, reject_reason
from shelfmark.sources.store import Staging, path_exists

WRITTEN = ("products", "attributes", "conflicts")
REQUIRED = ("part_number",)
PLACE = ("feed_file", "feed_row")
LEDGER = "feed_file string, first_row bigint, last_row bigint, processed bigint, succeeded bigint, failed bigint, batch_id bigint"


def feed_stream(spark: SparkSession, path: str, columns: list[str], files_per_batch: int = 100) -> DataFrame:
    """CSV files of a folder as a stream; every column a string."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return (spark.readStream.schema(schema).option("header", True).option("escape", '"')
            .option("maxFilesPerTrigger", files_per_batch).csv(path))


def placed(stream: DataFrame) -> DataFrame:
    """A file stream with the file and block that each row comes from."""
    if "feed_file" in stream.columns:
        return stream
    return stream.select("*", F.col("_metadata.file_path").alias("feed_file"), F.col("_metadata.file_block_start").alias("feed_block"))


def numbered(rows: DataFrame, stage: Staging) -> DataFrame:
    """``feed_row`` in place of ``feed_block``: a row's place in its block, after the rows of the file's earlier blocks.

    Rows of a block stand together in one task, so only blocks are ordered, never rows."""
    rows = stage.keep(rows.withColumn("_at", F.monotonically_increasing_id()), "delivered")
    block = ["feed_file", "feed_block"]
    before = Window.partitionBy("feed_file").orderBy("feed_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*block).agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (rows.join(blocks, block).withColumn("feed_row", F.col("_before") + F.col("_at") - F.col("_start") + 1)
            .drop("feed_block", "_at", "_start", "_n", "_before"))


def judged(rows: DataFrame, taken: DataFrame | None, required=REQUIRED) -> DataFrame:
    """Rows with ``reject_reason``, null for those to be kept.  ``taken(product_id, feed_file, feed_row)`` of earlier batches."""
    missing = F.coalesce(reject_reason(required), F.when(F.col("product_id").isNull(), "Missing product id"))
    rows = rows.withColumn("reject_reason", missing)
    place = F.struct(*PLACE)
    # a row that is rejected asks for no id, so that blank rows don't pile up on one
    asks = F.when(F.col("reject_reason").isNull(), F.col("product_id"))
    first = rows.where("reject_reason IS NULL").groupBy("product_id").agg(F.min(place).alias("_first"))
    if taken is not None:
        earlier = taken.select("product_id", place.alias("_earlier"))
        first = first.join(earlier, "product_id", "left").select("product_id", F.coalesce("_earlier", "_first").alias("_first"))
    d = rows.withColumn("_id", asks).join(first.withColumnRenamed("product_id", "_id"), "_id", "left").drop("_id")
    again = F.when(F.col("_first") != place, F.concat(F.lit("Repeats row "), F.col("_first.feed_row").cast("string"), F.lit(" of "),
                                                      F.element_at(F.split("_first.feed_file", "/"), -1)))
    return d.withColumn("reject_reason", F.coalesce("reject_reason", again)).drop("_first")


def _write(df: DataFrame, out: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{out}/{table}/batch_id={batch_id}")


def _committed(spark: SparkSession, out: str, batch_id: int) -> bool:
    return path_exists(spark, f"{out}/ledger/batch_id={batch_id}/_SUCCESS")


def batch_writer(out: str, rules: Callable[[SparkSession], Rules], prepare=None, tables=WRITTEN, required=REQUIRED) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: number, judge, enrich, write the tables, then the ledger."""

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _committed(spark, out, batch_id):
            # as many names as the stream takes files a batch
            known = {r.feed_file for r in ledger(spark, out).where(F.col("batch_id") == batch_id).select("feed_file").collect()}
            if known != {r.feed_file for r in batch.select("feed_file").distinct().collect()}:
                raise ValueError(f"{out} holds batch {batch_id} of another checkpoint")
            return
        stage = Staging(spark)
        log = RunLog()
        try:
            rows = numbered(batch, stage)
            rows = prepare(rows) if prepare else canonical_header(rows)
            if "product_id" not in rows.columns:
                rows = rows.withColumn("product_id", natural_id("part_number", "brand", "description"))
            taken = None
            if path_exists(spark, f"{out}/accepted"):
                taken = spark.read.parquet(f"{out}/accepted").where(F.col("batch_id") < batch_id)
            rows = stage.keep(judged(rows, taken, required), "judged")
            good, bad = rows.where("reject_reason IS NULL").drop("reject_reason"), rows.where("reject_reason IS NOT NULL")
            result = enrich(good.drop(*PLACE), rules(spark), staging=stage, log=log)
            written = Observation()
            for name in tables:
                _write(result[name].observe(written, F.count("*").alias("n")) if name == "products" else result[name], out, name, batch_id)
            message = F.concat(F.lit("Row "), F.col("feed_row").cast("string"), F.lit(": "), "reject_reason", F.lit(", skipped"))
            _write(bad.select(*PLACE, "product_id", "part_number", "reject_reason", message.alias("message")), out, "rejected", batch_id)
            _write(good.select("product_id", *PLACE), out, "accepted", batch_id)
            _write(log.table(spark), out, "stages", batch_id)
            figures = stage.keep(rows.groupBy("feed_file").agg(
                F.min("feed_row").alias("first_row"), F.max("feed_row").alias("last_row"), F.count("*").alias("processed"),
                F.count_if(F.col("reject_reason").isNull()).alias("succeeded"), F.count("reject_reason").alias("failed")), "figures")
            if "products" in tables:
                expected = figures.agg(F.coalesce(F.sum("succeeded"), F.lit(0))).first()[0]
                if written.get["n"] != expected:
                    raise RuntimeError(f"batch {batch_id}: {expected} rows accepted, {written.get['n']} products written")
            _write(figures, out, "ledger", batch_id)
        except Exception as error:
            if log.error is None:
                log.fail(error)
            _write(log.table(spark), out, "stages", batch_id)
            raise
        finally:
            stage.release()

    return process


def run_batches(stream: DataFrame, out: str, checkpoint: str, rules: Callable[[SparkSession], Rules], prepare=None, tables=WRITTEN, required=REQUIRED):
    """Process everything available, then stop; call again to continue.  ``prepare`` must keep the columns of ``PLACE``."""
    query = (placed(stream).writeStream.foreachBatch(batch_writer(out, rules, prepare, tables, required))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """A row per committed batch and file: row range and counters."""
    if not path_exists(spark, f"{out}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{out}/ledger")


def batch_status(spark: SparkSession, out: str) -> DataFrame:
    """Counters per committed batch."""
    return ledger(spark, out).groupBy("batch_id").agg(*(F.sum(c).alias(c) for c in ("processed", "succeeded", "failed")))


def feed_files(spark: SparkSession, path: str) -> DataFrame:
    """(feed_file) of a folder, named as the ledger names them; no content is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("feed_file"))


def job_status(spark: SparkSession, out: str, waiting: DataFrame | None = None) -> DataFrame:
    """One row: files and counters so far; COMPLETED unless ``waiting(feed_file)`` names a file that no batch holds."""
    d = ledger(spark, out).withColumn("open", F.lit(0))
    if waiting is not None:
        left = waiting.select("feed_file").distinct().join(d.select("feed_file"), "feed_file", "left_anti")
        d = d.unionByName(left.withColumn("open", F.lit(1)), allowMissingColumns=True)
    total = d.agg(F.count_distinct(F.when(F.col("open") == 0, F.col("feed_file"))).alias("files"), F.coalesce(F.sum("open"), F.lit(0)).alias("files_open"),
                  *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("processed", "succeeded", "failed")))
    return total.withColumn("status", F.when(F.col("files_open") == 0, "COMPLETED").otherwise("PROCESSING"))


def _of_committed(spark: SparkSession, out: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{table}").join(ledger(spark, out).select("batch_id").distinct(), "batch_id", "left_semi")


def errors(spark: SparkSession, out: str, newest: int | None = None) -> DataFrame:
    """Rejected rows of committed batches with file, row and message; only the ``newest`` where a number is given."""
    d = _of_committed(spark, out, "rejected")
    return d if newest is None else d.orderBy(F.desc("batch_id"), F.desc("feed_file"), F.desc("feed_row")).limit(newest)


def read_output(spark: SparkSession, out: str, table: str, key: list[str]) -> DataFrame:
    """Latest version of each row over all committed batches."""
    d = _of_committed(spark, out, table)
    rest = [c for c in d.columns if c not in [*key, "batch_id"]]
    return d.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*key, "r.*")
