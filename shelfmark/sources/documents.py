"""Document files and texts turned into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import vocab
from shelfmark.functions.text import strip
from shelfmark.operators.retrieve import index_chunks
from shelfmark.sources.store import Staging

PAGES_A_RANGE = 1000


def file_gate(spark: SparkSession, path: str, limit: int = vocab.MAX_FILE_BYTES) -> DataFrame:
    """Files with ``reject_reason`` decided from metadata alone; contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
             .select("path", "length", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension")))
    return files.withColumn("reject_reason", gate_reason(F.col("extension"), F.col("length"), limit))


def gate_reason(extension: Column, length: Column, limit: int = vocab.MAX_FILE_BYTES) -> Column:
    return (F.when(~F.coalesce(extension, F.lit("")).isin(*vocab.DOCUMENT_EXTENSIONS), "Unsupported file type")
            .when(length == 0, "Empty file").when(length > limit, "File too large"))


def split_text(text: Column, limit: int = vocab.CHUNK_MAX_CHARS) -> Column:
    """Paragraphs packed into chunks of at most ``limit`` characters.

    A longer paragraph is packed by lines; a single longer line stays whole."""
    unit_type = "array<struct<body:string,sep:string,flush:boolean>>"

    def units(paragraph):
        lines = F.transform(F.split(paragraph, "\n"), lambda t, i: F.struct(
            t.alias("body"), F.lit("\n").alias("sep"), (i == 0).alias("flush")))
        whole = F.array(F.struct(paragraph.alias("body"), F.lit("\n\n").alias("sep"), F.lit(False).alias("flush")))
        return F.when(F.length(paragraph) > limit, lines.cast(unit_type)).otherwise(whole.cast(unit_type))

    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("done"))

    def pack(acc, u):
        full = F.length(acc["cur"]) + F.length(u["body"]) + F.length(u["sep"]) > limit
        turn = (acc["cur"] != "") & (full | u["flush"])
        return F.struct(
            F.concat(F.when(turn, "").otherwise(acc["cur"]), u["body"], u["sep"]).alias("cur"),
            F.when(turn, F.concat(acc["done"], F.array(strip(acc["cur"])))).otherwise(acc["done"]).alias("done"))

    def finish(acc):
        return F.when(strip(acc["cur"]) != "", F.concat(acc["done"], F.array(strip(acc["cur"])))).otherwise(acc["done"])

    packed = F.aggregate(F.flatten(F.transform(F.split(text, "\n\n"), units)), start, pack, finish)
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def chunk_pages(pages: DataFrame, limit: int = vocab.CHUNK_MAX_CHARS, shortest: int = vocab.CHUNK_MIN_CHARS) -> DataFrame:
    """Chunks of ``pages(document_id, page_number, text, ...)`` with a running index per document.

    The index comes from chunk counts of pages, summed in two levels: inside ranges of ``PAGES_A_RANGE`` pages and over a document's ranges. No
    text is in a window, and a document of very many pages is spread over its ranges. Tables of a page belong in front of
    its text with a lower ``unit`` number when present; a page (and unit) stands once in a document."""
    order = ["page_number"] + (["unit"] if "unit" in pages.columns else [])
    d = pages.withColumn("text", strip(F.col("text"))).filter(F.length("text") >= shortest)
    d = Staging(pages.sparkSession).keep(d.withColumn("parts", split_text(F.col("text"), limit)).drop("text"), "pages")
    counts = d.select("document_id", *order, F.floor(F.coalesce("page_number", F.lit(-1)) / PAGES_A_RANGE).alias("range"), F.size("parts").alias("n"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("document_id", "range").agg(F.sum("n").alias("n")).select("document_id", "range", F.coalesce(F.sum("n").over(before("document_id").orderBy("range")), F.lit(0)).alias("carried"))
    inside = counts.withColumn("inside", F.coalesce(F.sum("n").over(before("document_id", "range").orderBy(*order)), F.lit(0)))
    bases = inside.join(ranges, ["document_id", "range"]).select(*[F.col(c).alias(f"b_{c}") for c in ("document_id", *order)], (F.col("inside") + F.col("carried")).alias("base"))
    same = F.lit(True)
    for c in ("document_id", *order):
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    d = d.join(bases, same).drop(*[f"b_{c}" for c in ("document_id", *order)])
    keep = [c for c in d.columns if c not in ("parts", "base", "unit")]
    d = d.select(*keep, "base", F.posexplode("parts").alias("pos", "text"))
    return (d.withColumn("chunk_index", (F.col("base") + F.col("pos")).cast("int"))
            .withColumn("char_count", F.length("text")).drop("base", "pos"))


def line_chunks(documents: DataFrame, text: str = "text") -> DataFrame:
    """Non-blank trimmed lines of each document as chunks. Documents are dealt out first: one part of a file, read by one task, may hold them all."""
    documents = documents.repartition(F.xxhash64("document_id", text))
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    keep = [c for c in documents.columns if c != text]
    return documents.select(*keep, F.posexplode(lines).alias("chunk_index", "text"))


def table_text(cells: DataFrame, by: list[str], row: str = "row_index", values: str = "cells") -> DataFrame:
    """Table rows as ``a | b`` lines joined per table."""
    line = F.array_join(F.transform(values, lambda c: strip(F.coalesce(c, F.lit("")))), " | ")
    d = cells.withColumn("line", line).filter(strip(F.replace("line", F.lit("|"), F.lit(""))) != "")
    packed = F.sort_array(F.collect_list(F.struct(F.col(row).alias("r"), "line")))
    return d.groupBy(*by).agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias("table_text"))


def ingest(files: DataFrame, pages: DataFrame, dim: int = 128) -> dict[str, DataFrame]:
    """Document headers, chunks and the vector index from extracted pages.

    ``files(document_id, filename, file_size, product_id)``; ``pages`` hold the text
    layer of readable files.  Headers tell why a document gave no chunk."""
    extension = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    gated = files.withColumn("reject_reason", gate_reason(extension, F.col("file_size")))
    usable = gated.filter(F.col("reject_reason").isNull())
    kept = pages.join(usable.select("document_id", F.col("filename").alias("document_name"), "product_id"), "document_id")
    chunks = chunk_pages(kept)
    n_pages = pages.groupBy("document_id").agg(F.count_distinct("page_number").alias("page_count"))
    n_chunks = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    heads = gated.join(n_pages, "document_id", "left").join(n_chunks, "document_id", "left")
    none = F.col("chunk_count").isNull()
    heads = heads.select(
        "document_id", "filename", "file_size", "product_id",
        F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.when(F.col("reject_reason").isNotNull(), "FAILED").otherwise("COMPLETED").alias("status"),
        F.coalesce("reject_reason", F.when(none, "No extractable text found")).alias("error_message"))
    return {"documents": heads, "chunks": chunks, "index": index_chunks(chunks, dim)}
