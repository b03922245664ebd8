"""Registered queries of the operators, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.llm import credentials, decontaminate, embeddings, infill, jaccard, languages, licenses, line_dedup, mixing, quality, substrings, vector_codes, warc

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sha256(text):
    return F.sha2(text.cast("binary"), 256)


@query("op1_substring_dedup", substrings.SQL)
def _(spark, sf):
    return substrings.remove_repeats(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op2_language_id")
def _(spark, sf):
    return languages.identify(table(spark, sf, "documents"))


@query("op3_warc_revisits", warc.SQL)
def _(spark, sf):
    out = warc.resolve(warc.page_records(table(spark, sf, "pages")))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return out.select("record_id", "url", "outcome", "response_id", told.alias("headers"), sha256(F.col("payload")).alias("payload_sha256"))


@query("op4_quality_neighbours")
def _(spark, sf):
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op5_embedding_dedup", embeddings.SQL)
def _(spark, sf):
    return embeddings.near_copies(table(spark, sf, "embeddings"))


@query("op6_ngram_jaccard", jaccard.SQL)
def _(spark, sf):
    return jaccard.near_groups(table(spark, sf, "documents"))


@query("op7_mixing", mixing.SQL)
def _(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_decontaminate", decontaminate.SQL)
def _(spark, sf):
    return decontaminate.exact_matches(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("matches")


@query("op9_line_dedup")
def _(spark, sf):
    out = line_dedup.dedup_lines(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", sha256(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


@query("op10_license_scan", licenses.SQL)
def _(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


@query("op11_vector_codes", vector_codes.SQL)
def _(spark, sf):
    return vector_codes.compressed(table(spark, sf, "embeddings"))


@query("op12_fill_in_middle", infill.SQL)
def _(spark, sf):
    out = infill.fill_in_middle(table(spark, sf, "documents"))
    text = infill.restored(F.col("form"), F.col("output"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256(F.col("output")).alias("output_sha256"), sha256(text).alias("restored_sha256"))


@query("op13_secret_scan", credentials.SQL)
def _(spark, sf):
    out = credentials.scan(table(spark, sf, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", sha256(F.col("base_spans")).alias("base_sha256"), "spans", "n_live", "n_example")
