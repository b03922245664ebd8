"""Exports: nested JSON, flat CSV, delivery CSV, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import null_if_blank
from shelfmark.operators.delivery import check_schema

SECTIONS = ("attributes", "evidence", "validation", "conflicts", "review_history")


def scored_twin(attributes: DataFrame, scores: DataFrame, decisions: DataFrame) -> DataFrame:
    """Attributes with recomputed scores, source counts and review flags."""
    reviewed = decisions.select("product_id", F.col("attribute").alias("name")).distinct().withColumn("is_human_reviewed", F.lit(True))
    s = scores.select("product_id", F.col("attribute").alias("name"), "confidence_score", "confidence_band",
                      F.col("evidence_count").alias("sources_count"), F.col("has_conflict").alias("has_open_conflict"))
    d = attributes.join(s, ["product_id", "name"], "left").join(reviewed, ["product_id", "name"], "left")
    return d.withColumn("is_human_reviewed", F.coalesce("is_human_reviewed", F.lit(False)))


def twin_read(products: DataFrame, twin: DataFrame, product_ids: DataFrame | None = None) -> DataFrame:
    """Products with their scored attributes; ``product_ids`` narrows the read."""
    p = products if product_ids is None else products.join(product_ids, "product_id", "left_semi")
    return p.join(twin, "product_id", "left")


def twin_csv(products: DataFrame, twin: DataFrame) -> DataFrame:
    """One row per attribute in the 14 export columns."""
    def yes(c: str) -> Column:
        return F.when(F.col(c), "YES").otherwise("NO")

    d = products.select("product_id", "part_number", "brand", "description", "category").join(twin, "product_id")
    blank = F.lit("")
    return d.select(
        "part_number", "brand", "description", "category", F.col("name").alias("attribute_name"),
        F.coalesce("value", blank).alias("raw_value"),
        F.coalesce(null_if_blank(F.col("normalized_value")), "value", blank).alias("canonical_value"),
        F.coalesce("unit", blank).alias("unit"), F.col("confidence_score").alias("confidence_pct"), "confidence_band",
        "status", "sources_count", yes("is_human_reviewed").alias("is_human_reviewed"),
        yes("has_open_conflict").alias("has_open_conflict"))


def _children(df: DataFrame, section: str, order: list[str]) -> DataFrame:
    fields = [c for c in df.columns if c != "product_id"]
    return df.select("product_id", F.lit(section).alias("section"),
                     F.concat_ws("|", *[F.col(c).cast("string") for c in order]).alias("sort_key"),
                     F.to_json(F.struct(*fields)).alias("payload"))


def twin_json(products: DataFrame, attributes: DataFrame, evidence: DataFrame, validation: DataFrame, conflicts: DataFrame,
              decisions: DataFrame, orders: dict[str, list[str]]) -> DataFrame:
    """One JSON document per product: ``(product_id, document)``; all five child sections travel in one shuffle."""
    tables = dict(zip(SECTIONS, (attributes, evidence, validation, conflicts, decisions)))
    long = reduce(lambda a, b: a.unionByName(b), [_children(t, s, orders[s]) for s, t in tables.items()])
    lists = [F.array_join(F.transform(F.sort_array(F.collect_list(
        F.when(F.col("section") == s, F.struct("sort_key", "payload")))), lambda x: x["payload"]), ",").alias(s) for s in SECTIONS]
    head = products.select("product_id", F.to_json(F.struct(*products.columns)).alias("head"))
    d = head.join(long.groupBy("product_id").agg(*lists), "product_id", "left")
    body = [F.concat(F.lit(f',"{s}":['), F.coalesce(F.col(s), F.lit("")), F.lit("]")) for s in SECTIONS]
    doc = F.concat(F.lit('{"version":"1.0","product":'), "head", *body, F.lit("}"))
    return d.select("product_id", doc.alias("document"))


def write_twin_json(documents: DataFrame, path: str) -> None:
    documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\n")
     .option("emptyValue", "").option("nullValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_delivery_csv(records: DataFrame, path: str) -> None:
    """Delivery records in header order; extra columns are dropped."""
    from shelfmark.functions.vocab import delivery_columns

    wide = records.select(*[F.col(f"`{c}`") for c in delivery_columns()])
    check_schema(wide.columns)
    write_csv(wide, path)


def write_metrics(summary: DataFrame, path: str, label: str) -> None:
    """One labelled summary row added to the metrics table; the same label is replaced."""
    from shelfmark.sources.store import overwrite_partitions

    overwrite_partitions(summary.withColumn("label", F.lit(label)), path, "label")
