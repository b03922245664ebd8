"""Run-quality figures over an enriched catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import is_resolved_value, score_round, share
from shelfmark.operators.claims import gathered
from shelfmark.operators.classify import input_category, manufacturer_failure, taxonomy_outcome
from shelfmark.operators.describe import description_issues


def resolved_flags(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """Adds ``mfr_ok, brand_ok, identity_ok, tax_ok``; a brand attribute also counts as brand."""
    named = (attributes.filter((F.lower("name") == "brand") & is_resolved_value(F.coalesce("normalized_value", "value")))
             .select("product_id").distinct().withColumn("brand_attr", F.lit(True)))
    d = products.join(named, "product_id", "left")
    mfr = (F.col("manufacturer_status") == "RESOLVED") | (
        F.col("manufacturer_match_type").isin("EXACT", "NORMALIZED", "FUZZY") & is_resolved_value(F.col("manufacturer")))
    brand = (F.col("brand_status") == "RESOLVED") | (
        F.col("brand_match_type").isin("EXACT", "NORMALIZED") & is_resolved_value(F.col("brand")))
    cls = F.coalesce("taxonomy_class", "category", F.lit(""))
    tax = F.col("taxonomy_status").isin("RESOLVED", "HEURISTIC") & is_resolved_value(cls)
    false = F.lit(False)
    d = d.withColumn("mfr_ok", F.coalesce(mfr, false))
    d = d.withColumn("brand_ok", F.coalesce(brand, false) | F.coalesce("brand_attr", false)).drop("brand_attr")
    return d.withColumn("identity_ok", F.col("mfr_ok") & F.col("brand_ok")).withColumn("tax_ok", F.coalesce(tax, false))


def evidence_origin(source_type: Column, source_name: Column) -> Column:
    kind, name = F.upper(F.coalesce(source_type, F.lit(""))), F.lower(F.coalesce(source_name, F.lit("")))
    return (F.when((kind == "INPUT_DESCRIPTION") | name.contains("description"), "input")
            .when(kind.isin("PDF", "DOCUMENT"), "document").when(name.contains("manufacturer"), "manufacturer").otherwise("input"))


def evidence_mix(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy(evidence_origin(F.col("source_type"), F.col("source_name")).alias("origin")).agg(
        F.count("*").alias("n_evidence"))


def evaluation_rows(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row per product with everything the summaries add up."""
    a = attributes.groupBy("product_id").agg(
        F.count("*").alias("n_attributes"),
        F.max(F.lower("name").isin("product_type", "candidate_type")).alias("has_type"))
    d = resolved_flags(products, attributes).join(a, "product_id", "left")
    issues = description_issues(F.col("desc_short"), F.col("brand"), F.col("part_number"))
    return (d.withColumn("n_attributes", F.coalesce("n_attributes", F.lit(0)))
            .withColumn("has_type", F.coalesce("has_type", F.lit(False)))
            .withColumn("desc_ok", F.size(issues) == 0)
            .withColumn("desc_made", is_resolved_value(F.col("desc_short")))
            .withColumn("input_category", input_category(F.col("description"), F.col("source_brand"))))


def _figures() -> list[Column]:
    return [
        F.count("*").alias("processed"),
        F.count_if("mfr_ok").alias("manufacturer_resolved"), F.count_if("brand_ok").alias("brand_resolved"),
        F.count_if("identity_ok").alias("identity_resolved"), F.count_if("tax_ok").alias("taxonomy_resolved"),
        share(F.sum("n_attributes").cast("double"), F.count("*")).alias("attributes_per_product"),
        share(F.sum("evidence_count").cast("double"), F.count("*")).alias("evidence_per_product"),
        F.coalesce(score_round(F.avg(F.coalesce("overall_quality_score", F.lit(0.0))), 2), F.lit(0.0)).alias("confidence_average"),
        F.count_if("desc_made").alias("descriptions_generated"), F.count_if("desc_ok").alias("descriptions_valid"),
        F.count_if(F.col("status") == "REQUIRES_REVIEW").alias("review_required"),
        F.count_if(F.col("status") == "UNRESOLVED").alias("unresolved"),
        F.count_if("has_type").alias("product_type_detected"),
    ]


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*_figures())


def by_category(rows: DataFrame) -> DataFrame:
    """Per input category plus a total row (``ALL``), in one pass."""
    total = F.when(F.grouping("input_category") == 1, "ALL").otherwise(F.col("input_category"))
    return rows.rollup("input_category").agg(total.alias("bucket"), *_figures()).drop("input_category")


def failures(rows: DataFrame) -> DataFrame:
    """Counts of manufacturer failure reasons and taxonomy outcomes."""
    reason = F.when(~F.col("mfr_ok"), manufacturer_failure(F.col("source_manufacturer"), F.col("manufacturer_status"), F.col("manufacturer_match_type")))
    outcome = taxonomy_outcome(F.col("taxonomy_status"), F.coalesce("taxonomy_class", "category"))
    pairs = F.array_compact(F.array(
        F.when(reason.isNotNull(), F.struct(F.lit("manufacturer").alias("kind"), reason.alias("reason"))),
        F.struct(F.lit("taxonomy").alias("kind"), outcome.alias("reason"))))
    return (rows.select(F.explode(pairs).alias("p")).groupBy("p.kind", "p.reason").agg(F.count("*").alias("n_products")))


def type_rate(attributes: DataFrame) -> DataFrame:
    typed = attributes.filter(F.lower("name").isin("product_type", "candidate_type"))
    return typed.select("product_id").distinct().agg(F.count("*").alias("product_type_detected"))


def samples(products: DataFrame, attributes: DataFrame, n: int = 25) -> DataFrame:
    """First products by id with all their attribute names: a report, n rows."""
    first = products.orderBy("product_id").limit(n)
    own = attributes.join(first.select("product_id"), "product_id", "left_semi")
    listed = gathered(own, ["product_id"], ["attr_ord", "name"], F.col("name"), "attribute_names")
    return first.join(listed, "product_id", "left")
