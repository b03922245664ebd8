"""Catalog search, facets and indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import score_round

SEARCHED = ("part_number", "brand", "description", "category")


def _like_literal(text: str) -> str:
    return "%" + text.strip() + "%"


def matches(phrase: str) -> Column:
    out = F.lit(False)
    for c in SEARCHED:
        out = out | F.coalesce(F.col(c).ilike(_like_literal(phrase)), F.lit(False))
    return out


def search(products: DataFrame, phrase: str | None = None, status: str | None = None, category: str | None = None) -> DataFrame:
    d = products
    if status and status != "ALL":
        d = d.filter(F.col("status") == status)
    if category and category != "ALL":
        d = d.filter(F.col("category") == category)
    if phrase and phrase.strip():
        d = d.filter(matches(phrase))
    return d.orderBy(F.col("updated_at").desc(), "product_id")


def listing(products: DataFrame, attributes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Products with attribute and open-conflict counts."""
    n_attr = attributes.groupBy("product_id").agg(F.count("*").alias("attributes_count"))
    n_open = conflicts.filter(F.col("status") == "OPEN").groupBy("product_id").agg(F.count("*").alias("conflicts_count"))
    d = products.join(n_attr, "product_id", "left").join(n_open, "product_id", "left")
    d = d.fillna(0, ["attributes_count", "conflicts_count"])
    return d.withColumn("has_open_conflict", F.col("conflicts_count") > 0)


def facets(listed: DataFrame, phrase: str = "", status: str = "ALL", confidence: str = "ALL", conflict: str = "ALL") -> DataFrame:
    d, score = listed, F.coalesce("overall_quality_score", F.lit(0.0))
    if phrase.strip():
        d = d.filter(matches(phrase))
    if status == "READY":
        d = d.filter(F.col("status").isin("PUBLISHED", "REVIEWED"))
    elif status != "ALL":
        d = d.filter(F.col("status") == status)
    bands = {"HIGH": score >= 90, "MEDIUM": (score >= 70) & (score < 90), "LOW": score < 70}
    if confidence in bands:
        d = d.filter(bands[confidence])
    if conflict == "HAS_CONFLICTS":
        d = d.filter(F.col("has_open_conflict"))
    elif conflict == "NO_CONFLICTS":
        d = d.filter(~F.col("has_open_conflict"))
    return d


def summary(products: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row of catalog indicators from one aggregate over both tables."""
    p = products.select("status", F.coalesce("overall_quality_score", F.lit(0.0)).alias("quality"), F.lit(True).alias("is_product"))
    c = conflicts.select("status", F.lit(None).cast("double").alias("quality"), F.lit(False).alias("is_product"))
    own = F.col("is_product")
    return p.unionByName(c).agg(
        F.count_if(own).alias("total_products"),
        F.count_if(own & F.col("status").isin("VERIFIED", "PUBLISHED", "REVIEWED")).alias("verified_count"),
        F.count_if(own & (F.col("status") == "REQUIRES_REVIEW")).alias("needs_review_count"),
        F.count_if(~own & (F.col("status") == "OPEN")).alias("conflicts_count"),
        F.coalesce(score_round(F.avg("quality"), 1), F.lit(0.0)).alias("average_quality_score"))


def delivery_indicators(products: DataFrame, conflicts: DataFrame) -> DataFrame:
    open_ids = conflicts.filter(F.col("status") == "OPEN").select("product_id").distinct().withColumn("open", F.lit(1))
    d = products.join(open_ids, "product_id", "left")
    ready = F.count_if(F.col("status").isin("PUBLISHED", "VERIFIED"))
    return d.agg(
        F.count("*").alias("processed"), ready.alias("ready"), (F.count("*") - ready).alias("review_required"),
        F.count("open").alias("critical_conflicts"),
        F.coalesce(score_round(F.try_divide(F.count_if(F.col("evidence_count") > 0) * 100.0, F.count("*")), 1), F.lit(0.0)).alias("evidence_coverage"),
        F.coalesce(score_round(F.avg(F.coalesce("overall_quality_score", F.lit(0.0))), 1), F.lit(0.0)).alias("overall_quality"))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """Newest job of each product, by a combining aggregate."""
    rest = [c for c in jobs.columns if c != "product_id"]
    return (jobs.groupBy("product_id").agg(F.max_by(F.struct(*rest), F.struct("started_at", "job_id")).alias("j"))
            .select("product_id", "j.*"))
