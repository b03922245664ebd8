"""Confidence of attributes and products, quality of products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import vocab
from shelfmark.functions.text import score_round

KEYS = ["product_id", "attribute"]


def source_weight(name: Column) -> Column:
    """Reliability of one source by the first keyword in its name."""
    low = F.lower(F.coalesce(name, F.lit("")))
    out = None
    for word, weight in vocab.SOURCE_WEIGHTS:
        out = F.when(low.contains(word), weight) if out is None else out.when(low.contains(word), weight)
    return out.otherwise(vocab.UNNAMED_SOURCE_WEIGHT)


def evidence_strength(mean: Column, count: Column) -> Column:
    mean = F.round(mean, 8)
    strong = F.least(F.lit(1.0), F.bround(mean, 2))
    lifted = F.greatest(F.lit(0.8), F.least(F.lit(1.0), F.bround(F.round(0.8 + mean * 0.25, 8), 2)))
    return F.when(F.coalesce(count, F.lit(0)) == 0, 0.5).when(mean.isNull(), 0.95).when(mean >= 0.8, strong).otherwise(lifted)


def agreement(sources: Column, evidence: Column) -> Column:
    return (F.when(sources >= 3, 1.15).when(sources >= 2, 1.05)
            .when((sources == 1) | (evidence >= 1), 1.0).otherwise(0.8))


def extraction_quality(ambiguous: Column, evidence: Column) -> Column:
    return F.when(ambiguous, 0.8).when(evidence > 0, 1.0).otherwise(0.5)


def failure_factor(passed: Column, severity: Column) -> Column:
    """Penalty of one validation result; the minimum over results counts."""
    sev = F.upper(severity)
    return F.when(passed, 1.0).when(sev == "CRITICAL", 0.1).when(sev == "HIGH", 0.5).otherwise(0.85)


def band(score: Column) -> Column:
    return F.when(score >= 90, "HIGH").when(score >= 70, "MEDIUM").otherwise("LOW")


def evidence_signals(evidence: DataFrame, distinct_sources: bool = True) -> DataFrame:
    """Reliability, mean similarity and counts per attribute.

    ``evidence(product_id, attribute, source_name, document_name, similarity)``.
    ``distinct_sources=False`` counts every piece of evidence as its own source.
    Distinct sources are counted from pre-aggregated (attribute, source) rows."""
    name = F.coalesce("document_name", "source_name")
    per_source = evidence.groupBy(*KEYS, name.alias("who")).agg(
        F.count("*").alias("n"), F.sum("similarity").alias("total"), F.count("similarity").alias("with_score"))
    sources = F.count("who") if distinct_sources else F.sum("n")
    return per_source.groupBy(*KEYS).agg(
        F.max(source_weight(F.col("who"))).alias("source_reliability"),
        F.try_divide(F.sum("total"), F.sum("with_score")).alias("mean_similarity"),
        F.sum("n").alias("evidence_count"), sources.alias("agreeing_sources"))


def validation_factors(results: DataFrame) -> DataFrame:
    return results.groupBy(*KEYS).agg(F.min(failure_factor(F.col("passed"), F.col("severity"))).alias("validation_factor"))


def score_expression(signals: DataFrame) -> DataFrame:
    """Adds score, band, block flag and explanation to rows holding all factors.

    Needs ``attribute, value, status, source_reliability, evidence_strength,
    agreement_score, extraction_quality, validation_factor, has_conflict``."""
    absent = F.col("value").isNull() | (F.upper("status") == "UNKNOWN")
    d = signals.withColumn("absent", F.coalesce(absent, F.lit(True)))
    d = d.withColumn("conflict_factor", F.when(F.col("has_conflict") & ~F.col("absent"), 0.5).otherwise(1.0))
    for f in ("source_reliability", "evidence_strength", "agreement_score", "extraction_quality"):
        d = d.withColumn(f, F.when(F.col("absent"), 0.0).otherwise(F.col(f)))
    d = d.withColumn("validation_factor", F.when(F.col("absent"), 1.0).otherwise(F.col("validation_factor")))
    product = F.lit(100.0)
    factors = ("source_reliability", "evidence_strength", "agreement_score", "extraction_quality", "validation_factor", "conflict_factor")
    for f in factors:
        product = product * F.col(f)
    d = d.withColumn("confidence_score", score_round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), product)), 1))
    d = d.withColumn("confidence_band", band(F.col("confidence_score")))
    d = d.withColumn("is_blocked", ~F.col("absent") & (F.col("has_conflict") | (F.col("validation_factor") <= 0.2)))
    line = F.format_string(
        "Score: %.1f%% (%s) | Source Rel: %.2f, Evidence Str: %.2f, Agreement: %.2f, Extraction: %.2f, Validation: %.2f, Conflict: %.2f%s",
        "confidence_score", "confidence_band", *[F.col(f) for f in factors],
        F.when(F.col("is_blocked"), " [BLOCKED: Open conflict or critical validation failure prevents auto-approval]").otherwise(""))
    none = F.concat(F.lit("Attribute '"), F.col("attribute"), F.lit("' is missing or marked UNKNOWN."))
    return d.withColumn("explanation", F.when(F.col("absent"), none).otherwise(line)).drop("absent")


def score_attributes(attributes: DataFrame, evidence: DataFrame, results: DataFrame | None, open_conflicts: DataFrame,
                     distinct_sources: bool = True) -> DataFrame:
    """Confidence per attribute; all inputs meet on (product_id, attribute).

    ``attributes(product_id, name, value, status[, is_ambiguous])``."""
    ambiguous = F.col("is_ambiguous") if "is_ambiguous" in attributes.columns else F.lit(False)
    base = attributes.select("product_id", F.col("name").alias("attribute"), "value", "status", ambiguous.alias("ambiguous"))
    d = base.join(evidence_signals(evidence, distinct_sources), KEYS, "left")
    if results is None:
        d = d.withColumn("validation_factor", F.lit(1.0))
    else:
        d = d.join(validation_factors(results), KEYS, "left").withColumn(
            "validation_factor", F.coalesce("validation_factor", F.lit(1.0)))
    flagged = open_conflicts.select(*KEYS).distinct().withColumn("has_conflict", F.lit(True))
    d = d.join(flagged, KEYS, "left").withColumn("has_conflict", F.coalesce("has_conflict", F.lit(False)))
    n = F.coalesce("evidence_count", F.lit(0))
    d = (d.withColumn("evidence_count", n)
         .withColumn("agreeing_sources", F.coalesce("agreeing_sources", F.lit(0)))
         .withColumn("source_reliability", F.coalesce("source_reliability", F.lit(vocab.NO_SOURCE_WEIGHT)))
         .withColumn("evidence_strength", evidence_strength(F.col("mean_similarity"), F.col("evidence_count")))
         .withColumn("agreement_score", agreement(F.col("agreeing_sources"), F.col("evidence_count")))
         .withColumn("extraction_quality", extraction_quality(F.col("ambiguous"), F.col("evidence_count"))))
    return score_expression(d).drop("ambiguous", "mean_similarity")


def product_confidence(scores: DataFrame) -> DataFrame:
    s = scores.groupBy("product_id").agg(
        score_round(F.avg("confidence_score"), 1).alias("overall_confidence_score"),
        F.count_if(F.col("confidence_band") == "HIGH").alias("high_confidence_attributes"),
        F.count_if(F.col("confidence_band") == "MEDIUM").alias("medium_confidence_attributes"),
        F.count_if(F.col("confidence_band") == "LOW").alias("low_confidence_attributes"),
        F.bool_or("is_blocked").alias("has_blocking_conflicts"))
    o = F.col("overall_confidence_score")
    overall = F.when((o >= 90) & ~F.col("has_blocking_conflicts"), "HIGH").when(o >= 70, "MEDIUM").otherwise("LOW")
    return s.withColumn("overall_confidence_band", overall)


def attribute_status(has_conflict: Column, confidence_band: Column) -> Column:
    return (F.when(has_conflict, "CONFLICT").when(confidence_band != "HIGH", "REQUIRES_REVIEW").otherwise("VERIFIED"))


def needs_review(status: Column) -> Column:
    return status.isin("CONFLICT", "REQUIRES_REVIEW")


def quality_score(mfr_status: Column, brand_status: Column, tax_status: Column, attributes: Column, evidence: Column,
                  has_conflicts: Column) -> Column:
    def identity(s):
        return F.when(s == "RESOLVED", 25.0).when(s == "LOW_CONFIDENCE", 12.0).otherwise(0.0)

    tax = (F.when(tax_status == "RESOLVED", 15.0).when(tax_status == "HEURISTIC", 10.0)
           .when(tax_status == "LOW_CONFIDENCE", 5.0).otherwise(0.0))
    base = (identity(mfr_status) + identity(brand_status) + tax
            + F.least(F.lit(25.0), attributes * 3.0) + F.least(F.lit(10.0), evidence * 1.5))
    kept = base * F.when(has_conflicts, 0.7).otherwise(1.0)
    identified = mfr_status.isin("RESOLVED", "LOW_CONFIDENCE") | brand_status.isin("RESOLVED", "LOW_CONFIDENCE")
    capped = F.when((attributes == 0) & ~F.coalesce(identified, F.lit(False)), F.least(kept, F.lit(15.0))).otherwise(kept)
    return score_round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), capped)), 1)


def product_status(review_count: Column, quality: Column) -> Column:
    return F.when((review_count > 0) | (quality < 50), "REQUIRES_REVIEW").otherwise("REVIEWED")


def verified_ratio(attributes: DataFrame) -> DataFrame:
    """Share of verified attributes as the product's score."""
    good = F.when((F.col("status") == "VERIFIED") & F.col("value").isNotNull(), 1.0).otherwise(0.0)
    return attributes.groupBy("product_id").agg(score_round(F.avg(good) * 100.0, 1).alias("quality_score"))
