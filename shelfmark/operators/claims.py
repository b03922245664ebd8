"""Claims: what each source says about an attribute, and where sources disagree.

Groups are reduced to distinct values and sources before anything is gathered, so
lists and messages hold all of them, whatever the size of a group; the long tables
``claim_values`` and ``claim_sources`` give the same without lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import vocab
from shelfmark.functions.text import format_number, null_if_blank, strip
from shelfmark.functions.units import with_norm

KEYS = ["product_id", "attribute"]
CLAIM_COLUMNS = ["product_id", "attribute", "value", "source_name", "source_type", "evidence_id", "page_number",
                 "snippet", "similarity", "claim_ord"]


def claims_from_facts(facts: DataFrame, feed: DataFrame) -> DataFrame:
    """Text facts as claims of the product description."""
    kept = facts.filter(~F.col("attribute").isin("source_brand", "candidate_brand"))
    return (kept.join(feed.select("product_id", "description"), "product_id")
            .select("product_id", "attribute", "value", F.lit("Product Description").alias("source_name"),
                    F.col("source").alias("source_type"), F.lit(None).cast("string").alias("evidence_id"),
                    F.lit(None).cast("int").alias("page_number"), F.col("description").alias("snippet"),
                    F.lit(0.85).alias("similarity"), F.col("ord").cast("bigint").alias("claim_ord")))


def union_claims(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*CLAIM_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*CLAIM_COLUMNS))
    return out


def claims_from_evidence(attributes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims rebuilt from stored evidence for attributes with more than one piece.

    ``evidence(product_id, attribute, evidence_id, document_name, source_name)``."""
    many = evidence.groupBy(*KEYS).agg(F.count("*").alias("n")).filter(F.col("n") > 1).drop("n")
    value = attributes.select("product_id", F.col("name").alias("attribute"), "value").join(many, KEYS)
    return evidence.join(value, KEYS).select(
        *KEYS, "value", F.coalesce(null_if_blank(F.col("document_name")), F.col("source_name")).alias("source_name"), "evidence_id")


def canonical(norm: Column, raw: Column, fold_milliamps: bool = True) -> Column:
    """Spelling-free form of a value; milliamps are compared in amps."""
    value = norm["normalized_value"]
    if fold_milliamps:
        value = F.when((norm["unit"] == "mA") & norm["numeric_value"].isNotNull(),
                       F.concat(format_number(norm["numeric_value"]), F.lit(" A"))).otherwise(value)
    return F.coalesce(null_if_blank(value), strip(raw))


def with_canonical(claims: DataFrame, fold_milliamps: bool = True, known: DataFrame | None = None) -> DataFrame:
    """Adds ``norm`` and ``canonical``; ``known`` as in :func:`with_norm`."""
    d = with_norm(claims, known=known)
    return d.withColumn("canonical", canonical(F.col("norm"), F.col("value"), fold_milliamps))


def best_claims(claims: DataFrame) -> DataFrame:
    """Most similar claim per attribute, the earliest on a tie."""
    rank = F.struct(F.col("similarity"), -F.col("claim_ord"))
    kept = ["value", "source_name", "similarity"] + [c for c in ("norm",) if c in claims.columns]
    best = F.max_by(F.struct(*kept), rank)
    return (claims.groupBy(*KEYS).agg(best.alias("b"), F.count("*").alias("n_claims"), F.min("claim_ord").alias("attr_ord"))
            .select(*KEYS, *[F.col(f"b.{c}").alias(c) for c in kept], "n_claims", "attr_ord"))


def stated(claims: DataFrame) -> DataFrame:
    """Claims that state a value at all."""
    v = strip(F.col("value"))
    return claims.filter(v.isNotNull() & (v != "") & (F.upper("value") != "UNKNOWN"))


def claim_values(canonical_claims: DataFrame) -> DataFrame:
    """One row per distinct canonical value with its first spelling."""
    return canonical_claims.groupBy(*KEYS, "canonical").agg(
        F.min(F.struct("claim_ord", "value")).alias("first"), F.count("*").alias("n_claims")).select(
        *KEYS, "canonical", F.col("first.claim_ord").alias("first_ord"), F.col("first.value").alias("first_raw"), "n_claims")


def claim_sources(canonical_claims: DataFrame) -> DataFrame:
    """One row per value and source: the full breakdown behind every conflict."""
    return canonical_claims.groupBy(*KEYS, "canonical", "source_name").agg(
        F.count("*").alias("n_claims"), F.min("claim_ord").alias("first_ord"))


def severity(attribute: Column) -> Column:
    return F.when(F.lower(attribute).isin(*vocab.SEVERE_CONFLICT_ATTRIBUTES), "HIGH").otherwise("MEDIUM")


def conflict_id(*keys: Column) -> Column:
    return F.concat(F.lit("conf_"), F.substring(F.sha2(F.concat_ws("|", *[k.cast("string") for k in keys]), 256), 1, 12))


def gathered(df: DataFrame, by: list[str], order: list[str], value: Column, alias: str) -> DataFrame:
    """Values of each group as an ordered list; ``df`` holds each value of a group once."""
    packed = F.array_sort(F.collect_list(F.struct(*order, value.alias("v"))))
    return df.groupBy(*by).agg(F.transform(packed, lambda x: x["v"]).alias(alias))


def conflicts(claims: DataFrame, fold_milliamps: bool = True, known: DataFrame | None = None) -> DataFrame:
    """Attributes whose sources state more than one canonical value.

    Header rows only; list them with :func:`conflict_lists` or join
    :func:`claim_values` and :func:`claim_sources`."""
    values = claim_values(with_canonical(stated(claims), fold_milliamps, known))
    return conflict_headers(values)


def conflict_headers(values: DataFrame) -> DataFrame:
    """Headers from the output of :func:`claim_values`."""
    head = values.groupBy(*KEYS).agg(F.count("*").alias("n_values"), F.sum("n_claims").alias("n_claims"),
                                     F.min(F.struct("first_ord", "first_raw"))["first_raw"].alias("first_value"))
    return (head.filter(F.col("n_values") > 1).withColumn("severity", severity(F.col("attribute")))
            .withColumn("status", F.lit("OPEN")).withColumn("conflict_id", conflict_id(*[F.col(k) for k in KEYS])))


def conflict_lists(heads: DataFrame, canonical_claims: DataFrame) -> DataFrame:
    """Adds the whole lists ``values, sources, evidence_ids``."""
    held = canonical_claims.join(heads.select(*KEYS), KEYS, "left_semi")
    values = gathered(claim_values(held), KEYS, ["first_ord"], F.col("first_raw"), "values")
    names = held.groupBy(*KEYS, "source_name").agg(F.min("claim_ord").alias("first_ord"))
    sources = gathered(names, KEYS, ["first_ord"], F.col("source_name"), "sources")
    evidence = gathered(supporting_evidence(held), KEYS, ["first_ord"], F.col("evidence_id"), "evidence_ids")
    return heads.join(values, KEYS, "left").join(sources, KEYS, "left").join(evidence, KEYS, "left")


def source_statements(claims: DataFrame, fold_milliamps: bool = True, known: DataFrame | None = None) -> DataFrame:
    """One row per attribute, canonical value and source: how often it says so, where first, and in which spelling.

    Blank and UNKNOWN claims count here; a claim without a source is of an unknown one. A normalised form that claims carry is taken over."""
    c = claims if "norm" in claims.columns else with_norm(claims, known=known)
    c = c.withColumn("canonical", canonical(F.col("norm"), F.col("value"), fold_milliamps)).withColumn("canonical", F.coalesce("canonical", F.lit("")))
    return (c.withColumn("source_name", F.coalesce("source_name", F.lit("Unknown Source"))).groupBy(*KEYS, "canonical", "source_name")
            .agg(F.min("claim_ord").alias("first_ord"), F.min_by("value", "claim_ord").alias("raw"), F.count("*").alias("n_claims")))


def supporting_evidence(claims: DataFrame) -> DataFrame:
    """One row per attribute and evidence id, with the place of its first claim: the long form of ``evidence_ids``."""
    return claims.filter(F.col("evidence_id") != "").groupBy(*KEYS, "evidence_id").agg(F.min("claim_ord").alias("first_ord"))


def compare_sources(claims: DataFrame, fold_milliamps: bool = True, known: DataFrame | None = None) -> DataFrame:
    """One cross-source verdict per attribute, with a readable message and what it rests on.

    Claims are reduced to (value, source) with a count before anything is gathered, so lists and messages grow with the different
    sources of an attribute, never with its claims: a source that repeats a value is named once, as ``A x3``.  ``sources`` holds a
    struct for each of these, ``conflicting_values`` every canonical value of a conflict, both in the order of the first claim.
    Evidence ids are one for each claim, so they stay long: :func:`supporting_evidence`, or :func:`with_evidence_ids` for lists."""
    said = source_statements(claims, fold_milliamps, known)
    name = F.when(F.col("n_claims") > 1, F.concat("source_name", F.lit(" x"), F.col("n_claims").cast("string"))).otherwise(F.col("source_name"))
    entry = F.struct("first_ord", "source_name", name.alias("shown"), "raw", "canonical", "n_claims")
    per_value = said.groupBy(*KEYS, "canonical").agg(F.array_sort(F.collect_list(entry)).alias("by"), F.sum("n_claims").alias("n"))
    per_value = per_value.select(*KEYS, F.struct(F.col("by")[0]["first_ord"].alias("at"), "canonical", "by",
                                                 F.array_join(F.transform("by", lambda s: s["shown"]), ", ").alias("who")).alias("part"), "n")
    d = per_value.groupBy(*KEYS).agg(F.sum("n").alias("n_claims"), F.count("*").alias("n_values"), F.array_sort(F.collect_list("part")).alias("parts"))
    attr = F.concat(F.lit("'"), F.col("attribute"), F.lit("'"))
    first = F.col("parts")[0]
    one = F.concat(F.lit("Single source '"), first["who"], F.lit("' supports "), attr, F.lit(" with value '"),
                   F.coalesce(first["by"][0]["raw"], F.lit("None")), F.lit("'."))
    agree = F.concat(F.lit("Value '"), first["canonical"], F.lit("' consistently verified across "), F.size(first["by"]).cast("string"),
                     F.lit(" sources ("), first["who"], F.lit(")."))
    clash = F.concat(F.lit("Conflicting values detected for "), attr, F.lit(" across sources: "),
                     F.array_join(F.transform("parts", lambda p: F.concat(F.lit("'"), p["canonical"], F.lit("' ("), p["who"], F.lit(")"))), " vs "), F.lit("."))
    conflict = F.col("n_values") > 1
    every = F.array_sort(F.flatten(F.transform("parts", lambda p: p["by"])))
    return d.select(
        *KEYS, conflict.alias("is_conflict"),
        F.when(conflict, "CONFLICT").otherwise("PASSED").alias("status"),
        F.when(conflict, "HIGH").otherwise("LOW").alias("severity"),
        "n_claims", "n_values",
        F.when(F.col("n_claims") == 1, one).when(conflict, clash).otherwise(agree).alias("message"),
        F.transform(every, lambda s: F.struct(s["source_name"].alias("source_name"), s["raw"].alias("raw_value"), s["canonical"].alias("normalized_value"),
                                              s["n_claims"].alias("n_claims"))).alias("sources"),
        F.when(conflict, F.transform("parts", lambda p: p["canonical"])).otherwise(F.array().cast("array<string>")).alias("conflicting_values"))


def with_evidence_ids(compared: DataFrame, claims: DataFrame) -> DataFrame:
    """Adds ``evidence_ids``: each id behind an attribute once, in the order of the first claim; an empty list without any."""
    ids = gathered(supporting_evidence(claims), KEYS, ["first_ord", "evidence_id"], F.col("evidence_id"), "evidence_ids")
    return compared.join(ids, KEYS, "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))


def listed(found: DataFrame, product_id=None, status: str | None = None) -> DataFrame:
    out = found if product_id is None else found.filter(F.col("product_id") == F.lit(product_id))
    return out if status is None else out.filter(F.col("status") == status.upper())
