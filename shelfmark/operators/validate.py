"""Validation rules over a long attribute table.

Row rules are struct expressions evaluated side by side in one pass; table rules
(required, duplicate) are joins or aggregates.  Rules never change attributes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import vocab
from shelfmark.functions.text import contains_any, null_if_blank, strip
from shelfmark.functions.units import plain_numbers

RESULT = ["product_id", "attribute", "rule", "passed", "status", "severity", "message"]


def verdict(rule: str, passed: Column, severity, message: Column, failed_status: str = "FAILED") -> Column:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    return F.struct(
        F.lit(rule).alias("rule"), passed.alias("passed"),
        F.when(passed, "PASSED").otherwise(failed_status).alias("status"),
        F.when(passed, "LOW").otherwise(sev).alias("severity"), message.alias("message"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def numeric_rule(name: Column, value: Column) -> Column:
    numbers = plain_numbers(strip(value))
    empty, negative = F.size(numbers) == 0, F.exists(numbers, lambda n: n < 0)
    message = (F.when(empty, F.concat(F.lit("Attribute "), _quoted(name), F.lit(" value "), _quoted(value), F.lit(" contains no valid numeric value.")))
               .when(negative, F.concat(F.lit("Attribute "), _quoted(name), F.lit(" value "), _quoted(value), F.lit(" contains negative numeric value.")))
               .otherwise(F.concat(F.lit("Numeric format for "), _quoted(name), F.lit(" is valid."))))
    applies = contains_any(F.lower(name), vocab.NUMERIC_ATTRIBUTES) & value.isNotNull()
    return F.when(applies, verdict("NumericFormatCheck", ~(empty | F.coalesce(negative, F.lit(False))),
                                   F.when(empty, "MEDIUM").otherwise("HIGH"), message))


def unit_rule(name: Column, value: Column, unit: Column) -> Column:
    trailing = null_if_blank(F.lower(F.regexp_extract(strip(value), r"[0-9]\s*([a-zA-Z]+(?:\s*[a-zA-Z]+)?)$", 1)))
    given = F.coalesce(null_if_blank(F.lower(strip(unit))), trailing)
    out = None
    for kind, allowed in vocab.ALLOWED_UNITS.items():
        fine = given.isNull() | given.isin(*allowed)
        expected = ", ".join(sorted(allowed))
        message = F.when(fine, F.concat(F.lit("Unit "), _quoted(F.coalesce(given, F.lit("default"))), F.lit(" is consistent for "), _quoted(name), F.lit("."))).otherwise(
            F.concat(F.lit("Unit mismatch for "), _quoted(name), F.lit(": "), _quoted(given),
                     F.lit(f" is not a valid unit for {kind} (expected one of: {expected}).")))
        check = verdict("UnitConsistencyCheck", fine, "CRITICAL", message)
        here = F.lower(name).contains(kind)
        out = F.when(here, check) if out is None else out.when(here, check)
    return F.when(value.isNotNull(), out)


def bounds_rule(name: Column, value: Column, normalized: Column) -> Column:
    first = F.get(plain_numbers(F.coalesce(null_if_blank(normalized), value)), F.lit(0))
    out = None
    for kind, (low, high, unit) in vocab.VALUE_BOUNDS.items():
        inside = (first >= low) & (first <= high)
        text = first.cast("string")
        message = F.when(inside, F.concat(F.lit("Value "), text, F.lit(f" {unit} is within physical bounds for "), _quoted(name), F.lit("."))).otherwise(
            F.concat(F.lit("Impossible value detected: "), text,
                     F.lit(f" {unit} is outside physical bounds ({low} - {high} {unit}) for "), _quoted(name), F.lit(".")))
        check = verdict("ImpossibleValueCheck", inside, "CRITICAL", message)
        here = F.lower(name).contains(kind)
        out = F.when(here, check) if out is None else out.when(here, check)
    return F.when(value.isNotNull() & first.isNotNull(), out)


def _not_broken(check: Column) -> Column:
    """A verdict without an answer becomes a failure of its own."""
    broken = F.struct(check["rule"].alias("rule"), F.lit(False).alias("passed"), F.lit("FAILED").alias("status"), F.lit("HIGH").alias("severity"),
                      F.concat(F.lit("Rule "), check["rule"], F.lit(" could not be evaluated.")).alias("message"))
    return F.when(check.isNotNull() & check["passed"].isNull(), broken).otherwise(check)


def row_rules(attributes: DataFrame, *extra: Callable[..., Column]) -> DataFrame:
    """Numeric, unit and bounds rules (and a caller's own) in one projection.

    An own rule takes ``(name, value, normalized_value, unit)`` columns and returns
    a :func:`verdict`; a null verdict means the rule does not apply, one whose
    ``passed`` is null that it broke on the value (write it with ``try_`` forms)."""
    n, v, z, u = (F.col(c) for c in ("name", "value", "normalized_value", "unit"))
    checks = [numeric_rule(n, v), unit_rule(n, v, u), bounds_rule(n, v, z)] + [_not_broken(rule(n, v, z, u)) for rule in extra]
    long = attributes.select("product_id", n.alias("attribute"), F.explode(F.array_compact(F.array(*checks))).alias("r"))
    return long.select("product_id", "attribute", "r.*").select(*RESULT)


def required_rule(products: DataFrame, attributes: DataFrame, required=vocab.REQUIRED_ATTRIBUTES) -> DataFrame:
    """Each required attribute of each product: present or missing."""
    wanted = products.select("product_id", F.explode(F.array(*[F.lit(r) for r in required])).alias("attribute"))
    known = (F.upper(F.coalesce("status", F.lit(""))) != "UNKNOWN") & (F.col("value") != "")
    have = attributes.filter(F.col("name").isin(*required) & known).groupBy(
        "product_id", F.col("name").alias("attribute")).agg(F.min("value").alias("value"))
    d = wanted.join(have, ["product_id", "attribute"], "left")
    present = F.col("value").isNotNull()
    message = F.when(present, F.concat(F.lit("Required attribute "), _quoted(F.col("attribute")), F.lit(" is present ("), "value", F.lit(")."))).otherwise(
        F.concat(F.lit("Required attribute "), _quoted(F.col("attribute")), F.lit(" is missing or marked UNKNOWN.")))
    return d.select("product_id", "attribute", verdict("RequiredAttributesCheck", present, "HIGH", message).alias("r")).select(
        "product_id", "attribute", "r.*").select(*RESULT)


def duplicate_rule(raw_attributes: DataFrame) -> DataFrame:
    """Attributes listed more than once with differing values."""
    per_value = raw_attributes.groupBy("product_id", "name", F.col("value").cast("string").alias("value")).agg(F.count("*").alias("n"))
    clash = (per_value.groupBy("product_id", "name").agg(F.count("*").alias("n_values"))
             .filter(F.col("n_values") > 1))
    message = F.concat(F.lit("Duplicate attribute "), _quoted(F.col("name")), F.lit(" found with "),
                       F.col("n_values").cast("string"), F.lit(" conflicting values"))
    return clash.select(
        "product_id", F.col("name").alias("attribute"), F.lit("DuplicateAttributeCheck").alias("rule"),
        F.lit(False).alias("passed"), F.lit("CONFLICT").alias("status"), F.lit("HIGH").alias("severity"), message.alias("message"))


def grounded_rule(attributes: DataFrame, evidence: DataFrame, text: str = "evidence_text") -> DataFrame:
    """Does any evidence text of the product contain the value?

    ``evidence(product_id, evidence_text)`` may hold many rows per product. What is asked of a product, a few grounded attributes,
    goes to each of its texts as one list, so a text is read once and only what it holds leaves it."""
    checked = attributes.filter(F.col("name").isin(*vocab.GROUNDED_ATTRIBUTES) & (F.col("value") != "") & (F.upper("value") != "UNKNOWN"))
    wanted = checked.select("product_id", F.col("name").alias("attribute"), "value").distinct()
    asked = wanted.groupBy("product_id").agg(F.collect_list(F.struct("attribute", "value")).alias("asked"))
    held = F.filter("asked", lambda a: F.lower(text).contains(F.lower(a["value"])))
    found = evidence.join(asked, "product_id").select("product_id", F.explode(held).alias("a")).select("product_id", "a.*").distinct().withColumn("hit", F.lit(True))
    known = wanted.join(evidence.select("product_id").distinct(), "product_id", "left_semi")
    hit = known.join(found, ["product_id", "attribute", "value"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    spec = F.concat(_quoted(F.col("attribute")), F.lit(" specification "), _quoted(F.col("value")), F.lit(" is grounded in evidence."))
    missing = F.concat(F.lit("No evidence support for "), _quoted(F.col("attribute")), F.lit(" value "), _quoted(F.col("value")), F.lit("."))
    return hit.select("product_id", "attribute", verdict(
        "SemanticGroundingCheck", F.col("hit"), "MEDIUM", F.when(F.col("hit"), spec).otherwise(missing), "WARNING").alias("r")).select(
        "product_id", "attribute", "r.*").select(*RESULT)


def cross_source_results(compared: DataFrame) -> DataFrame:
    """Verdict rows from :func:`shelfmark.operators.claims.compare_sources`."""
    return compared.select("product_id", "attribute", F.lit("CrossSourceConsistencyCheck").alias("rule"),
                           (~F.col("is_conflict")).alias("passed"), "status", "severity", "message")


def all_results(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select(*RESULT) for p in parts])


def report(results: DataFrame) -> DataFrame:
    """Counts and overall status per product."""
    failed = ~F.col("passed")
    crossed = F.col("rule") == "CrossSourceConsistencyCheck"
    agg = results.groupBy("product_id").agg(
        F.count("*").alias("total_rules_checked"),
        F.count_if("passed").alias("passed_count"),
        F.count_if(failed & (F.col("status") != "CONFLICT")).alias("failed_count"),
        F.count_if(failed & crossed).alias("conflict_count"),
        F.count_if(failed & F.col("severity").isin("HIGH", "CRITICAL")).alias("severe"))
    status = (F.when((F.col("conflict_count") > 0) | (F.col("severe") > 0), "REQUIRES_REVIEW")
              .when(F.col("failed_count") > 0, "FAILED").otherwise("VERIFIED"))
    return agg.withColumn("status", status).withColumn("passed", F.col("status") == "VERIFIED").drop("severe")


def attach(results: DataFrame, attributes: DataFrame, products: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results linked to an attribute (nameless ones to the first), products sent to review."""
    first = attributes.groupBy("product_id").agg(F.min_by("name", "attr_ord").alias("first_name"))
    named = attributes.select("product_id", F.col("name").alias("attribute"), F.lit(True).alias("known"))
    linked = (results.join(named, ["product_id", "attribute"], "left").join(first, "product_id", "left")
              .withColumn("linked_attribute", F.when(F.col("known"), F.col("attribute")).otherwise(F.col("first_name")))
              .drop("known", "first_name"))
    review = reports.filter(F.col("status") == "REQUIRES_REVIEW").select("product_id", F.lit(True).alias("sent"))
    moved = products.join(review, "product_id", "left").withColumn(
        "status", F.when(F.col("sent"), "REQUIRES_REVIEW").otherwise(F.col("status"))).drop("sent")
    return linked, moved
