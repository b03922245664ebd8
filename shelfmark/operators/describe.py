"""Six product descriptions built from facts, never invented.

Each product's attributes are reduced to what a description can hold before they
are gathered: named specs by conditional aggregation, free lists by top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import vocab
from shelfmark.functions.text import is_valid_text, null_if_blank, squeeze, strip, title_case

# Every listed spec takes at least six characters ("a: b, ") of a 1000 character text.
LONG_TEXT_SPECS = vocab.DESCRIPTION_LIMITS["long"] // 6 + 1
NAMED = vocab.KEY_SPECS + ("product_type", "candidate_type", "efficiency", "protection", "certification")


def valid_or_null(c: Column) -> Column:
    return F.when(is_valid_text(c), c)


def shown_value(value: Column, normalized: Column, unit: Column) -> Column:
    """Normalised value with its unit once; null when unusable."""
    v = strip(F.coalesce(normalized, value))
    with_unit = F.when((unit != "") & ~v.endswith(unit), F.concat(v, F.lit(" "), unit)).otherwise(v)
    return F.when(is_valid_text(v), with_unit)


def _with_shown(attributes: DataFrame) -> DataFrame:
    return attributes.withColumn("lname", F.lower("name")).withColumn(
        "shown", shown_value(F.col("value"), F.col("normalized_value"), F.col("unit")))


def key_specs(attributes: DataFrame) -> DataFrame:
    """Ordered distinct specs ``(product_id, spec_rank, spec)``; other attributes where none is named."""
    a = _with_shown(attributes).filter(F.col("shown").isNotNull())
    place = F.array_position(F.array(*[F.lit(k) for k in vocab.KEY_SPECS]), F.col("lname"))
    named = a.filter(F.col("lname").isin(*vocab.KEY_SPECS)).select("product_id", place.alias("prio"), "shown")
    others = (a.filter(~F.col("lname").isin(*vocab.KEY_SPECS, *vocab.SPEC_FALLBACK_SKIP))
              .join(named.select("product_id"), "product_id", "left_anti")
              .select("product_id", F.col("attr_ord").cast("bigint").alias("prio"), "shown"))
    distinct = named.unionByName(others).groupBy("product_id", F.col("shown").alias("spec")).agg(F.min("prio").alias("prio"))
    w = Window.partitionBy("product_id").orderBy("prio", "spec")
    return distinct.select("product_id", F.row_number().over(w).alias("spec_rank"), "spec")


def category_text(product_type: Column, fine: Column, category: Column) -> Column:
    """Product type, else fine class, else the last step of the category path."""
    placed = F.when(F.lower(fine) != "unclassified", valid_or_null(fine))
    path = F.when(F.lower(category) != "unclassified", valid_or_null(category))
    last = F.when(path.contains(">"), strip(F.element_at(F.split(path, ">"), -1))).otherwise(path)
    return F.coalesce(valid_or_null(product_type), null_if_blank(placed), last, F.lit(""))


def description_inputs(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row per product with the named specs, first two key specs and long list."""
    a = _with_shown(attributes)
    type_text = F.coalesce("normalized_value", "value")
    cells = [F.max(F.when(F.col("lname") == n, F.col("shown"))).alias(f"s_{n}") for n in ("efficiency", "protection", "certification")]
    cells += [F.max(F.when(F.col("lname") == n, type_text)).alias(f"s_{n}") for n in ("product_type", "candidate_type")]
    named = a.filter(F.col("lname").isin("efficiency", "protection", "certification", "product_type", "candidate_type")
                     ).groupBy("product_id").agg(*cells)
    two = key_specs(attributes).filter(F.col("spec_rank") <= 2).groupBy("product_id").agg(
        F.max(F.when(F.col("spec_rank") == 1, F.col("spec"))).alias("spec1"),
        F.max(F.when(F.col("spec_rank") == 2, F.col("spec"))).alias("spec2"))
    w = Window.partitionBy("product_id").orderBy("attr_ord", "name")
    listed = (a.filter(F.col("shown").isNotNull() & ~F.col("lname").isin(*vocab.LONG_TEXT_SKIP))
              .withColumn("n", F.row_number().over(w)).filter(F.col("n") <= LONG_TEXT_SPECS))
    line = F.concat(title_case(F.replace("name", F.lit("_"), F.lit(" "))), F.lit(": "), "shown")
    lines = listed.groupBy("product_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("n", line.alias("t")))), lambda x: x["t"]), ", ").alias("spec_lines"))
    d = products.join(named, "product_id", "left").join(two, "product_id", "left").join(lines, "product_id", "left")
    kind = F.coalesce("s_product_type", "s_candidate_type")
    fine = F.col("taxonomy_fine") if "taxonomy_fine" in products.columns else F.lit(None).cast("string")
    return (d.withColumn("d_brand", F.coalesce(valid_or_null(F.col("brand")), F.lit("")))
            .withColumn("d_mpn", F.coalesce(valid_or_null(F.col("part_number")), F.lit("")))
            .withColumn("d_raw", F.coalesce("description", F.lit("")))
            .withColumn("d_cat", category_text(kind, fine, F.col("category"))))


def _joined(sep: str, *cols) -> Column:
    return F.array_join(F.array_compact(F.array(*[valid_or_null(c) for c in cols])), sep)


def short_text() -> Column:
    parts = F.array_compact(F.array(*[valid_or_null(F.col(c)) for c in ("d_brand", "d_mpn", "d_cat")]))
    for spec in ("spec1", "spec2"):
        s = F.col(spec)
        repeated = F.array_contains(F.transform(parts, F.lower), F.lower(s))
        parts = F.when(s.isNotNull() & ~repeated, F.concat(parts, F.array(s))).otherwise(parts)
    raw = F.when(is_valid_text(F.col("d_raw")), F.left("d_raw", F.lit(120))).otherwise("")
    return F.left(F.when(F.size(parts) > 0, strip(F.array_join(parts, " - "))).otherwise(raw), F.lit(120))


def long_text() -> Column:
    base = _joined(" ", F.col("d_brand"), F.col("d_mpn"))
    cat = is_valid_text(F.col("d_cat"))
    intro = (F.when(cat & (base != ""), F.concat(base, F.lit(" is a "), "d_cat", F.lit(".")))
             .when(cat, F.concat("d_cat", F.lit("."))).when(base != "", F.concat(base, F.lit("."))).otherwise(""))
    specs = F.when(F.col("spec_lines") != "", F.concat(F.lit("Specifications: "), "spec_lines", F.lit("."))).otherwise("")
    text = strip(F.concat_ws(" ", null_if_blank(intro), null_if_blank(specs)))
    raw = F.when(is_valid_text(F.col("d_raw")), F.col("d_raw")).otherwise("")
    return F.left(F.when(text != "", text).otherwise(raw), F.lit(1000))


def invoice_text() -> Column:
    parts = F.upper(strip(_joined(" ", F.col("d_brand"), F.col("d_mpn"), F.split("d_cat", " ")[0])))
    raw = F.when(is_valid_text(F.col("d_raw")), F.upper(F.left("d_raw", F.lit(60)))).otherwise("")
    return F.left(squeeze(F.when(parts != "", parts).otherwise(raw)), F.lit(60))


def mobile_text(short: Column) -> Column:
    parts = strip(_joined(" ", F.col("d_brand"), F.col("d_mpn"), F.col("d_cat")))
    return F.left(F.when(parts != "", parts).otherwise(short), F.lit(80))


def retail_text(long: Column) -> Column:
    good = (F.length("d_raw") > 10) & is_valid_text(F.col("d_raw"))
    return F.left(F.when(good, strip(squeeze(F.col("d_raw")))).otherwise(long), F.lit(500))


def marketing_text(retail: Column) -> Column:
    claims = (("High efficiency (", "s_efficiency"), ("Rugged design (", "s_protection"), ("Certified (", "s_certification"))
    features = F.array_compact(F.array(*[F.concat(F.lit(lead), F.col(c), F.lit(")")) for lead, c in claims]))
    tail = F.when(F.size(features) > 0, F.concat(F.lit(" Features include: "), F.array_join(features, ", "), F.lit("."))).otherwise("")
    subject = strip(F.concat("d_brand", F.lit(" "), "d_mpn"))
    use = F.when(F.col("d_cat") != "", F.lower("d_cat")).otherwise("industrial and commercial")
    lead = F.concat(F.lit("The "), subject, F.lit(" delivers reliable performance for "), use, F.lit(" applications. "))
    return F.left(strip(squeeze(F.concat(F.when(subject != "", lead).otherwise(""), retail, tail))), F.lit(800))


DESCRIPTIONS = ("desc_short", "desc_long", "desc_invoice", "desc_mobile", "desc_retail", "desc_marketing")


def describe(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """Products with all six descriptions."""
    d = description_inputs(products, attributes)
    d = d.withColumn("desc_short", short_text()).withColumn("desc_long", long_text()).withColumn("desc_invoice", invoice_text())
    d = d.withColumn("desc_mobile", mobile_text(F.col("desc_short"))).withColumn("desc_retail", retail_text(F.col("desc_long")))
    d = d.withColumn("desc_marketing", marketing_text(F.col("desc_retail")))
    return d.select(*[c for c in products.columns if c not in DESCRIPTIONS], *DESCRIPTIONS)


def check_descriptions(described: DataFrame) -> DataFrame:
    """Adds one boolean per description and ``all_passed``."""
    def ok(name: str) -> Column:
        c = F.col(f"desc_{name}")
        return (F.length(c) <= vocab.DESCRIPTION_LIMITS[name]) & is_valid_text(c)

    inv = F.col("desc_invoice")
    loud = (F.upper(inv) == inv) & (F.upper(inv) != F.lower(inv))
    d = described
    for name in ("short", "long", "mobile", "retail", "marketing"):
        d = d.withColumn(f"ok_{name}", ok(name))
    d = d.withColumn("ok_invoice", (F.length(inv) <= 60) & (loud | (inv == "")))
    names = ("short", "long", "invoice", "mobile", "retail", "marketing")
    every = F.lit(True)
    for n in names:
        every = every & F.col(f"ok_{n}")
    return d.withColumn("all_passed", every)


def description_issues(text: Column, brand: Column, mpn: Column) -> Column:
    """Array of problems found in one description."""
    low = F.lower(F.coalesce(text, F.lit("")))
    b, m = F.lower(F.coalesce(brand, F.lit(""))), F.lower(F.coalesce(mpn, F.lit("")))
    times = F.try_divide(F.length(low) - F.length(F.replace(low, b, F.lit(""))), F.length(b))
    repeated = (b != "") & (m != "") & low.contains(b) & low.contains(m) & (times > 2)
    return F.array_compact(F.array(
        F.when(strip(low) == "", "empty"),
        *[F.when(low.rlike(rf"\b{w}\b"), f"contains_{w}") for w in ("none", "unclassified", "unknown")],
        F.when(repeated, "duplicate_brand")))
