"""Attribute facts mined from product text.

Each miner is an array-of-struct expression over the whole text; the arrays are
concatenated and exploded once, so one narrow pass yields every fact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import vocab
from shelfmark.functions.text import null_if_blank, strip
from shelfmark.functions.units import normalize_measure, with_norm
from shelfmark.operators.classify import detect_type

FROM_TEXT = "INPUT_DESCRIPTION"
FROM_FIELD = "INPUT_FIELD"

# A number may be mixed (4-1/2), a fraction, a decimal (also .045) or whole.
NUM = r"(?:\d+-\d+/\d+|\d+/\d+|\d*\.\d+|\d+)"
BY = r"\s*[xX×]\s*"
CHAIN = rf"""({NUM})\s*["″]?{BY}({NUM})\s*["″]?\s*[-']?(?:\d+\s*["″]?)?(?:{BY}({NUM}))?"""
FEET_BY_INCHES = rf"""({NUM})\s*['′]{BY}({NUM})\s*["'″]?"""
LUMBER = rf"""({NUM}){BY}({NUM})\s*[-']?\d*\s*['′]"""
CROSS = rf"""\b({NUM}){BY}({NUM})\b(?!\s*(?:pc|pack|box|disc))"""
INCH = rf"""\b({NUM})\s*["″]\b"""
FEET = rf"""\b({NUM})\s*['′]\b"""
# What a text holds that a pattern can match in: the dear patterns read no others.
HAS_BY, HAS_INCH, HAS_FOOT = r"[xX×]\s*[0-9.]", '["″]', "['′]"


def fact(name, value: Column, source: str = FROM_TEXT) -> Column:
    return F.struct((name if isinstance(name, Column) else F.lit(name)).alias("attribute"),
                    strip(value).alias("value"), F.lit(source).alias("source"))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def all_hits(name: str, text: Column, pattern: str, group: int = 0) -> Column:
    return F.transform(_matches(text, pattern, group), lambda v: fact(name, v))


def flag_hits(text: Column, table) -> Column:
    """One fact for each (pattern, value, attribute) whose pattern occurs."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), fact(attr, F.lit(value))) for p, value, attr in table]))


def _shaped(text: Column, pattern: str, groups: int, build, needs: str) -> Column:
    """Facts built from each match's groups; matches that look like grit are skipped."""
    text = F.when(~text.rlike(needs), "").otherwise(text)
    zipped = F.arrays_zip(*[_matches(text, f"(?i){pattern}", g).alias(f"g{g}") for g in range(groups + 1)])
    usable = F.filter(zipped, lambda m: ~m["g0"].rlike(r"(?i)P\d+"))
    return F.flatten(F.transform(usable, build))


def dimension_facts(text: Column, part_number: Column) -> Column:
    inch, foot = F.lit('"'), F.lit("'")

    def chain(m):
        pair = F.array(fact("width", F.concat(m["g1"], inch)), fact("length", F.concat(m["g2"], inch)),
                       fact("dimensions", m["g0"]))
        triple = F.array(fact("width", F.concat(m["g1"], inch)), fact("thickness", m["g2"]),
                         fact("diameter", F.concat(m["g3"], inch)), fact("dimensions", m["g0"]))
        return F.when(m["g3"] == "", pair).otherwise(triple)

    def feet_by_inches(m):
        return F.array(fact("length", F.concat(m["g1"], foot)), fact("width", F.concat(m["g2"], inch)),
                       fact("dimensions", m["g0"]))

    def lumber(m):
        return F.array(fact("size", m["g0"]), fact("length", F.element_at(F.split(m["g0"], "x"), -1)))

    first_three = F.substring(F.split(F.coalesce(part_number, F.lit("")), " ")[0], 1, 3)

    def cross(m):
        from_part = ((F.position(m["g0"], text) <= 5) & (first_three != "")
                     & F.startswith(F.replace(m["g0"], F.lit(" "), F.lit("")), first_three))
        some = F.array(fact("size", m["g0"]), fact("width", m["g1"]), fact("height", m["g2"]))
        return F.when(F.coalesce(from_part, F.lit(False)), F.filter(some, lambda _: F.lit(False))).otherwise(some)

    return F.concat(
        _shaped(text, CHAIN, 3, chain, HAS_BY),
        _shaped(text, FEET_BY_INCHES, 2, feet_by_inches, HAS_BY),
        _shaped(text, LUMBER, 2, lumber, HAS_BY),
        _shaped(text, CROSS, 2, cross, HAS_BY),
        _shaped(text, INCH, 1, lambda m: F.array(fact("diameter", m["g0"]), fact("thickness", m["g0"])), HAS_INCH),
        _shaped(text, FEET, 1, lambda m: F.array(fact("length", m["g0"])), HAS_FOOT),
    )


def quantity_facts(text: Column) -> Column:
    return F.concat(*[all_hits("quantity", text, p) for p in vocab.QUANTITIES])


def label_facts(text: Column) -> Column:
    return F.concat(all_hits("grit", text, vocab.GRIT), all_hits("series", text, vocab.SERIES, 1),
                    all_hits("model", text, vocab.MODEL, 1))


def physical_facts(text: Column) -> Column:
    return F.concat(*[all_hits(name, text, p) for name, p in vocab.PHYSICAL_PATTERNS])


def material_facts(text: Column) -> Column:
    return flag_hits(text, [(p, v, "material") for p, v in vocab.MATERIALS])


def colour_finish_facts(text: Column) -> Column:
    return flag_hits(text, vocab.COLOURS_FINISHES)


def application_facts(text: Column) -> Column:
    return flag_hits(text, [(p, v, "application") for p, v in vocab.APPLICATIONS])


def connection_facts(text: Column) -> Column:
    return flag_hits(text, [(p, v, "connection") for p, v in vocab.CONNECTIONS])


def mounting_facts(text: Column) -> Column:
    phrase = null_if_blank(F.regexp_extract(text, vocab.MOUNT_PHRASE, 1))
    return F.array_compact(F.array(F.when(phrase.isNotNull(), fact("mounting", F.initcap(phrase)))))


def type_facts(text: Column, patterns) -> Column:
    name = detect_type(text, patterns)["candidate_type"]
    return F.array_compact(F.array(F.when(name.isNotNull(), fact("product_type", name))))


def field_facts(name: str, value: Column) -> Column:
    return F.array_compact(F.array(F.when(strip(value) != "", fact(name, value, FROM_FIELD))))


def text_brand_facts(candidate: Column) -> Column:
    return F.when(candidate.isNotNull(), F.array(fact("candidate_brand", candidate), fact("brand", candidate))).otherwise(
        F.filter(F.array(fact("brand", F.lit(""))), lambda _: F.lit(False)))


def model_prefix_facts(description: Column, part_number: Column) -> Column:
    starts = (part_number != "") & F.startswith(F.upper(description), F.upper(part_number))
    return F.array_compact(F.array(F.when(starts, fact("model", part_number, FROM_FIELD))))


def mined_text(part_number: Column, description: Column) -> Column:
    return strip(F.concat(F.coalesce(part_number, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))


def explode_facts(df: DataFrame, key: str, facts: Column) -> DataFrame:
    """Long rows ``(key, ord, attribute, value, source)`` from an array of facts.

    A catalog is a small file that one or two tasks read, and mining is what takes the time: rows are dealt out by key first,
    which :func:`dedupe_facts` then groups by without another shuffle."""
    long = df.repartition(key).select(key, F.posexplode(facts).alias("ord", "f"))
    return long.select(key, "ord", "f.attribute", "f.value", "f.source").filter(F.col("value") != "")


def dedupe_facts(facts: DataFrame, key: str = "product_id") -> DataFrame:
    """First of repeated (attribute, value ignoring case); combines before the shuffle."""
    first = F.min(F.struct("ord", "value", "source"))
    return (facts.groupBy(key, "attribute", F.lower("value").alias("same")).agg(first.alias("f"))
            .select(key, F.col("f.ord").alias("ord"), "attribute", F.col("f.value").alias("value"),
                    F.col("f.source").alias("source")))


def extract_facts(feed: DataFrame, types, key: str = "product_id", candidate: str | None = None) -> DataFrame:
    """All facts of a feed with ``part_number, description, brand`` columns."""
    t, pn, desc = F.col("x_text"), F.col("part_number"), F.col("description")
    d = feed.withColumn("x_text", mined_text(pn, desc))
    miners = [dimension_facts(t, pn), quantity_facts(t), label_facts(t), physical_facts(t), material_facts(t),
              colour_finish_facts(t), application_facts(t), connection_facts(t), mounting_facts(t),
              type_facts(t, types), field_facts("source_brand", F.col("brand"))]
    if candidate:
        miners.append(text_brand_facts(F.col(candidate)))
    miners.append(model_prefix_facts(desc, pn))
    return dedupe_facts(explode_facts(d, key, F.concat(*miners)), key)


def with_measures(facts: DataFrame) -> DataFrame:
    """Adds the normalised measure of each dimension fact; counts stay as typed."""
    measured = F.when(F.col("attribute") == "quantity", strip(F.col("value"))).otherwise(normalize_measure(F.col("value")))
    return facts.withColumn("measure", measured)


def evidence_value(text: Column, attribute: Column) -> Column:
    """First pattern of the attribute (then of its last name part) that hits."""
    out = None
    for name, patterns in vocab.EVIDENCE_PATTERNS.items():
        tail = name.rsplit("_", 1)[-1]
        tried = list(patterns) + (list(vocab.EVIDENCE_PATTERNS.get(tail, ())) if tail != name else [])
        hit = F.coalesce(*[null_if_blank(strip(F.regexp_extract(text, p, 0))) for p in tried])
        out = F.when(attribute == name, hit) if out is None else out.when(attribute == name, hit)
    materials = F.coalesce(*[F.when(text.rlike(p), v) for p, v in vocab.MATERIALS])
    return out.when(attribute == "material", materials)


KEYWORD_SPECS = (  # attribute, phrases, value, confidence, status
    ("voltage", ("400 v", "400v", "400 volt"), "400 V AC", 0.98, "VERIFIED"),
    ("current", ("12 a",), "12 A", 0.65, "CONFLICT"),
    ("current", ("10 a", "10 amp"), "10 A", 0.98, "VERIFIED"),
    ("frequency", ("50/60 hz", "50 - 60 hz", "50 - 60 hertz"), "50/60 Hz", 0.99, "VERIFIED"),
)


def keyword_specs(df: DataFrame, key: str, text: str, specs=KEYWORD_SPECS) -> DataFrame:
    """Fixed specs announced by phrases; the first listed phrase set of an attribute wins."""
    low = F.lower(F.col(text))
    cells = []
    for name in dict.fromkeys(s[0] for s in specs):
        cell = None
        for _, phrases, value, conf, status in [s for s in specs if s[0] == name]:
            seen = reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])
            row = F.struct(F.lit(name).alias("attribute"), F.lit(value).alias("value"),
                           F.lit(conf).alias("confidence"), F.lit(status).alias("status"))
            cell = F.when(seen, row) if cell is None else cell.when(seen, row)
        cells.append(cell)
    long = df.select(key, F.explode(F.array_compact(F.array(*cells))).alias("s")).select(key, "s.*")
    return with_norm(long)


def ground(extracted: DataFrame, retrieved: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Keep only citations that were retrieved and score them by similarity.

    ``extracted(product_id, attribute, value, status, evidence_ids)``,
    ``retrieved(product_id, evidence_id, similarity, rank)``."""
    cited = extracted.select("product_id", "attribute", F.explode("evidence_ids").alias("evidence_id")).distinct()
    support = (cited.join(retrieved, ["product_id", "evidence_id"]).groupBy("product_id", "attribute")
               .agg(F.avg("similarity").alias("avg_sim"), F.count("*").alias("n_valid")))
    top = retrieved.groupBy("product_id").agg(F.min_by("evidence_id", "rank").alias("top_id"))
    d = extracted.join(support, ["product_id", "attribute"], "left").join(top, "product_id", "left")
    d = with_norm(d, known=known)
    status = F.upper("status")
    taken = (status == "EXTRACTED") & F.col("value").isNotNull()
    backed = taken & (F.col("n_valid") > 0)
    doubtful = status.isin("REQUIRES_REVIEW", "UNVERIFIED")
    known = taken | doubtful
    sim = F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.5), F.round("avg_sim", 8))), 2)
    final = (F.when(backed & ~F.col("norm.requires_review"), "VERIFIED").when(known, "REQUIRES_REVIEW").otherwise("UNKNOWN"))
    return d.select(
        "product_id", "attribute",
        F.when(known, F.col("value")).alias("value"),
        F.when(known, F.col("norm.normalized_value")).alias("normalized_value"),
        F.when(known, F.col("norm.unit")).alias("unit"),
        F.when(backed, sim).when(taken, 0.4).when(doubtful, 0.5).otherwise(0.0).alias("confidence"),
        final.alias("status"),
        F.when(known, F.coalesce("n_valid", F.lit(0))).otherwise(0).alias("n_valid"),
        F.when(taken & ~F.coalesce(backed, F.lit(False)), F.col("top_id")).alias("fallback_evidence_id"),
    )


def without_evidence(products: DataFrame, evidence: DataFrame, attributes=vocab.REPORTED_ATTRIBUTES) -> DataFrame:
    """Every reported attribute as UNKNOWN for products with no evidence at all."""
    bare = products.select("product_id").join(evidence.select("product_id"), "product_id", "left_anti")
    return bare.select("product_id", F.explode(F.array(*[F.lit(a) for a in attributes])).alias("attribute"),
                       F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"),
                       F.lit("UNKNOWN").alias("status"))


def evidence_block(evidence_id: Column, document: Column, page: Column, index: Column, similarity: Column,
                   text: Column) -> Column:
    """One retrieved passage as a readable block."""
    where = F.coalesce(F.concat(F.lit("Page "), page.cast("string")), F.lit("Page N/A"))
    return F.concat(
        F.lit("[Evidence ID: "), evidence_id.cast("string"), F.lit("]\nDocument: "), document, F.lit(" ("), where,
        F.lit(", Chunk #"), index.cast("string"), F.lit(")\nSimilarity Score: "),
        F.format_string("%.4f", similarity), F.lit("\nContent:\n"), strip(text), F.lit("\n"))


def evidence_text(top: DataFrame, key: str) -> DataFrame:
    """Blocks of a top-k result joined per key in rank order (k rows per key)."""
    block = evidence_block(*[F.col(c) for c in ("evidence_id", "document_name", "page_number", "chunk_index", "score", "text")])
    ranked = F.sort_array(F.collect_list(F.struct("rank", block.alias("block"))))
    return top.groupBy(key).agg(F.array_join(F.transform(ranked, lambda b: b["block"]), "\n\n").alias("evidence_text"))


def taxonomy_attributes(df: DataFrame, key: str = "product_id", tax: str = "tax") -> DataFrame:
    """Taxonomy fields as verified attribute rows."""
    fields = (("Dept", "dept"), ("Class_name", "class_name"), ("Fine", "fine"), ("Classpath", "classpath"),
              ("Confidence", "confidence"), ("Status", "status"))
    rows = F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(f"{tax}.{f}").cast("string").alias("value")) for n, f in fields])
    return df.select(key, F.explode(rows).alias("r")).select(
        key, "r.*", F.lit("").alias("unit"), F.lit(0.9).alias("confidence"), F.lit("VERIFIED").alias("status"))
