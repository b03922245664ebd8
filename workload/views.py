"""Catalog-shaped views over the given tables.

``feed`` comes from ``part``, ``claims`` from ``lineitem``, ``decisions`` from
``events``, ``chunks`` from ``documents``.  Spellings vary by integer arithmetic on
keys; every row of a table is kept.  ``workload.sql_views`` says the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_BRANDS = 25
N_MAKERS = 40

TAX_RULES = [
    {"keywords": ["bolt", "fastener"], "desc_keywords": ["bolt", "hex bolt"], "dept": "Hardware", "class_name": "Fasteners", "fine": "Bolts"},
    {"keywords": ["gear"], "desc_keywords": ["gear", "gizmo"], "dept": "Hardware", "class_name": "Machine Parts", "fine": "Gears"},
    {"keywords": ["plate"], "desc_keywords": ["plate"], "dept": "Hardware", "class_name": "Plates", "fine": "Mounting Plates"},
    {"keywords": ["ring", "rod"], "desc_keywords": ["ring", "rod", "hot", "cold"], "dept": "Hardware", "class_name": "Stock", "fine": "Rods & Rings"},
    {"keywords": ["anvil"], "desc_keywords": ["anvil"], "dept": "Tools", "class_name": "Forging", "fine": "Anvils"},
    {"keywords": ["large", "promo"], "desc_keywords": ["large"], "dept": "General", "class_name": "Large Goods", "fine": "Large Goods"},
]

TYPE_PATTERNS = [
    (r"\bbolt\b", "Bolt", 0.9), (r"\bgear\b", "Gear", 0.9), (r"\bplate\b", "Plate", 0.85), (r"\banvil\b", "Anvil", 0.95),
    (r"\b(?:hot|cold)\s+rod\b", "Rod Stock", 0.93), (r"\brod\b", "Rod", 0.8), (r"\bring\b", "Ring", 0.82), (r"\bgizmo\b", "Gizmo", 0.8),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


FEED_SQL = {
    "product_id": "p_partkey",
    "part_number": """CASE p_partkey % 97 WHEN 0 THEN 'N/A' WHEN 1 THEN '' ELSE
        CASE p_partkey % 4 WHEN 0 THEN concat('  PN-', CAST(p_partkey AS STRING), ' ') WHEN 1 THEN concat('PN  ', CAST(p_partkey AS STRING))
        ELSE concat('PN-', CAST(p_partkey AS STRING)) END END""",
    "variant": """CASE p_partkey % 8 WHEN 0 THEN '-- Unbranded --' WHEN 1 THEN upper(p_brand) WHEN 2 THEN concat(p_brand, ' Inc.')
        WHEN 3 THEN concat(p_brand, ' (B', substring(p_brand, 7, 2), ')') WHEN 4 THEN concat('  ', p_brand, '  Ltd ')
        WHEN 5 THEN substring(p_brand, 1, 5) WHEN 6 THEN concat('ZETA ', p_type) ELSE p_brand END""",
    "manufacturer": """CASE p_partkey % 9 WHEN 0 THEN concat('Maker ', CAST(p_partkey % 40 AS STRING))
        WHEN 1 THEN concat('MAKER ', CAST(p_partkey % 40 AS STRING), ' LLC.') WHEN 2 THEN concat('Mkr (m', CAST(p_partkey % 40 AS STRING), ')')
        WHEN 3 THEN concat('maker ', CAST(p_partkey % 40 AS STRING), ' works intl') WHEN 4 THEN 'Make'
        WHEN 5 THEN '--' WHEN 6 THEN 'O''NEIL&SONS TOOLS' WHEN 7 THEN NULL ELSE concat('Unknown*Maker ', p_type) END""",
    "category": """CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN concat(' ', p_type, '   goods ')
        WHEN 3 THEN 'Hardware > Fasteners' ELSE 'Gear' END""",
    "description": """CASE p_partkey % 7
        WHEN 0 THEN concat(p_name, ' ', CAST(p_size AS STRING), ' V AC ', CAST(p_size % 12 + 1 AS STRING), ' A 50/60 Hz stainless steel indoor')
        WHEN 1 THEN concat(p_name, ' ', CAST(p_size AS STRING), ' x ', CAST(p_size + 3 AS STRING), ' in 10 pack  black ', p_brand)
        WHEN 2 THEN concat(p_name, ' ', CAST(p_size * 10 AS STRING), ' watts ', CAST(p_size AS STRING), ' lbs wall mount P', CAST(p_size * 4 AS STRING))
        WHEN 3 THEN concat(p_name, ' ', CAST(p_size AS STRING), '-1/2" x ', CAST(p_size AS STRING), '" brass 2-pole case of 12')
        WHEN 4 THEN concat('PN-', CAST(p_partkey AS STRING), ' ', p_name, ' ', CAST(p_size AS STRING), ' mm arbor ', CAST(p_size AS STRING), ' psi outdoor white 0.5 in')
        WHEN 5 THEN concat(upper(p_name), ' MODEL #X', CAST(p_partkey AS STRING), ' series ', CAST(p_size AS STRING), ' 24 VDC 24 vdc 3 poles ', lower(p_brand), ' 0.75 kW')
        ELSE concat(' ', p_name, ' ', p_type, '   switch  400 V 12 A unknown ') END""",
}


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """Raw dirty catalog rows, one per part."""
    return feed_rows(table(spark, sf, "part"))


def feed_rows(p: DataFrame) -> DataFrame:
    place = [x for x in ("feed_file", "feed_row") if x in p.columns]
    d = p.select(*[F.expr(sql).alias(name) for name, sql in FEED_SQL.items()], "p_type", *place)
    return d.select(
        *place,
        "product_id", "part_number", "manufacturer", "category", "description",
        F.expr("CASE WHEN product_id % 3 = 0 THEN '-- No Brand --' ELSE variant END").alias("E1_Brand"),
        F.expr("CASE WHEN product_id % 6 = 0 THEN 'n/a' WHEN product_id % 2 = 0 THEN '' ELSE variant END").alias("Unilog_Brand"),
        F.col("variant").alias("DIB_Brand"), F.col("variant").alias("brand"))


def brand_master(spark: SparkSession) -> DataFrame:
    """The 25 brand names of the part table's domain (a constant, not data)."""
    return spark.range(1, N_BRANDS + 1).select(
        F.col("id").alias("ord"), F.concat(F.lit("brand#"), F.col("id").cast("string")).alias("key"),
        F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("canonical"))


def maker_master(spark: SparkSession) -> DataFrame:
    return spark.range(0, N_MAKERS).select(
        F.col("id").alias("ord"), F.concat(F.lit("maker "), F.col("id").cast("string")).alias("key"),
        F.concat(F.lit("Maker "), F.col("id").cast("string")).alias("canonical"), F.concat(F.lit("M"), F.col("id").cast("string")).alias("code"))


QTY = "CAST(CAST(l_quantity AS INT) AS STRING)"
CLAIM_SQL = {
    "product_id": "l_partkey",
    "attribute": """CASE l_linenumber WHEN 1 THEN 'voltage' WHEN 2 THEN 'current' WHEN 3 THEN 'frequency' WHEN 4 THEN 'dimensions'
        WHEN 5 THEN 'poles' WHEN 6 THEN 'power' ELSE 'material' END""",
    "value": f"""CASE WHEN l_returnflag = 'R' AND l_suppkey % 11 = 0 THEN 'UNKNOWN' ELSE CASE l_linenumber
        WHEN 1 THEN CASE l_suppkey % 4 WHEN 0 THEN concat({QTY}, 'V') WHEN 1 THEN concat({QTY}, ' volts')
            WHEN 2 THEN concat('0.', lpad({QTY}, 3, '0'), ' kV') ELSE concat({QTY}, ' kg') END
        WHEN 2 THEN CASE l_suppkey % 4 WHEN 0 THEN concat({QTY}, ' A') WHEN 1 THEN concat({QTY}, ' amps')
            WHEN 2 THEN concat({QTY}, '000 mA') ELSE concat({QTY}, ' - ', CAST(CAST(l_quantity AS INT) + 6 AS STRING), ' A max') END
        WHEN 3 THEN CASE l_suppkey % 4 WHEN 0 THEN '50 Hz' WHEN 1 THEN '50 to 60 Hz' WHEN 2 THEN concat({QTY}, '0 Hz') ELSE '60hertz' END
        WHEN 4 THEN CASE l_suppkey % 4 WHEN 0 THEN concat({QTY}, ' x ', {QTY}, ' x 7 mm') WHEN 1 THEN concat({QTY}, 'cm x ', {QTY}, 'cm')
            WHEN 2 THEN concat({QTY}, '-1/2" x ', {QTY}, '"') ELSE concat('approx ', {QTY}, ' mm') END
        WHEN 5 THEN CASE l_suppkey % 4 WHEN 0 THEN concat(CAST(CAST(l_quantity AS INT) % 4 + 1 AS STRING), 'P') WHEN 1 THEN concat({QTY}, ' poles')
            WHEN 2 THEN concat('-', CAST(CAST(l_quantity AS INT) % 4 AS STRING), ' pole') ELSE 'three' END
        WHEN 6 THEN CASE l_suppkey % 4 WHEN 0 THEN concat({QTY}, ' kW') WHEN 1 THEN concat({QTY}, ' horsepower')
            WHEN 2 THEN concat({QTY}, '.50 kw') ELSE 'see plate' END
        ELSE CASE l_suppkey % 4 WHEN 0 THEN 'sst' WHEN 1 THEN 'Stainless Steel' WHEN 2 THEN 'wh  bk' ELSE concat({QTY}, '.5" lt') END END END""",
    "source_name": """concat('Supplier ', CAST(l_suppkey AS STRING), CASE l_suppkey % 5 WHEN 0 THEN ' Datasheet' WHEN 1 THEN ' catalog'
        WHEN 2 THEN ' website' WHEN 3 THEN ' spec sheet' ELSE '' END)""",
    "source_type": "CASE WHEN l_suppkey % 3 = 0 THEN 'PDF' WHEN l_suppkey % 3 = 1 THEN 'INPUT_DESCRIPTION' ELSE 'WEB' END",
    "evidence_id": "concat('ev_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_', CAST(l_suppkey AS STRING), '_', CAST(l_partkey AS STRING))",
    "page_number": "CAST(l_linenumber AS INT)",
    "snippet": "concat(l_returnflag, l_linestatus)",
    "similarity": "round(CAST(1 AS DOUBLE) - l_discount - CASE WHEN l_tax > 0.04 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 2)",
    "claim_ord": "(CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 1000000 + l_suppkey",
}


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """What each supplier says about a part's attributes."""
    return table(spark, sf, "lineitem").select(*[F.expr(sql).alias(name) for name, sql in CLAIM_SQL.items()])


def norms(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised forms of the different values claimed of an attribute, written once: claims repeat few values."""
    from shelfmark.functions import units
    from shelfmark.sources.store import Staging

    return Staging(spark).keep(units.norms(claims(spark, sf)), "norms")


PRODUCT_SQL = {
    "product_id": "p_partkey",
    "part_number": "concat('PN-', CAST(p_partkey AS STRING))",
    "brand": "p_brand",
    "manufacturer": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('Maker ', CAST(p_partkey % 40 AS STRING)) END",
    "description": "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN 'unknown item' WHEN 2 THEN '' ELSE concat(p_name, '  ', p_type, ' part of none') END",
    "category": "CASE p_partkey % 4 WHEN 0 THEN concat('Hardware > ', p_type) WHEN 1 THEN 'Unclassified' ELSE p_type END",
    "taxonomy_dept": "CASE WHEN p_partkey % 3 = 0 THEN 'Unclassified' ELSE 'Hardware' END",
    "taxonomy_class": "CASE WHEN p_partkey % 3 = 0 THEN 'Unclassified' ELSE 'Stock' END",
    "taxonomy_fine": "CASE WHEN p_partkey % 3 = 0 THEN 'Unclassified' WHEN p_partkey % 3 = 1 THEN concat(p_type, ' Stock') ELSE NULL END",
    "taxonomy_classpath": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('Hardware > Stock > ', p_type) END",
    "status": "CASE p_size % 6 WHEN 0 THEN 'PUBLISHED' WHEN 1 THEN 'VERIFIED' WHEN 2 THEN 'REVIEWED' WHEN 3 THEN 'REQUIRES_REVIEW' WHEN 4 THEN 'DRAFT' ELSE 'DISCONTINUED' END",
    "overall_quality_score": "CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE CAST(p_partkey % 101 AS DOUBLE) END",
    "evidence_count": "CAST(p_size % 4 AS BIGINT)",
    "updated_at": "CAST(p_partkey % 1000 AS BIGINT)",
}


def products(spark: SparkSession, sf: str) -> DataFrame:
    """Stored product rows."""
    return table(spark, sf, "part").select(*[F.expr(sql).alias(name) for name, sql in PRODUCT_SQL.items()])


DECISION_SQL = {
    "product_id": "user_id",
    "attribute": "CASE event_id % 7 WHEN 0 THEN 'voltage' WHEN 1 THEN 'current' WHEN 2 THEN 'frequency' WHEN 3 THEN 'dimensions' WHEN 4 THEN 'poles' WHEN 5 THEN 'power' ELSE 'material' END",
    "action": "CASE event_type WHEN 'click' THEN 'ACCEPT_AI_VALUE' WHEN 'purchase' THEN 'SELECT_ALTERNATIVE' WHEN 'signup' THEN 'MARK_UNKNOWN' WHEN 'view' THEN 'DISMISS_CONFLICT' ELSE 'BOGUS' END",
    "reason": "event_type",
    "ts": "ts",
    "decision_id": "event_id",
}


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Review decisions, in event order."""
    return decision_rows(table(spark, sf, "events"))


def decision_rows(d: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return d.select(*[F.expr(sql).alias(name) for name, sql in DECISION_SQL.items()],
                    F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 9 != 0), F.concat(k, F.lit(" V"))).alias("selected_value"))


DOC_TEXT_SQL = """concat(text, chr(10), 'Rated voltage ', CAST(doc_id % 40 * 10 + 110 AS STRING), ' V AC, rated current ', CAST(doc_id % 16 + 1 AS STRING), ' A', chr(10),
    'Net weight ', CAST(doc_id % 9 + 1 AS STRING), '.5 kg, ', CAST(doc_id % 4 + 1 AS STRING), ' poles, IP', CAST(20 + doc_id % 48 AS STRING), ' stainless steel housing, efficiency 9',
    CAST(doc_id % 10 AS STRING), ' %', chr(10), 'Trip class ', CAST(doc_id % 3 * 10 AS STRING), ', DIN rail 35 mm mounting, size ', CAST(doc_id % 90 + 10 AS STRING), ' x 45 x 97 mm')"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents attached to products; the part with the document's number owns it.

    Each text is followed by three data lines, so specification searches have answers."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("document_id"), F.concat("source", F.lit(" manual.pdf")).alias("document_name"),
                    "source", F.col("doc_id").alias("product_id"), F.lit(1).alias("page_number"), F.expr(DOC_TEXT_SQL).alias("text"))


def attributes(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    """Stored attributes: the best claim of each part and attribute."""
    from shelfmark.plans.enrich import best_attributes

    best = best_attributes(claims(spark, sf), norms(spark, sf) if known is None else known)
    shaky = F.col("is_ambiguous") | (F.col("confidence") < 0.9)
    sims = best.withColumn("confidence", F.col("similarity"))
    return sims.withColumn("status", F.when(shaky, "REQUIRES_REVIEW").otherwise("VERIFIED")).drop("similarity")


def conflicts(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    """Stored conflicts; two thirds of the products had theirs settled."""
    from shelfmark.operators.claims import conflicts as find

    state = F.when(F.col("product_id") % 3 == 0, "OPEN").when(F.col("product_id") % 3 == 1, "RESOLVED").otherwise("DISMISSED")
    return find(claims(spark, sf), known=norms(spark, sf) if known is None else known).withColumn("status", state)


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    c = claims(spark, sf)
    return c.select("product_id", "attribute", "evidence_id", "source_name", F.col("source_name").alias("document_name"),
                    "source_type", "page_number", "snippet", "similarity")
