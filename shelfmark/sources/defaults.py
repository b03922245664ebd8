"""Small starter rule tables in the vocabulary of the sample tables. Real runs bring their own masters and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.plans.rules import rule_table

# brand spelling, canonical brand
BRANDS = [
    ("brand#11", "Brand Eleven"),
    ("brand#12", "Brand Twelve"),
    ("brand#21", "Brand Twenty-One"),
    ("brand#22", "Brand Twenty-Two"),
    ("brand#33", "Brand Thirty-Three"),
    ("brand#34", "Brand Thirty-Four"),
    ("brand#45", "Brand Forty-Five"),
    ("brand#55", "Brand Fifty-Five"),
]

# maker spelling, canonical maker, own code
MANUFACTURERS = [
    ("manufacturer#1", "Maker One", "M-001"),
    ("manufacturer#2", "Maker Two", "M-002"),
    ("manufacturer#3", "Maker Three", "M-003"),
    ("manufacturer#4", "Maker Four", "M-004"),
    ("manufacturer#5", "Maker Five", "M-005"),
]

# metals and coatings of part types, and nouns of part names
TAXONOMY = [
    {"dept": "Metals", "class_name": "Ferrous", "fine": "Steel parts", "keywords": ["steel"], "desc_keywords": ["steel"]},
    {"dept": "Metals", "class_name": "Non-ferrous", "fine": "Brass parts", "keywords": ["brass"], "desc_keywords": ["brass"]},
    {"dept": "Metals", "class_name": "Non-ferrous", "fine": "Copper parts", "keywords": ["copper"], "desc_keywords": ["copper"]},
    {"dept": "Metals", "class_name": "Non-ferrous", "fine": "Nickel parts", "keywords": ["nickel"], "desc_keywords": ["nickel"]},
    {"dept": "Metals", "class_name": "Non-ferrous", "fine": "Tin parts", "keywords": [" tin"], "desc_keywords": [" tin"]},
    {"dept": "Coatings", "class_name": "Electrolytic", "fine": "Anodised", "keywords": ["anodized"], "desc_keywords": ["anodized", "anodised"]},
    {"dept": "Coatings", "class_name": "Electrolytic", "fine": "Plated", "keywords": ["plated"], "desc_keywords": ["plated", "plating"]},
    {"dept": "Coatings", "class_name": "Mechanical", "fine": "Brushed", "keywords": ["brushed"], "desc_keywords": ["brushed"]},
    {"dept": "Coatings", "class_name": "Mechanical", "fine": "Burnished", "keywords": ["burnished"], "desc_keywords": ["burnished"]},
    {"dept": "Coatings", "class_name": "Mechanical", "fine": "Polished", "keywords": ["polished"], "desc_keywords": ["polished"]},
]

# pattern in the description, product type, confidence
PRODUCT_TYPES = [
    (r"\banvil\b", "Anvil", 0.90),
    (r"\bbolt\b", "Bolt", 0.90),
    (r"\bgear\b", "Gear", 0.90),
    (r"\bplate\b", "Plate", 0.80),
    (r"\bring\b", "Ring", 0.80),
    (r"\brod\b", "Rod", 0.80),
    (r"\bwidget\b", "Widget", 0.80),
]


def brand_master(spark: SparkSession) -> DataFrame:
    rows = [(i, k, c) for i, (k, c) in enumerate(BRANDS)]
    return rule_table(spark, rows, ord="bigint", key="string", canonical="string")


def manufacturer_master(spark: SparkSession) -> DataFrame:
    rows = [(i, k, c, code) for i, (k, c, code) in enumerate(MANUFACTURERS)]
    return rule_table(spark, rows, ord="bigint", key="string", canonical="string", code="string")
