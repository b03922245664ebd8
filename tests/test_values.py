"""Goldens for cleaning, normalisation, extraction and classification."""

from pyspark.sql import functions as F

from shelfmark.functions import text, units
from shelfmark.functions.vocab import delivery_columns
from shelfmark.operators import classify, extract, resolve
from shelfmark.plans.rules import rule_table

NORMS = [
    ("voltage", "400 volts", "400 V"), ("voltage", "230VAC", "230 V AC"), ("voltage", "24 VDC", "24 V DC"), ("voltage", "0.4 kV", "400 V"),
    ("voltage", "400/690 V", "400-690 V"), ("voltage", "0.4-0.69 kV", "400-690 V"), ("voltage", "approx 400 or maybe 230 V", None),
    ("current", "10 amps", "10 A"), ("current", "0.28...0.4 A", "0.28-0.4 A"), ("current", "500 mA", "500 mA"), ("current", "10 - 16 A max", "10-16 A"),
    ("current", "unknown / TBD", None), ("frequency", "50Hz", "50 Hz"), ("frequency", "50 to 60 Hz", "50/60 Hz"),
    ("dimensions", "9.7cm x 4.5cm x 9.7cm", "97 x 45 x 97 mm"), ("dimensions", "3.82 x 1.77 x 3.82 inches", "97 x 45 x 97 mm"),
    ("dimensions", '1-1/2" x 3"', "38.1 x 76.2 mm"), ("poles", "3P", "3"), ("trip_class", "Trip Class 10A", "Class 10A"), ("power", "5 hp", "5 HP"),
    ("mounting", "din rail 35 mm", "DIN Rail (35mm)"), ("color", 'bk  1/2"', "Black 1/2 in"),
]


def test_normalised_values(spark):
    d = spark.createDataFrame(NORMS, "attribute string, value string, expected string")
    rows = units.with_norm(d).collect()
    assert [(r.value, r.norm.normalized_value) for r in rows] == [(r.value, r.expected) for r in rows]
    doubtful = {r.value for r in rows if r.norm.requires_review}
    assert doubtful == {"approx 400 or maybe 230 V", "unknown / TBD"}


def test_normalising_twice_changes_nothing(spark):
    d = spark.createDataFrame([(a, e) for a, _, e in NORMS if e and a not in ("dimensions",)], "attribute string, value string")
    assert all(r.norm.normalized_value == r.value for r in units.with_norm(d).collect())


def test_fractions_units_and_titles(spark):
    d = spark.createDataFrame([("0.5",), ("1.5",), ("0.03125",), ("0.33",), ("24in",), ("100lbs",), ("120vdc",), ("50.25 in",)], "v string")
    out = [tuple(r) for r in d.select("v", units.fractions(F.col("v")), units.spaced_unit(units.fractions(F.col("v")))).collect()]
    assert out == [("0.5", "1/2", "1/2"), ("1.5", "1-1/2", "1-1/2"), ("0.03125", "1/32", "1/32"), ("0.33", "0.33", "0.33"), ("24in", "24in", "24 in"),
                   ("100lbs", "100lbs", "100 lb"), ("120vdc", "120vdc", "120 VDC"), ("50.25 in", "50-1/4 in", "50-1/4 in")]
    d = spark.createDataFrame([("O'NEIL",), ("black&decker",), ("Mixed Case",)], "v string")
    assert [r[0] for r in d.select(text.title_if_flat(F.col("v"))).collect()] == ["O'Neil", "Black&Decker", "Mixed Case"]


def test_placeholders_and_rounding(spark):
    d = spark.createDataFrame([("-- Unbranded --",), (" N/A ",), ("Unknown",), (" a \t b ",)], "v string")
    assert [r[0] for r in d.select(text.clean_text(F.col("v"))).collect()] == [None, None, None, "a b"]
    assert spark.range(1).select(text.score_round(F.lit(72.25), 1)).first()[0] == 72.2


def test_dimensions_are_read_whole(spark):
    d = spark.createDataFrame([(1, '1/2"x18" belt'), (2, "4x4 post"), (3, "12 - 24 V DC sensor")], "k int, t string")
    long = extract.dedupe_facts(extract.explode_facts(d, "k", F.concat(
        extract.dimension_facts(F.col("t"), F.lit("")), extract.physical_facts(F.col("t")))), "k").collect()
    got = {(r.k, r.attribute, r.value) for r in long}
    assert {(1, "width", '1/2"'), (1, "length", '18"'), (2, "width", "4"), (2, "height", "4"), (3, "voltage", "12 - 24 V DC")} <= got


def test_resolution_order(spark):
    m = rule_table(spark, [(0, "siemens", "Siemens"), (1, "schneider electric", "Schneider Electric")], ord="bigint", key="string", canonical="string")
    names = ["Siemens", "SIEMENS AG", "schn", "N/A", "O'NEIL TOOLS"]
    d = spark.createDataFrame(list(enumerate(names)), "i int, brand string")
    got = {r.brand: (r.brand_res.canonical_value, r.brand_res.confidence, r.brand_res.status) for r in resolve.resolve_brand(d, m).collect()}
    assert got == {"Siemens": ("Siemens", 0.98, "RESOLVED"), "SIEMENS AG": ("Siemens", 0.9, "RESOLVED"), "schn": ("Schneider Electric", 0.75, "LOW_CONFIDENCE"),
                   "N/A": (None, 0.0, "UNRESOLVED"), "O'NEIL TOOLS": ("O'Neil Tools", 0.4, "UNRESOLVED")}


def test_word_match_mode(spark):
    d = spark.createDataFrame([("", "filled box")], "category string, description string")
    rules = [{"keywords": ["led"], "desc_keywords": [], "dept": "L", "class_name": "L", "fine": "L"}]
    assert classify.classify(d, rules).first().tax.status == "HEURISTIC"
    assert classify.classify(d, rules, match="word").first().tax.status == "UNRESOLVED"


def test_delivery_header():
    names = delivery_columns()
    assert len(names) == 252 and len(set(names)) == 252 and names[55] == "ATTRIBUTE_LABEL 1" and names[251] == "Actual Image (Yes/No)"
