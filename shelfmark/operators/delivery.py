"""The 252-column delivery record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import export_value, null_if_blank, strip
from shelfmark.functions.vocab import delivery_columns
from shelfmark.operators.describe import DESCRIPTIONS

COLUMNS = delivery_columns()
TRIPLETS = 50


def check_schema(columns) -> None:
    names = list(columns)
    if len(names) != 252 or len(set(names)) != 252:
        raise ValueError(f"delivery schema needs 252 unique columns, got {len(names)} ({len(set(names))} unique)")
    if names != list(COLUMNS):
        raise ValueError("delivery columns differ from the fixed header order")


def triplets(attributes: DataFrame) -> DataFrame:
    """First 50 attributes by name per product, long form."""
    w = Window.partitionBy("product_id").orderBy("name")
    return (attributes.filter(~F.lower("name").isin("dimensions", "weight"))
            .withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= TRIPLETS)
            .select("product_id", "slot", export_value(F.col("name")).alias("label"),
                    export_value(F.coalesce(null_if_blank(F.col("normalized_value")), F.col("value"))).alias("value"),
                    export_value(F.col("unit")).alias("uom")))


def measures(attributes: DataFrame) -> DataFrame:
    """Height, width, length and weight with units, one row per product."""
    name = F.lower("name")
    picked = attributes.filter(name.isin("dimensions", "weight"))
    weight = F.struct(F.coalesce(null_if_blank(F.col("normalized_value")), F.col("value"), F.lit("")).alias("v"),
                      F.coalesce("unit", F.lit("")).alias("u"))
    size = F.struct(F.lower("normalized_value").alias("v"), F.coalesce("unit", F.lit("")).alias("u"))
    one = picked.groupBy("product_id").agg(
        F.max(F.when((name == "dimensions") & F.lower("normalized_value").contains("x"), size)).alias("d"),
        F.max(F.when(name == "weight", weight)).alias("w"))
    parts = F.split("d.v", "x")

    def side(i: int) -> Column:
        return F.coalesce(F.get(F.split(strip(F.get(parts, F.lit(i))), " "), F.lit(0)), F.lit(""))

    unit = F.coalesce("d.u", F.lit(""))
    return one.select(
        "product_id", side(0).alias("HEIGHT"), unit.alias("HEIGHT_UOM"), side(1).alias("WIDTH"), unit.alias("WIDTH_UOM"),
        side(2).alias("LENGTH"), unit.alias("LENGTH_UOM"),
        F.coalesce("w.v", F.lit("")).alias("WEIGHT"), F.coalesce("w.u", F.lit("")).alias("WEIGHT_UOM"))


def to_delivery(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """Wide records in header order.  ``products`` carries taxonomy and descriptions."""
    cell = F.struct("slot", "label", "value", "uom")
    packed = triplets(attributes).groupBy("product_id").agg(F.sort_array(F.collect_list(cell)).alias("t"))
    sizes = measures(attributes)
    d = products.join(packed, "product_id", "left").join(sizes, "product_id", "left")

    def col(name: str) -> Column:
        return F.col(name) if name in products.columns else F.lit(None).cast("string")

    maker = F.coalesce(null_if_blank(col("manufacturer")), col("brand"))
    fixed = {
        "SKU - MY_PART_NUMBER": export_value(col("product_id").cast("string")),
        "Mfg_Part_Num": export_value(col("part_number")),
        "PART_NUMBER": export_value(col("part_number")),
        "MANUFACTURER_PART_NUMBER": export_value(col("part_number")),
        "Part_Manuf": export_value(maker), "MANUFACTURER_NAME": export_value(maker),
        "BRAND_NAME": export_value(col("brand")),
        "Discontinued": F.when(col("status") == "DISCONTINUED", "Yes").otherwise("No"),
        "Dept": export_value(col("taxonomy_dept")), "Class": export_value(col("taxonomy_class")),
        "Fine": export_value(col("taxonomy_fine")),
        "Classpath": export_value(F.coalesce(null_if_blank(col("taxonomy_classpath")), col("category"))),
    }
    texts = dict(zip(("SHORT_DESC", "LONG_DESC1", "INVOICE_DESC", "MOBILE_DESC", "RETAIL_DESC", "MARKETING_DESCRIPTION"), DESCRIPTIONS))
    fixed |= {out: export_value(col(src)) for out, src in texts.items()}
    fixed |= {c: F.coalesce(F.col(c), F.lit("")) for c in sizes.columns if c != "product_id"}
    for i in range(TRIPLETS):
        slot = F.get("t", F.lit(i))
        for part, field in (("LABEL", "label"), ("VALUE", "value"), ("UOM", "uom")):
            fixed[f"ATTRIBUTE_{part} {i + 1}"] = F.coalesce(slot[field], F.lit(""))
    out = d.select(*[fixed.get(c, F.lit("")).alias(c) for c in COLUMNS])
    check_schema(out.columns)
    return out
