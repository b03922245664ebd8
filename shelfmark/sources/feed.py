"""Catalog feeds: CSV in, canonical columns out, bad rows set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import vocab
from shelfmark.functions.text import clean_category, clean_text, first_real, strip

BRAND_COLUMNS = ("E1_Brand", "Unilog_Brand", "DIB_Brand")


class EmptyFeed(ValueError):
    """The feed holds no rows."""


def read_feed_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Header CSV, every column a string.  Files stay splittable unless ``multiline``."""
    df = (spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
          .option("multiLine", multiline).csv(path))
    if df.isEmpty():
        raise EmptyFeed(f"no rows in {path}")
    return df


def canonical_header(df: DataFrame, aliases=None) -> DataFrame:
    """Known header spellings renamed; missing fields become empty strings."""
    out = []
    for field, names in (aliases or vocab.HEADER_ALIASES).items():
        source = next((n for n in names if n in df.columns), None)
        out.append((F.col(f"`{source}`") if source else F.lit("")).alias(field))
    taken = {n for names in (aliases or vocab.HEADER_ALIASES).values() for n in names}
    rest = [F.col(f"`{c}`") for c in df.columns if c not in taken]
    return df.select(*out, *rest)


def reject_reason(required=("part_number",)) -> Column:
    """First missing required field, null for good rows."""
    reasons = [F.when(strip(F.coalesce(F.col(c), F.lit(""))) == "", f"Missing {c.replace('_', ' ')}") for c in required]
    return F.coalesce(*reasons, F.lit(None).cast("string"))


def reject_split(df: DataFrame, required=("part_number",)) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with ``reject_reason``."""
    d = df.withColumn("reject_reason", reject_reason(required))
    return d.filter(F.col("reject_reason").isNull()).drop("reject_reason"), d.filter(F.col("reject_reason").isNotNull())


def natural_id(*cols: str) -> Column:
    """Product id from the row's own content: reruns give the same id."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in cols]
    return F.concat(F.lit("prod_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def clean_feed(df: DataFrame) -> DataFrame:
    """Cleaned ``product_id, part_number, brand, manufacturer, description, category``.

    A feed with several brand columns takes the first real one."""
    brands = [c for c in BRAND_COLUMNS if c in df.columns]
    brand = first_real(*[F.col(c) for c in brands]) if brands else clean_text(F.col("brand"))

    def col(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    return df.select(
        "product_id", clean_text(col("part_number")).alias("part_number"), brand.alias("brand"),
        clean_text(col("manufacturer")).alias("manufacturer"), clean_text(col("description")).alias("description"),
        clean_category(col("category")).alias("category"))
