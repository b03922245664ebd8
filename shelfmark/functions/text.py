"""Cleaning and text predicates as Column expressions (all JVM side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import vocab


def strip(c: Column) -> Column:
    """Trim every kind of whitespace, not just blanks."""
    return F.btrim(c, F.lit(vocab.WHITESPACE))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def is_placeholder(c: Column, words=vocab.PLACEHOLDERS) -> Column:
    return F.lower(strip(c)).isin(*words)


def clean_category(c: Column) -> Column:
    """Trimmed, single-spaced text; null when empty or a placeholder."""
    t = strip(c)
    return F.when((t != "") & ~is_placeholder(c), squeeze(t))


def clean_text(c: Column) -> Column:
    """As :func:`clean_category`, with control characters removed as well."""
    return F.regexp_replace(clean_category(c), r"[\x00-\x1f\x7f]", "")


clean_part_number = clean_text
clean_brand = clean_text
clean_manufacturer = clean_text
clean_description = clean_text


def cleaned(c: Column, cleaner=clean_text) -> Column:
    """Struct of raw value, cleaned value and the reason a value was dropped."""
    return F.struct(
        c.alias("raw"),
        cleaner(c).alias("cleaned"),
        F.coalesce(is_placeholder(c), F.lit(False)).alias("was_placeholder"),
        F.coalesce(strip(c) == "", F.lit(True)).alias("was_empty"),
    )


def first_real(*cols: Column) -> Column:
    """First of several columns holding more than a placeholder."""
    return F.coalesce(*[clean_text(c) for c in cols])


def is_resolved_value(c: Column) -> Column:
    return F.coalesce(~F.lower(strip(c)).isin(*vocab.UNRESOLVED_WORDS), F.lit(False))


def is_valid_text(c: Column) -> Column:
    """Usable in a description: no stop value and no stop word inside."""
    t = F.lower(strip(c))
    ok = (c != "") & ~t.isin(*vocab.TEXT_STOP_VALUES) & ~t.rlike(vocab.TEXT_STOP_WORD)
    return F.coalesce(ok, F.lit(False))


def export_value(c: Column) -> Column:
    """Blank instead of null or a word that means nothing."""
    t = strip(c)
    return F.when(F.lower(t).isin(*vocab.EXPORT_BLANKS) | t.isNull(), "").otherwise(t)


def title_case(c: Column) -> Column:
    """Capital after every non-letter (``O'Neil``, ``Black&Decker``)."""
    runs = F.regexp_extract_all(c, F.lit(r"[\p{L}]+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def title_if_flat(c: Column) -> Column:
    """Title-case names typed all upper or all lower; leave mixed case alone.

    Names without any letter are left alone too."""
    flat = (F.upper(c) != F.lower(c)) & ((F.upper(c) == c) | (F.lower(c) == c))
    return F.when(flat, title_case(c)).otherwise(c)


def contains_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def null_if_blank(c: Column) -> Column:
    return F.when(c != "", c)


def format_number(value: Column, raw: Column | None = None) -> Column:
    """Whole numbers without ``.0``; huge ones keep their raw spelling."""
    text = F.when(value == F.floor(value), value.try_cast("bigint").cast("string")).otherwise(
        value.cast("string"))
    return F.coalesce(text, raw) if raw is not None else text


def score_round(c: Column, digits: int) -> Column:
    """Half-even rounding after float noise is removed."""
    return F.bround(F.round(c, 8), digits)


def share(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    return F.coalesce(score_round(F.try_divide(numerator, denominator), digits), F.lit(0.0))
