"""Keyword and pattern classification, one narrow projection per classifier."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import vocab
from shelfmark.functions.text import contains_any, strip


def _found(c: Column, word: str, match: str) -> Column:
    if match == "word":
        return c.rlike(rf"\b{re.escape(word)}\b")
    return c.contains(word)


def _points(rule: dict, match: str) -> Column:
    hint, desc, both = F.col("t_hint"), F.col("t_desc"), F.col("t_both")
    parts = [F.when(_found(hint, k, match), 3).when(_found(desc, k, match), 2).otherwise(0)
             for k in rule["keywords"]]
    parts += [F.when(_found(both, k, match), 1).otherwise(0) for k in rule.get("desc_keywords", ())]
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def _hinted(rule: dict, match: str) -> Column:
    return reduce(lambda a, b: a | b, [_found(F.col("t_hint"), k, match) for k in rule["keywords"]], F.lit(False))


def classify(df: DataFrame, rules: list[dict], category: str = "category", description: str = "description",
             out: str = "tax", match: str = "contains") -> DataFrame:
    """Best-scoring rule per row; the first rule wins a tie.

    A category keyword counts 3 in the hint or 2 in the description, a
    description keyword 1 in either.  ``match='word'`` avoids hits inside words."""
    hint = F.lower(F.coalesce(F.col(category), F.lit("")))
    desc = F.lower(F.coalesce(F.col(description), F.lit("")))
    d = df.withColumn("t_hint", hint).withColumn("t_desc", desc)
    d = d.withColumn("t_both", F.concat("t_hint", F.lit(" "), "t_desc"))
    scored = F.array(*[F.struct(_points(r, match).alias("score"), F.lit(-i).alias("rank"), _hinted(r, match).alias("hinted"))
                       for i, r in enumerate(rules)])
    d = d.withColumn("t_best", F.array_max(scored))
    won = F.col("t_best.score") > 0
    place = F.when(won, 1 - F.col("t_best.rank"))

    def pick(field: str) -> Column:
        names = F.array(*[F.lit(r[field]) for r in rules])
        return F.coalesce(F.get(names, place - 1), F.lit("Unclassified"))

    strong = F.col("t_best.score") >= 4
    path = F.concat_ws(" > ", pick("dept"), pick("class_name"), pick("fine"))
    unplaced = F.when(F.col(category) != "", F.col(category)).otherwise("Unclassified")
    tax = F.struct(
        pick("dept").alias("dept"), pick("class_name").alias("class_name"), pick("fine").alias("fine"),
        F.when(won, path).otherwise(unplaced).alias("classpath"),
        F.when(~won, 0.0).when(strong, 0.90).otherwise(0.75).alias("confidence"),
        F.when(~won, "UNRESOLVED").when(strong | F.col("t_best.hinted"), "RESOLVED").otherwise("HEURISTIC").alias("status"),
        F.col("t_best.score").alias("score"),
    )
    return d.withColumn(out, tax).drop("t_hint", "t_desc", "t_both", "t_best")


def apply_category(df: DataFrame, tax: str = "tax", category: str = "category") -> DataFrame:
    placed = F.col(f"{tax}.status").isin("RESOLVED", "HEURISTIC") & (F.col(f"{tax}.classpath") != "Unclassified")
    return df.withColumn(category, F.when(placed, F.col(f"{tax}.classpath")).otherwise(F.col(category)))


def detect_type(text: Column, patterns: list[tuple[str, str, float]]) -> Column:
    """Struct of the most confident product type whose pattern occurs; first wins a tie."""
    low = F.lower(text)
    hits = F.array_compact(F.array(*[
        F.when(low.rlike(p), F.struct(F.lit(float(conf)).alias("confidence"), F.lit(-i).alias("rank"), F.lit(name).alias("name")))
        for i, (p, name, conf) in enumerate(patterns)]))
    best = F.array_max(hits)
    return F.struct(
        best["name"].alias("candidate_type"),
        F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"),
        F.when(best.isNull(), "UNRESOLVED").when(best["confidence"] >= 0.85, "CANDIDATE")
        .otherwise("LOW_CONFIDENCE").alias("status"),
    )


def input_category(description: Column, brand: Column) -> Column:
    """First keyword bucket found in description and brand, else ``other``."""
    text = F.lower(F.concat(F.coalesce(description, F.lit("")), F.lit(" "), F.coalesce(brand, F.lit(""))))
    hits = [F.when(contains_any(text, words), name) for name, words in vocab.CATEGORY_KEYWORDS]
    return F.coalesce(*hits, F.lit("other"))


def coarse_class(info: Column) -> Column:
    low = F.lower(info)
    hits = [F.when(contains_any(low, words), name) for words, name in vocab.COARSE_CLASSES]
    return F.coalesce(*hits, F.lit(vocab.COARSE_DEFAULT))


def manufacturer_failure(raw: Column, status: Column, match_type: Column) -> Column:
    """Why a manufacturer stayed open."""
    s = strip(F.coalesce(raw, F.lit("")))
    return (F.when(s.isin("", "-", "--"), "missing manufacturer")
            .when(F.lower(s).isin(*vocab.RESOLVER_PLACEHOLDERS), "placeholder manufacturer")
            .when(raw.rlike(r"[^\p{L}\p{N}_\s()\-.,&']"), "malformed manufacturer strings")
            .when(status == "REVIEW_REQUIRED", "ambiguous manufacturer")
            .when((match_type == "UNRESOLVED") & (status != "RESOLVED"), "unknown manufacturer")
            .otherwise("parsing failure"))


def taxonomy_outcome(status: Column, class_name: Column) -> Column:
    s = F.upper(F.coalesce(status, F.lit("")))
    cls = F.lower(strip(F.coalesce(class_name, F.lit(""))))
    return (F.when((s == "RESOLVED") & ~cls.isin("", "unclassified"), "correct_confident")
            .when(s == "HEURISTIC", "heuristic").when(s == "LOW_CONFIDENCE", "ambiguous").otherwise("unresolved"))


