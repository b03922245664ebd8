"""License scans: phrase places, and an exact set-similarity join of text blocks with notice templates. DataFrame functions only.

A block is ``2 * REACH`` consecutive words of a text, wherever its lines end; one starts every ``REACH`` words, where ``REACH`` is the length of the
longest template. So every run of up to ``REACH`` words, wrapped or not, stands whole in a block, and words that are further apart than a block never meet. For every template, all blocks are found
that hold at least ``CONTAINED`` of the template's distinct words.
Template words are ordered by how many blocks of the corpus hold them, rarest first; a block that meets the threshold must hold
one of the first (length - needed + 1) words of the template (prefix filter), must hold as many template words as are needed
(length filter), and from the place of its first shared word on enough words must be left in both (positional filter). Survivors
are counted exactly. Only words of the templates are ever exploded, so the join's input is a small part of the text.

Cases: null and empty texts have no words and no blocks; a text of any length is cut into blocks; repeated rows get equal results; null and
repeated ids do no harm; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import KEY, MARKS, lower_ascii, row_key, stage, words_between

# Phrases of the contract, and opening sentences of well-known public notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
]
REACH = max(len(t.split(" ")) for _, t in TEMPLATES)
CONTAINED = 80  # per cent of a template's distinct words


def places(words, phrase: str):
    """Where the phrase's words stand in a row; word arrays are only walked if all the phrase's words occur."""
    parts = phrase.split(" ")
    hit = F.lit(True)
    for k, p in enumerate(parts):
        hit = hit & (F.get(words, F.col("i") + k) == p)
    return hit


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: n_words and, where phrase words occur, the places of the phrases as (at, label)."""
    text = lower_ascii(F.coalesce("text", F.lit("")))
    d = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), text.alias("text"))
    n = F.size(F.split("text", MARKS))
    n = (n - F.when(F.col("text").rlike("^" + MARKS), 1).otherwise(0) - F.when(F.col("text").rlike(MARKS + r"\z"), 1).otherwise(0))
    n = F.when(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"), n).otherwise(0).cast("long")
    may = F.col("text").rlike("|".join("(" + MARKS.join(p.split(" ")) + ")" for p in PHRASES))
    return d.select("doc_id", *KEY, "text", n.alias("n_words"), F.when(may, words_between(F.col("text"), MARKS)).alias("words"))


def phrase_places(rows: DataFrame) -> DataFrame:
    """(key, n_base, first_word, last_word, labels) of rows with phrases."""
    at = rows.where("words IS NOT NULL").select(*KEY, "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("i"))
    found = F.lit(None).cast("string")
    for phrase, label in PHRASES.items():
        found = F.when(places(F.col("words"), phrase), label).otherwise(found)
    return at.select(*KEY, "i", found.alias("label")).where("label IS NOT NULL")


def blocks(rows: DataFrame) -> DataFrame:
    """(key, block, held): template words that each block holds."""
    vocabulary = F.array(*map(F.lit, sorted({w for _, t in TEMPLATES for w in t.split(" ")})))
    need = min(needed(len(set(t.split(" ")))) for _, t in TEMPLATES)
    # a generator, so that the words are cut once
    words = rows.select(*KEY, F.explode(F.array(words_between(F.col("text"), MARKS))).alias("words")).where("size(words) > 0")
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"(size(words) - 1) div {REACH}")), lambda k: F.array_intersect(F.slice("words", (k * REACH + 1).cast("int"), 2 * REACH), vocabulary))
    return words.select(*KEY, F.posexplode(cut).alias("block", "held")).where(F.size("held") >= need)


def needed(size: int, per_cent: int = CONTAINED) -> int:
    return -(-per_cent * size // 100)


def similar_blocks(held: DataFrame) -> DataFrame:
    """(key, block, label, contained): every block that meets a template's threshold.

    The counts that set the order are of all blocks; there is one for each template word, so they are few whatever the input.
    """
    spark = held.sparkSession
    often = {r["word"]: r["n"] for r in held.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted({w for _, t in TEMPLATES for w in t.split(" ")}, key=lambda w: (often.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    prefix = []
    for k, (label, t) in enumerate(TEMPLATES):
        ranks = sorted({rank[w] for w in t.split(" ")})
        need = needed(len(ranks))
        prefix += [(r, k, label, place, need, ranks) for place, r in enumerate(ranks[:len(ranks) - need + 1])]
    first = spark.createDataFrame(prefix, "rank int, template int, label string, place int, need int, ranks array<int>")
    to_rank = F.create_map(*(F.lit(x) for w, k in rank.items() for x in (w, k)))
    own = held.select(*KEY, "block", F.array_sort(F.transform("held", lambda w: F.element_at(to_rank, w))).alias("own"))
    rare = F.array(*map(F.lit, sorted({p[0] for p in prefix})))
    met = own.select("*", F.explode(F.array_intersect("own", rare)).alias("rank")).join(first, "rank")
    # from this shared word on, enough words must be left in the block and in the template
    left = F.size("own") - F.array_position("own", F.col("rank")) + 1
    met = met.where((F.size("own") >= F.col("need")) & (left >= F.col("need") - F.col("place")) & (F.size("ranks") - F.col("place") >= F.col("need") - F.col("place")))
    met = met.withColumn("shared", F.size(F.array_intersect("own", "ranks"))).where("shared >= need")
    return met.select(*KEY, "block", "label", (F.col("shared") / F.size("ranks")).alias("contained")).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (best containment; 1 with a phrase)."""
    rows = scanned(docs)
    base = phrase_places(rows.where("words IS NOT NULL").dropDuplicates(KEY)).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_base"), F.min("i").cast("long").alias("first_word"), F.max("i").cast("long").alias("last_word"), F.collect_set("label").alias("base"))
    found = similar_blocks(stage(blocks(rows), "held")).groupBy(*KEY).agg(F.collect_set("label").alias("more"), F.max("contained").alias("best"))
    hits = stage(base.join(found, KEY, "full"), "hits")
    none = F.array().cast("array<string>")
    joined = lambda *a: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.coalesce(x, none) for x in a)))), ",")
    return rows.select("doc_id", *KEY, "n_words").join(hits, KEY, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", joined("base").alias("base_labels"), joined("base", "more").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def _sql() -> str:
    words = lambda x: f"regexp_extract_all({x}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    test = " UNION ALL ".join("SELECT r, i - 1 AS i, '{}' AS label FROM p WHERE {}".format(label, " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split(" "))))
                              for phrase, label in PHRASES.items())
    ts = ", ".join("('{}', {})".format(label, sorted(set(t.split(" ")))) for label, t in TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
x AS (SELECT r, doc_id, t, {words('t')} AS w FROM d),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM x WHERE t LIKE '%license%'),
b AS (SELECT r, count(*) AS n, min(i)::BIGINT AS f, max(i)::BIGINT AS l, list_sort(list(DISTINCT label)) AS base FROM ({test}) GROUP BY r),
t AS (SELECT * FROM (VALUES {ts}) AS v(label, words)),
l AS (SELECT r, list_distinct(w[k + 1:k + {2 * REACH}]) AS held FROM (SELECT r, w, unnest(range(0, len(w), {REACH})) AS k FROM x)),
s AS (SELECT r, label, len(list_intersect(held, words)) / len(words) AS c FROM l, t WHERE 100 * len(list_intersect(held, words)) >= {CONTAINED} * len(words)),
m AS (SELECT r, list(DISTINCT label) AS more, max(c) AS c FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f AS first_word, l AS last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
    CASE WHEN n > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM x LEFT JOIN b USING (r) LEFT JOIN m USING (r)
"""


SQL = _sql()
