"""Entity resolution: raw names against alias masters.

Masters are tables ``(ord, key, canonical[, code])``; ``ord`` breaks ties, lowest
first.  Names are resolved once each: the different names of all columns are looked
up by all their keys in one dictionary of aliases, their starts and codes, by one
equi join, and rows take the result of their name.  No name is ever compared with
every alias.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import vocab
from shelfmark.functions.text import is_placeholder, squeeze, strip, title_if_flat
from shelfmark.sources.store import Staging

NAME_WITH_CODE = r"^(.*?)\s*\(([^)]+)\)\s*$"
MIN_PREFIX = 4


def split_code(raw: Column) -> tuple[Column, Column]:
    """``Name (CODE)`` -> name and code; names without a code keep themselves."""
    s = strip(raw)
    coded = s.rlike(NAME_WITH_CODE)
    name = F.when(coded, strip(F.regexp_extract(s, NAME_WITH_CODE, 1))).otherwise(s)
    code = F.when(coded, strip(F.regexp_extract(s, NAME_WITH_CODE, 2)))
    return name, code


def name_key(name: Column) -> Column:
    """Lower case, single blanks, no trailing punctuation."""
    return strip(F.regexp_replace(strip(squeeze(F.lower(name))), r"[.,;:]+$", ""))


def strip_suffixes(key: Column) -> Column:
    """Company endings removed in one ordered pass."""
    out = key
    for suffix in vocab.COMPANY_SUFFIXES:
        out = strip(F.regexp_replace(out, _ending(suffix), ""))
    # one test spares most names the whole pass
    some = "(?:" + "|".join(_ending(s)[:-1] for s in vocab.COMPANY_SUFFIXES) + ")$"
    return F.when(key.rlike(some), out).otherwise(key)


def _ending(suffix: str) -> str:
    return suffix.replace(".", r"\.") + "$"


def overlay(*layers: DataFrame) -> DataFrame:
    """Merge masters: a later layer replaces a key's values but keeps its first rank."""
    stacked = None
    for depth, layer in enumerate(layers):
        part = layer.withColumn("layer", F.lit(depth))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    values = [c for c in stacked.columns if c not in ("key", "ord", "layer")]
    last = F.max_by(F.struct(*values), F.struct("layer", "ord"))
    first = F.min(F.struct("layer", "ord"))
    merged = stacked.groupBy("key").agg(last.alias("v"), first.alias("rank"))
    return merged.select(
        (F.col("rank.layer").cast("bigint") * 1_000_000_000 + F.col("rank.ord")).alias("ord"),
        "key", *[F.col(f"v.{c}").alias(c) for c in values])


def name_parts(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``r_name, r_code, r_key, r_bare, r_void`` used by the matchers."""
    name, code = split_code(F.col(raw))
    void = (strip(F.col(raw)) == "") | is_placeholder(name, vocab.RESOLVER_PLACEHOLDERS) | is_placeholder(
        F.col(raw), vocab.RESOLVER_PLACEHOLDERS)
    out = df.withColumn("r_name", name).withColumn("r_code", code)
    out = out.withColumn("r_void", F.coalesce(void, F.lit(True)))
    out = out.withColumn("r_key", F.when(~F.col("r_void"), name_key(F.col("r_name"))))
    return out.withColumn("r_bare", strip_suffixes(F.col("r_key")))


def prefix_index(master: DataFrame, shortest: int, key_at_least: int = 1, keep_ord: bool = False) -> DataFrame:
    """Every prefix of every alias with the first-ranked alias behind it."""
    usable = master.filter(F.length("key") >= F.greatest(F.lit(shortest), F.lit(key_at_least)))
    lengths = F.sequence(F.lit(shortest), F.length("key"))
    values = [c for c in master.columns if c not in ("ord", "key")]
    spread = usable.select("ord", *values, F.explode(lengths).alias("n"), F.col("key").alias("full"))
    return (spread.select(F.expr("left(full, n)").alias("key"), "ord", *values)
            .groupBy("key").agg(F.min_by(F.struct("ord", *values), F.col("ord")).alias("v"))
            .select("key", *(["v.ord"] if keep_ord else []), *[f"v.{c}" for c in values]))


BRAND, MAKER = "brand", "manufacturer"
#: Least length of a name that an alias may continue.
SHORTEST = {BRAND: 3, MAKER: MIN_PREFIX}


def name_dictionary(masters: dict[str, DataFrame]) -> DataFrame:
    """(kind, way, key, ord, canonical, code): everything a name can be found by, one row for each key of a prefix or code.

    ``way`` is k for an alias, p for the start of one, c for a code."""
    out = None
    for kind, master in masters.items():
        m = master.select("ord", "key", "canonical", (F.col("code") if "code" in master.columns else F.lit(None)).cast("string").alias("code"))
        parts = [m.withColumn("way", F.lit("k")), prefix_index(m, SHORTEST[kind], keep_ord=True).withColumn("way", F.lit("p"))]
        if kind == MAKER:
            coded = m.filter(F.col("code") != "").groupBy(F.lower("code").alias("key")).agg(F.min_by(F.struct("ord", "canonical", "code"), F.col("ord")).alias("v"))
            parts.append(coded.select("key", "v.*", F.lit("c").alias("way")))
        for part in parts:
            part = part.select(F.lit(kind).alias("kind"), "way", "key", "ord", "canonical", "code")
            out = part if out is None else out.unionByName(part)
    return out


def _probes(kind: str) -> Column:
    """(step, way, key) in order of trust; of one step the first-ranked alias counts."""
    probe = lambda step, way, key: F.struct(F.lit(step).alias("step"), F.lit(way).alias("way"), key.alias("key"))
    name = F.col("r_key")
    known = [probe(1, "k", name), probe(2, "k", F.col("r_bare"))]
    if kind == BRAND:
        return F.array(*known, probe(3, "p", F.when(F.length(name) >= SHORTEST[BRAND], name)))
    known += [probe(3, "c", F.when(~F.col("r_void"), F.lower("r_code"))), probe(4, "p", F.when(F.length(name) >= MIN_PREFIX, name))]
    # aliases that the name continues
    starts = F.when(F.length(name) >= MIN_PREFIX, F.transform(F.sequence(F.lit(MIN_PREFIX), F.length(name)), lambda n: probe(4, "k", F.left(name, n))))
    return F.concat(F.array(*known), F.coalesce(starts, F.array().cast("array<struct<step:int,way:string,key:string>>")))


def resolved_names(names: DataFrame, masters: dict[str, DataFrame]) -> DataFrame:
    """(kind, raw, res) of distinct ``names(kind, raw)``: one look-up of all their probes in one dictionary."""
    d = name_parts(names, "raw")
    probes = None
    for kind in masters:
        probes = F.when(F.col("kind") == kind, _probes(kind)) if probes is None else probes.when(F.col("kind") == kind, _probes(kind))
    parts = ["kind", "raw", "r_name", "r_code", "r_key", "r_void"]
    d = d.select(*parts, F.explode_outer(F.filter(probes, lambda p: p["key"].isNotNull())).alias("p")).select(*parts, "p.*")
    met = d.join(name_dictionary(masters), ["kind", "way", "key"], "left")
    order = F.when(F.col("ord").isNotNull(), F.struct("step", "ord"))
    best = met.groupBy(*parts).agg(F.min_by(F.struct("step", "canonical", "code"), order).alias("hit"),
                                   F.min_by("code", F.when(F.col("code").isNotNull() & (F.col("step") <= 2), F.struct("step", "ord"))).alias("alias_code"))
    step, title = F.col("hit.step"), title_if_flat(F.col("r_name"))
    exact, bare, third, near = (step == k for k in (1, 2, 3, 4))
    identical = exact & (F.col("r_name") == F.col("hit.canonical"))
    maker = F.col("kind") == MAKER
    confidence = (F.when(maker, F.when(exact | bare, 0.95).when(third, 0.90).when(near, 0.78).otherwise(0.40))
                  .otherwise(F.when(identical, 0.98).when(exact, 0.95).when(bare, 0.90).when(third, 0.75).otherwise(0.40)))
    match_type = (F.when(maker, F.when(exact | bare | third, "NORMALIZED").when(near, "FUZZY").otherwise("UNRESOLVED"))
                  .otherwise(F.when(identical, "EXACT").when(exact | bare, "NORMALIZED").when(third, "FUZZY").otherwise("UNRESOLVED")))
    status = (F.when(maker, F.when(exact | bare | third, "RESOLVED").when(near, "LOW_CONFIDENCE").otherwise("UNRESOLVED"))
              .otherwise(F.when(exact | bare, "RESOLVED").when(third, "LOW_CONFIDENCE").otherwise("UNRESOLVED")))
    code = F.when(maker, F.coalesce("r_code", "alias_code", F.when(near, F.col("hit.code")))).otherwise(F.col("r_code"))
    return best.select("kind", "raw", _result("raw", F.coalesce("hit.canonical", title), confidence, match_type, status, code).alias("res"))


def _result(raw: str, canonical, confidence, match_type, status, code) -> Column:
    void = F.col("r_void")
    return F.struct(
        F.col(raw).alias("raw_value"),
        F.when(strip(F.col(raw)) != "", F.col("r_name")).alias("raw_name"),
        code.alias("raw_code"),
        F.col("r_key").alias("normalized_value"),
        F.when(~void, canonical).alias("canonical_value"),
        F.when(void, 0.0).otherwise(confidence).alias("confidence"),
        F.when(void, "UNRESOLVED").otherwise(match_type).alias("match_type"),
        F.when(void, "UNRESOLVED").otherwise(status).alias("status"),
    )


def resolve_columns(df: DataFrame, columns: dict[str, tuple[str, str]], masters: dict[str, DataFrame]) -> DataFrame:
    """Adds a result struct for each of ``columns {out: (kind, raw column)}``.

    The different names of all columns are resolved once; each column then takes its results by one join on the name. Rows
    without a name don't meet anywhere: they carry a key of their own."""
    pairs = [F.struct(F.lit(kind).alias("kind"), F.col(raw).alias("raw")) for kind, raw in columns.values()]
    names = df.select(F.explode(F.array(*pairs)).alias("n")).select("n.*").where("raw IS NOT NULL").distinct()
    found = resolved_names(names, masters)
    none = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("raw_value", "raw_name", "raw_code", "normalized_value", "canonical_value")],
                    F.lit(0.0).alias("confidence"), F.lit("UNRESOLVED").alias("match_type"), F.lit("UNRESOLVED").alias("status"))
    # content hash, so a recomputed task sends each row to the same place again
    alone = F.concat(F.lit("\ue000"), F.xxhash64(*df.columns).cast("string"))
    out = df
    for name, (kind, raw) in columns.items():
        side = found.select(F.concat(F.lit("="), "kind", F.lit("="), "raw").alias("r_at"), F.col("res").alias("r_res"))
        d = out.withColumn("r_probe", F.coalesce(F.concat(F.lit(f"={kind}="), F.col(raw)), alone))
        out = d.join(side, F.col("r_probe") == F.col("r_at"), "left").withColumn(name, F.coalesce("r_res", none)).drop("r_probe", "r_at", "r_res")
    return out


def resolve_brand(df: DataFrame, master: DataFrame, raw: str = "brand", out: str = "brand_res") -> DataFrame:
    """Adds a struct: exact key, then suffix-free key, then prefix, then title case."""
    return resolve_columns(df, {out: (BRAND, raw)}, {BRAND: master})


def resolve_manufacturer(df: DataFrame, master: DataFrame, raw: str = "manufacturer", out: str = "mfr_res") -> DataFrame:
    """Adds a struct: key or suffix-free key, then code, then two-way prefix, then title case."""
    return resolve_columns(df, {out: (MAKER, raw)}, {MAKER: master})


def brand_aliases(master: DataFrame) -> DataFrame:
    """Aliases and canonical names as ``(alias, canonical)``, one row per alias."""
    both = master.select(F.col("key").alias("alias"), "canonical").unionByName(
        master.select(F.lower("canonical").alias("alias"), "canonical"))
    return both.filter(F.col("alias") != "").groupBy("alias").agg(F.min("canonical").alias("canonical"))


def candidate_brand(df: DataFrame, aliases: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, candidate_brand)``: longest alias found as whole words in a text.

    Texts become postings (key, word, place) of the words that aliases have, written once. An alias is looked up by the word of it that
    is rarest in the texts; its other words must then stand at their offsets, which is another look-up in the postings. So no
    text is copied, and aliases may have any number of words. Ties in length go to the alphabetically first alias."""
    spark = df.sparkSession
    parts = aliases.select("alias", "canonical", F.split(_form(F.col("alias")), " ").alias("words"))
    own = parts.select("alias", F.posexplode("words").alias("offset", "word")).where("word <> ''")
    words = df.select(key, F.posexplode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORDISH), F.lit(0))).alias("place", "word"))
    postings = Staging(spark).keep(words.join(own.select("word").distinct(), "word", "left_semi"), "postings")
    often = postings.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    anchor = own.join(often, "word").groupBy("alias").agg(F.min(F.struct("n", "offset", "word")).alias("a"), F.count(F.lit(1)).alias("held"))
    # an alias with a word that no text has can't be found
    anchor = anchor.join(parts, "alias").where("held = size(words)").select("alias", "canonical", "words", "a.word", "a.offset")
    met = postings.join(anchor, "word").select(key, "alias", "canonical", "words", "offset", (F.col("place") - F.col("offset")).alias("start"))
    others = met.where("size(words) > 1").select(key, "alias", "canonical", "offset", "start", F.size("words").alias("n"), F.posexplode("words").alias("nth", "word")).where("nth <> offset")
    others = others.withColumn("place", F.col("start") + F.col("nth")).join(postings, [key, "word", "place"], "left_semi")
    whole = others.groupBy(key, "alias", "canonical", "start", "n").agg(F.count(F.lit(1)).alias("held")).where("held = n - 1")
    found = met.where("size(words) = 1").select(key, "alias", "canonical").unionByName(whole.select(key, "alias", "canonical"))
    return found.groupBy(key).agg(F.max_by("canonical", _alias_rank()).alias("candidate_brand"))


WORDISH = r"[\p{L}\p{N}_]+"


def _form(alias: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(alias), F.lit(WORDISH), F.lit(0)), " ")


def _alias_rank() -> Column:
    # longest first, then alphabetically first: complemented bytes sort backwards
    return F.struct(F.length("alias"), F.translate("alias", _ASCENDING, _DESCENDING))


_ASCENDING = "".join(chr(c) for c in range(32, 127))
_DESCENDING = _ASCENDING[::-1]


def brand_with_fallback(df: DataFrame, master: DataFrame, brand: str = "brand", candidate: str = "candidate_brand",
                        out: str = "brand_res", more: tuple[dict, dict] | None = None) -> DataFrame:
    """Resolve the entered brand; where that fails try the one named in the text.

    Names of both columns are resolved together; ``more`` adds other columns to the same look-up, as in ``resolve_columns``."""
    columns, others = more or ({}, {})
    d = resolve_columns(df, {"b_first": (BRAND, brand), "b_second": (BRAND, candidate)} | columns, {BRAND: master} | others)
    use_second = (F.col("b_first.status") == "UNRESOLVED") & F.col(candidate).isNotNull()
    return d.withColumn(out, F.when(use_second, F.col("b_second")).otherwise(F.col("b_first"))).drop("b_first", "b_second")
