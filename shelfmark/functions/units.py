"""Value and unit normalisation as Column expressions.

``with_norm`` adds one struct column to a long attribute table in a chain of narrow
projections.  Nothing here runs in Python.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import vocab
from shelfmark.functions.text import contains_any, null_if_blank, squeeze, strip

DECIMAL = r"\d+(?:\.\d+)?"
RANGE = rf"(?i)({DECIMAL})\s*(?:-|/|to|\.\.\.)\s*({DECIMAL})"
# A minus sign counts only when no digit stands before it; fractions are numbers too.
SIGNED = r"(?:^|[^0-9./])(-?(?:\d+-\d+/\d+|\d+/\d+|\d+(?:\.\d+)?|\.\d+))"
# The same without fractions: "50/60 Hz" holds 50 and 60.
COUNTED = r"(?:^|[^0-9.])(-?(?:\d+(?:\.\d+)?|\.\d+))"
PLAIN_DECIMAL = r"\b\d+\.\d+\b"


HEDGED = "(?i)" + "|".join(re.escape(h) for h in vocab.HEDGES)
VOLT_RANGE = rf"(?i)({DECIMAL})\s*(?:-|/|to)\s*({DECIMAL})"
AMPS = r"(?i)(\d+(?:\.\d+)?)\s*(m?a(?:mps?|mperes?)?)\b"
HERTZ = rf"(?i)({DECIMAL})\s*(?:hz|hertz)\b"
DUAL_HERTZ = r"(?i)50\s*(?:/|-|to|or|,)\s*60\s*(?:hz|hertz)?"
TRIP = r"(?i)(?:trip\s*class|class)?\s*(\d+[A-Za-z]?)\b"
POWER = r"(?i)(\d+(?:\.\d+)?)\s*(kw|kilowatts?|hp|horsepower)\b"


def _hit(s: Column, pattern: str, group: int = 1) -> Column:
    """Captured text of the first match, null when there is none."""
    return null_if_blank(F.regexp_extract(s, pattern, group))


def plain_numbers(s: Column) -> Column:
    """Numbers of a specification text, slashes and dashes read as separators."""
    return F.transform(F.regexp_extract_all(s, F.lit(COUNTED), F.lit(1)), lambda t: t.try_cast("double"))


# Attribute-name fragments in the order they are tried.
FAMILIES = (
    ("voltage", ("voltage",)), ("current", ("current",)), ("frequency", ("frequency",)),
    ("dimensions", ("dimension", "size")), ("poles", ("pole",)), ("trip", ("trip",)),
    ("power", ("power",)), ("mounting", ("mounting",)),
)


def family(attribute: Column) -> Column:
    """Which normaliser an attribute name asks for."""
    name = F.lower(attribute)
    return F.coalesce(*[F.when(contains_any(name, words), kind) for kind, words in FAMILIES], F.lit("generic"))


def _q(pattern: str) -> str:
    """A pattern as a raw SQL literal."""
    return "r'" + pattern.replace("'", "\\u0027") + "'"


def _group(pattern: str, group: int = 1, text: str = "n_text") -> str:
    return f"nullif(regexp_extract({text}, {_q(pattern)}, {group}), '')"


def _whole(number: str, raw: str) -> str:
    """Whole numbers without ``.0``; huge ones keep their raw spelling."""
    return (f"coalesce(CASE WHEN {number} = floor({number}) THEN CAST(try_cast({number} AS BIGINT) AS STRING) "
            f"ELSE CAST({number} AS STRING) END, {raw})")


def _staged(df: DataFrame, *stages: dict[str, str]) -> DataFrame:
    """Columns added stage by stage; a stage sees the columns of the ones before."""
    for stage in stages:
        df = df.select("*", *[F.expr(sql).alias(name) for name, sql in stage.items()])
    return df


NUMBER_FROM_TOKEN = """CASE WHEN contains(t, '/') THEN
    coalesce(try_cast(nullif(regexp_extract(t, r'^(-?\\d+)-\\d+/', 1), '') AS DOUBLE), 0D)
    + (CASE WHEN startswith(t, '-') THEN -1D ELSE 1D END)
    * try_divide(try_cast(regexp_extract(t, r'(\\d+)/\\d+$', 1) AS DOUBLE), try_cast(regexp_extract(t, r'/(\\d+)$', 1) AS DOUBLE))
    ELSE try_cast(t AS DOUBLE) END"""


def _stages() -> tuple[dict[str, str], ...]:
    """The normalisation steps as SQL: one parse each, and each pattern matched once per row."""
    numbers = f"transform(regexp_extract_all(n_text, {_q(SIGNED)}, 1), t -> {NUMBER_FROM_TOKEN})"
    kilo = "contains(n_low, 'kv')"

    def volts(c: str) -> str:
        scaled = f"round(try_cast({c} AS DOUBLE) * 1000D, 9)"
        return f"CASE WHEN {kilo} THEN {_whole(scaled, c)} ELSE {c} END"

    kind = (f"CASE WHEN n_text RLIKE {_q(r'(?i)vac|v\s*ac|\bac\b|\ba\.c\.')} THEN ' AC' "
            f"WHEN n_text RLIKE {_q(r'(?i)vdc|v\s*dc|\bdc\b|\bd\.c\.')} THEN ' DC' ELSE '' END")
    rail = "contains(n_low, 'din') AND contains(n_low, 'rail')"
    number = _whole("n_num", "n_one")
    return (
        {"n_low": "lower(n_text)",
         "n_hedge": f"coalesce(n_fam IN ('voltage', 'current', 'frequency', 'dimensions') AND n_text RLIKE {_q(HEDGED)}, false)"},
        {"n_lo": f"CASE WHEN n_hedge THEN NULL WHEN n_fam = 'voltage' THEN {_group(VOLT_RANGE)} WHEN n_fam = 'current' THEN {_group(RANGE)} END",
         "n_sizes": f"CASE WHEN n_fam = 'dimensions' AND NOT n_hedge THEN filter({numbers}, n -> n > 0) END"},
        {"n_hi": f"CASE WHEN n_lo IS NULL THEN NULL WHEN n_fam = 'voltage' THEN {_group(VOLT_RANGE, 2)} ELSE {_group(RANGE, 2)} END",
         "n_one": f"""CASE WHEN n_hedge OR n_lo IS NOT NULL THEN NULL WHEN n_fam = 'voltage' THEN {_group(f"({DECIMAL})")}
            WHEN n_fam = 'current' THEN coalesce({_group(AMPS)}, {_group(f"^({DECIMAL})$")})
            WHEN n_fam = 'frequency' THEN coalesce(CASE WHEN n_text RLIKE {_q(DUAL_HERTZ)} THEN '50/60' END, {_group(HERTZ)}, CASE WHEN n_text IN ('50', '60', '400') THEN n_text END)
            WHEN n_fam = 'poles' THEN {_group("([0-9]+)")} WHEN n_fam = 'trip' THEN upper({_group(TRIP)}) WHEN n_fam = 'power' THEN {_group(POWER)} END""",
         "n_scale": f"""CASE WHEN size(n_sizes) NOT IN (2, 3) THEN NULL WHEN n_text RLIKE '(?i)cm|centimeter' THEN 10D
            WHEN n_text RLIKE {_q(r'(?i)inch|inches|\bin\b|"')} THEN 25.4D ELSE 1D END"""},
        {"n_word": f"CASE WHEN n_one IS NULL THEN NULL WHEN n_fam = 'current' THEN lower({_group(AMPS, 2)}) WHEN n_fam = 'power' THEN lower({_group(POWER, 2)}) END",
         "n_num": f"CASE WHEN n_fam = 'voltage' AND {kilo} THEN round(try_cast(n_one AS DOUBLE) * 1000D, 9) ELSE try_cast(n_one AS DOUBLE) END"},
        # milliamps only when the unit is attached to a number ("16 A max" stays in A)
        {"n_unit": f"""CASE WHEN n_hedge THEN NULL WHEN n_fam = 'voltage' THEN 'V'
            WHEN n_fam = 'current' THEN CASE WHEN n_lo IS NOT NULL THEN CASE WHEN n_text RLIKE {_q(r'(?i)\d\s*ma\b')} THEN 'mA' ELSE 'A' END
              WHEN contains(n_word, 'ma') THEN 'mA' ELSE 'A' END
            WHEN n_fam = 'frequency' THEN 'Hz' WHEN n_fam = 'dimensions' THEN 'mm' WHEN n_fam = 'poles' THEN CASE WHEN n_num IS NOT NULL THEN 'poles' END
            WHEN n_fam = 'power' THEN CASE WHEN startswith(n_word, 'h') THEN 'HP' WHEN n_word IS NOT NULL THEN 'kW' END END"""},
        {"n_shown": f"""CASE WHEN NOT n_given THEN NULL
            WHEN n_fam = 'voltage' THEN CASE WHEN n_lo IS NOT NULL THEN concat({volts('n_lo')}, '-', {volts('n_hi')}, ' V', {kind})
              WHEN n_one IS NOT NULL THEN concat({number}, ' V', {kind}) END
            WHEN n_fam = 'current' THEN CASE WHEN n_lo IS NOT NULL THEN concat(n_lo, '-', n_hi, ' ', n_unit)
              WHEN n_one IS NOT NULL THEN concat({number}, ' ', n_unit) END
            WHEN n_fam = 'frequency' THEN concat({number}, ' Hz')
            WHEN n_fam = 'dimensions' THEN CASE WHEN n_scale IS NOT NULL THEN concat(array_join(transform(n_sizes, n -> {_whole("bround(n * n_scale, 1)", "''")}), ' x '), ' mm')
              WHEN NOT n_hedge THEN n_text END
            WHEN n_fam = 'poles' THEN coalesce(CAST(try_cast(n_one AS INT) AS STRING), n_text)
            WHEN n_fam = 'trip' THEN coalesce(concat('Class ', n_one), n_text)
            WHEN n_fam = 'power' THEN coalesce(concat({number}, ' ', n_unit), n_text)
            WHEN n_fam = 'mounting' THEN CASE WHEN {rail} AND contains(n_low, '35') THEN 'DIN Rail (35mm)' WHEN {rail} THEN 'DIN Rail'
              WHEN contains(n_low, 'panel') THEN 'Panel Mount' WHEN contains(n_low, 'screw') THEN 'Screw Mounting' ELSE n_text END
            ELSE n_plain END"""},
        {"n_open": """coalesce(n_given AND (n_hedge OR (n_fam IN ('voltage', 'current', 'frequency') AND n_shown IS NULL)
            OR (n_fam = 'dimensions' AND n_scale IS NULL) OR (n_fam = 'poles' AND n_num IS NULL)), false)"""},
    )


RESULT = """named_struct('normalized_value', n_shown,
    'unit', CASE WHEN n_shown IS NOT NULL AND (NOT n_open OR n_fam = 'dimensions') THEN n_unit END,
    'numeric_value', CASE WHEN n_shown IS NOT NULL AND NOT n_open AND n_fam IN ('voltage', 'current', 'frequency', 'poles', 'power')
      THEN CASE WHEN n_fam = 'current' AND n_unit = 'mA' THEN n_num / 1000D ELSE n_num END END,
    'is_ambiguous', n_open, 'requires_review', n_open,
    'message', CASE WHEN NOT n_open THEN NULL
      WHEN n_hedge THEN concat(CASE WHEN n_fam = 'dimensions' THEN 'Ambiguous dimensions' ELSE concat('Ambiguous ', n_fam, ' value') END, r": '", n_text, r"'")
      WHEN n_fam = 'dimensions' THEN 'Unstandardized dimension format'
      WHEN n_fam <> 'poles' THEN concat('Could not parse ', n_fam, r": '", n_text, r"'") END)"""


def norms(df: DataFrame, attribute: str = "attribute", value: str = "value") -> DataFrame:
    """(attribute, value, norm) of each different pair: what ``with_norm`` takes as ``known`` once it is stored."""
    return with_norm(df.select(F.col(attribute).alias("attribute"), F.col(value).alias("value")).distinct())


def with_norm(df: DataFrame, attribute: str = "attribute", value: str = "value", out: str = "norm", known: DataFrame | None = None) -> DataFrame:
    """Adds the normalised form of each value, chosen by attribute name, as a struct.

    Every pattern is matched in its own column first, so it runs once per row and
    only for the family it belongs to. With ``known`` (of :func:`norms`, holding every pair of ``df``) it is looked up."""
    keep = [c for c in df.columns if c != out]
    if known is not None:
        k = known.select(F.col("attribute").alias("k_attribute"), F.col("value").alias("k_value"), F.col("norm").alias(out))
        same = F.col(attribute).eqNullSafe(F.col("k_attribute")) & F.col(value).eqNullSafe(F.col("k_value"))
        return df.select(*keep).join(k, same, "left").select(*keep, out)
    d = df.select("*", strip(F.col(value)).alias("n_text"), family(F.col(attribute)).alias("n_fam"))
    plain = F.when(F.col("n_fam") == "generic", resolve_tokens(F.col("n_text"))).alias("n_plain")
    given = (F.col(value).isNotNull() & ((F.col("n_text") != "") | (F.col("n_fam") == "generic"))).alias("n_given")
    d = _staged(d.select("*", plain, given), *_stages())
    # A generator ends the chain: a later filter on the result would otherwise be pushed
    # down through every step, each step's text copied into it.
    return d.select(*keep, F.explode_outer(F.array(F.expr(RESULT))).alias(out))


def resolve_tokens(s: Column) -> Column:
    """Trade abbreviations spelled out, inch marks written as `` in``."""
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(vocab.TOKEN_ALIASES.items())])
    words = F.split(squeeze(strip(s)), " ")
    spelled = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(names, F.lower(w)), w)), " ")
    return F.regexp_replace(spelled, r'(\d(?:/\d+|\.\d+)?)"', "$1 in")


def fraction_text(token: Column) -> Column:
    """``0.5`` -> ``1/2`` for halves to thirty-seconds; other decimals unchanged.

    Denominators are tried from small to large, so the first hit is reduced."""
    value = token.try_cast("double")
    whole = F.floor(value)
    rest = value - whole
    out = F.when(value.isNull(), token).when(rest == 0, whole.cast("string"))
    for den in (2, 4, 8, 16, 32):
        top = F.rint(rest * den)
        near = F.abs(rest - top / den) < 1e-6
        ratio = F.concat(top.cast("int").cast("string"), F.lit(f"/{den}"))
        out = (out.when(near & (top == 0), whole.cast("string"))
               .when(near & (top == den), (whole + 1).cast("string"))
               .when(near & (whole > 0), F.concat(whole.cast("string"), F.lit("-"), ratio))
               .when(near, ratio))
    return out.otherwise(token)


def fractions(text: Column) -> Column:
    """Every standalone decimal of a text written as a fraction where one fits."""
    between = F.split(text, PLAIN_DECIMAL, -1)
    tokens = F.regexp_extract_all(text, F.lit(PLAIN_DECIMAL), F.lit(0))
    pieces = F.zip_with(between, tokens, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(fraction_text(b), F.lit(""))))
    return F.array_join(pieces, "")


def spaced_unit(raw: Column) -> Column:
    """``24in`` -> ``24 in``; unknown units keep their spelling."""
    s = strip(raw)
    pattern = r"""^([\d.\-/]+)\s*([a-zA-Z.'"°]+)?$"""
    number, unit = F.regexp_extract(s, pattern, 1), _hit(s, pattern, 2)
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(vocab.UNIT_NAMES.items())])
    known = F.coalesce(F.try_element_at(names, F.lower(unit)), unit)
    return F.when(unit.isNotNull(), F.concat(number, F.lit(" "), known)).otherwise(s)


def normalize_measure(raw: Column, default_unit: str = "in") -> Column:
    """Measure with a default unit, fractions and a spaced standard unit."""
    bare = F.btrim(F.btrim(strip(raw), F.lit('"')), F.lit("'"))
    named = F.when(bare.rlike("[a-zA-Z\"'′″]"), bare).otherwise(F.concat(bare, F.lit(f" {default_unit}")))
    return F.when(bare == "", raw).otherwise(spaced_unit(fractions(named)))


def with_refined(df: DataFrame, attribute: str = "attribute", value: str = "value", out: str = "norm") -> DataFrame:
    """As :func:`with_norm`, followed by fractions and unit spelling."""
    d = with_norm(df, attribute, value, out)
    d = d.withColumn("f_text", F.coalesce(F.col(f"{out}.normalized_value"), F.col(value)))
    d = d.withColumn("f_text", fractions(F.col("f_text"))).withColumn("f_text", spaced_unit(F.col("f_text")))
    return d.withColumn(out, F.col(out).withField("normalized_value", F.col("f_text"))).drop("f_text")
