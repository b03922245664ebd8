"""The same views as DuckDB SQL, plus SQL forms of the shared expressions.

``with_views(sql)`` prefixes a query with the CTEs it (transitively) names."""

from __future__ import annotations

import re

from shelfmark.functions import vocab
from workload import views as v

BLANKS = r"' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def squeeze(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', ' ', 'g')"


def no_blank(x: str) -> str:
    return f"nullif({x}, '')"


def clean_category(x: str) -> str:
    return (f"CASE WHEN {strip(x)} <> '' AND lower({strip(x)}) NOT IN {in_list(vocab.PLACEHOLDERS)} THEN {squeeze(strip(x))} END")


def clean(x: str) -> str:
    return rf"regexp_replace({clean_category(x)}, '[\x00-\x1f\x7f]', '', 'g')"


def hit(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {lit(pattern)}, {group}), '')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def resolved(x: str) -> str:
    return f"coalesce(lower({strip(x)}) NOT IN {in_list(vocab.UNRESOLVED_WORDS)}, false)"


def valid(x: str) -> str:
    t = f"lower({strip(x)})"
    return f"coalesce({x} <> '' AND {t} NOT IN {in_list(vocab.TEXT_STOP_VALUES)} AND NOT {has(t, vocab.TEXT_STOP_WORD)}, false)"


def export(x: str) -> str:
    t = strip(x)
    return f"CASE WHEN {t} IS NULL OR lower({t}) IN {in_list(vocab.EXPORT_BLANKS)} THEN '' ELSE {t} END"


def title(x: str) -> str:
    return (rf"array_to_string(list_transform(regexp_extract_all({x}, '[\p{{L}}]+|[^\p{{L}}]+'), "
            "lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '')")


def title_flat(x: str) -> str:
    return f"CASE WHEN upper({x}) <> lower({x}) AND (upper({x}) = {x} OR lower({x}) = {x}) THEN {title(x)} ELSE {x} END"


def num(x: str, raw: str = "NULL") -> str:
    return (f"coalesce(CASE WHEN {x} = floor({x}) THEN CAST(TRY_CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END, {raw})")


def dbl(x: str) -> str:
    return f"TRY_CAST({x} AS DOUBLE)"


def score(x: str, digits: int) -> str:
    return f"round_even(round({x}, 8), {digits})"


def share(a: str, b: str, digits: int = 2) -> str:
    return f"coalesce({score(f'CAST({a} AS DOUBLE) / nullif({b}, 0)', digits)}, 0.0)"


DECIMAL = r"\d+(?:\.\d+)?"
SIGNED = r"(?:^|[^0-9./])(-?(?:\d+-\d+/\d+|\d+/\d+|\d+(?:\.\d+)?|\.\d+))"
COUNTED = r"(?:^|[^0-9.])(-?(?:\d+(?:\.\d+)?|\.\d+))"


def parse_number(t: str) -> str:
    whole = rf"CASE WHEN {has(t, r'^-?\d+-\d+/\d+$')} THEN {dbl(hit(t, r'^(-?\d+)-'))} END"
    frac = f"({dbl(hit(t, r'(\d+)/\d+$'))} / nullif({dbl(hit(t, r'/(\d+)$'))}, 0))"
    sign = f"CASE WHEN ({whole}) < 0 OR (({whole}) IS NULL AND starts_with({t}, '-')) THEN -1.0 ELSE 1.0 END"
    return f"CASE WHEN contains({t}, '/') THEN coalesce({whole}, 0.0) + ({sign}) * {frac} ELSE {dbl(t)} END"


def signed_numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {lit(SIGNED)}, 1), lambda t: {parse_number('t')})"


def plain_numbers(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {lit(COUNTED)}, 1), lambda t: {dbl('t')})"


def hedged(x: str) -> str:
    return any_of(f"lower({x})", vocab.HEDGES)


def resolve_tokens(x: str) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(val)}" for k, val in vocab.TOKEN_ALIASES.items())
    words = f"string_split({squeeze(strip(x))}, ' ')"
    spelled = f"array_to_string(list_transform({words}, lambda w: CASE lower(w) {cases} ELSE w END), ' ')"
    return rf"regexp_replace({spelled}, '(\d(?:/\d+|\.\d+)?)" + '"' + r"', '\1 in', 'g')"


def fraction_text(t: str) -> str:
    x, w = dbl(t), f"floor({dbl(t)})"
    r = f"({x} - {w})"
    whole = f"CAST(CAST({w} AS BIGINT) AS VARCHAR)"
    out = f"CASE WHEN {x} IS NULL THEN {t} WHEN {r} = 0 THEN {whole} "
    for den in (2, 4, 8, 16, 32):
        top = f"round_even({r} * {den}, 0)"
        near = f"abs({r} - {top} / {den}) < 1e-6"
        ratio = f"CAST(CAST({top} AS INT) AS VARCHAR) || '/{den}'"
        out += (f"WHEN {near} AND {top} = 0 THEN {whole} WHEN {near} AND {top} = {den} THEN CAST(CAST({w} + 1 AS BIGINT) AS VARCHAR) "
                f"WHEN {near} AND {w} > 0 THEN {whole} || '-' || {ratio} WHEN {near} THEN {ratio} ")
    return out + f"ELSE {t} END"


def fractions(x: str) -> str:
    p = r"'\b\d+\.\d+\b'"
    return (f"array_to_string(list_transform(list_zip(string_split_regex({x}, {p}), regexp_extract_all({x}, {p})), "
            f"lambda z: coalesce(z[1], '') || coalesce({fraction_text('z[2]')}, '')), '')")


def spaced_unit(x: str) -> str:
    s = strip(x)
    p = r"""^([\d.\-/]+)\s*([a-zA-Z.'"°]+)?$"""
    unit = hit(s, p, 2)
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(val)}" for k, val in vocab.UNIT_NAMES.items())
    return f"CASE WHEN {unit} IS NOT NULL THEN regexp_extract({s}, {lit(p)}, 1) || ' ' || CASE lower({unit}) {cases} ELSE {unit} END ELSE {s} END"


def measure(x: str, default: str = "in") -> str:
    bare = f"trim(trim({strip(x)}, '\"'), '''')"
    named = f"CASE WHEN regexp_matches({bare}, '[a-zA-Z\"''′″]') THEN {bare} ELSE {bare} || ' {default}' END"
    return f"CASE WHEN {bare} = '' THEN {x} ELSE {spaced_unit(fractions(named))} END"


def norm_ctes(source: str, name: str, attr: str = "attribute", value: str = "value") -> str:
    """Select list computing z (normalised), u (unit), n (number), amb, msg from a source table."""
    s = "s_"
    kind = (f"CASE WHEN {has(s, r'(?i)vac|v\s*ac|\bac\b|\ba\.c\.')} THEN ' AC' "
            f"WHEN {has(s, r'(?i)vdc|v\s*dc|\bdc\b|\bd\.c\.')} THEN ' DC' ELSE '' END")
    kilo = f"contains(lower({s}), 'kv')"
    vr = rf"(?i)({DECIMAL})\s*(?:-|/|to)\s*({DECIMAL})"
    cr = rf"(?i)({DECIMAL})\s*(?:-|/|to|\.\.\.)\s*({DECIMAL})"
    one = r"(?i)(\d+(?:\.\d+)?)\s*(m?a(?:mps?|mperes?)?)\b"
    pw = r"(?i)(\d+(?:\.\d+)?)\s*(kw|kilowatts?|hp|horsepower)\b"

    def volts(t):
        return f"CASE WHEN {kilo} THEN {num(f'round({dbl(t)} * 1000.0, 9)', t)} ELSE {t} END"

    vn = f"round({dbl(hit(s, f'({DECIMAL})'))} * CASE WHEN {kilo} THEN 1000.0 ELSE 1.0 END, 9)"
    cu = f"CASE WHEN contains(lower({hit(s, one, 2)}), 'ma') THEN 'mA' ELSE 'A' END"
    cn = dbl(hit(s, one, 1))
    fz = rf"(?i)({DECIMAL})\s*(?:hz|hertz)\b"
    fn = dbl(hit(s, fz))
    scale = f"CASE WHEN {has(s, '(?i)cm|centimeter')} THEN 10.0 WHEN {has(s, '(?i)inch|inches|' + chr(92) + 'bin' + chr(92) + 'b|' + chr(34))} THEN 25.4 ELSE 1.0 END"
    sizes = f"list_filter({signed_numbers(s)}, lambda q: q > 0)"
    pn = f"TRY_CAST({hit(s, r'(\d+)')} AS INT)"
    tc = hit(s, r"(?i)(?:trip\s*class|class)?\s*(\d+[A-Za-z]?)\b")
    pd = dbl(hit(s, pw, 1))
    pu = f"CASE WHEN starts_with(lower({hit(s, pw, 2)}), 'h') THEN 'HP' ELSE 'kW' END"
    low = f"lower({s})"
    return f"""
    SELECT * EXCLUDE (s_, fam), z_.z AS z, z_.u AS u, CAST(z_.n AS DOUBLE) AS n, coalesce(z_.amb, false) AS amb, z_.msg AS msg FROM (
      SELECT *, CASE WHEN {value} IS NULL OR (s_ = '' AND fam <> 'generic') THEN {{'z': NULL::VARCHAR, 'u': NULL::VARCHAR, 'n': NULL::DOUBLE, 'amb': false, 'msg': NULL::VARCHAR}}
        WHEN fam IN ('voltage','current','frequency') AND {hedged(s)} THEN {{'z': NULL, 'u': NULL, 'n': NULL, 'amb': true, 'msg': 'Ambiguous ' || fam || ' value: ''' || s_ || ''''}}
        WHEN fam = 'voltage' THEN CASE
          WHEN {hit(s, vr)} IS NOT NULL THEN {{'z': {volts(hit(s, vr, 1))} || '-' || {volts(hit(s, vr, 2))} || ' V' || {kind}, 'u': 'V', 'n': NULL, 'amb': false, 'msg': NULL}}
          WHEN {vn} IS NOT NULL THEN {{'z': {num(vn, hit(s, f'({DECIMAL})'))} || ' V' || {kind}, 'u': 'V', 'n': {vn}, 'amb': false, 'msg': NULL}}
          ELSE {{'z': NULL, 'u': NULL, 'n': NULL, 'amb': true, 'msg': 'Could not parse voltage: ''' || s_ || ''''}} END
        WHEN fam = 'current' THEN CASE
          WHEN {hit(s, cr)} IS NOT NULL THEN {{'z': {hit(s, cr, 1)} || '-' || {hit(s, cr, 2)} || ' ' || CASE WHEN {has(s, r'(?i)\d\s*ma\b')} THEN 'mA' ELSE 'A' END, 'u': CASE WHEN {has(s, r'(?i)\d\s*ma\b')} THEN 'mA' ELSE 'A' END, 'n': NULL, 'amb': false, 'msg': NULL}}
          WHEN {cn} IS NOT NULL THEN {{'z': {num(cn, hit(s, one, 1))} || ' ' || {cu}, 'u': {cu}, 'n': CASE WHEN {cu} = 'A' THEN {cn} ELSE {cn} / 1000.0 END, 'amb': false, 'msg': NULL}}
          WHEN {has(s, f'^{DECIMAL}$')} THEN {{'z': {num(dbl(s), s)} || ' A', 'u': 'A', 'n': {dbl(s)}, 'amb': false, 'msg': NULL}}
          ELSE {{'z': NULL, 'u': NULL, 'n': NULL, 'amb': true, 'msg': 'Could not parse current: ''' || s_ || ''''}} END
        WHEN fam = 'frequency' THEN CASE
          WHEN {has(s, r'(?i)50\s*(?:/|-|to|or|,)\s*60\s*(?:hz|hertz)?')} THEN {{'z': '50/60 Hz', 'u': 'Hz', 'n': NULL, 'amb': false, 'msg': NULL}}
          WHEN {fn} IS NOT NULL THEN {{'z': {num(fn, hit(s, fz))} || ' Hz', 'u': 'Hz', 'n': {fn}, 'amb': false, 'msg': NULL}}
          WHEN s_ IN ('50','60','400') THEN {{'z': s_ || ' Hz', 'u': 'Hz', 'n': {dbl(s)}, 'amb': false, 'msg': NULL}}
          ELSE {{'z': NULL, 'u': NULL, 'n': NULL, 'amb': true, 'msg': 'Could not parse frequency: ''' || s_ || ''''}} END
        WHEN fam = 'dimensions' THEN CASE
          WHEN {hedged(s)} THEN {{'z': NULL, 'u': NULL, 'n': NULL, 'amb': true, 'msg': 'Ambiguous dimensions: ''' || s_ || ''''}}
          WHEN len({sizes}) IN (2, 3) THEN {{'z': array_to_string(list_transform({sizes}, lambda q: {num(f'round_even(q * ({scale}), 1)')}), ' x ') || ' mm', 'u': 'mm', 'n': NULL, 'amb': false, 'msg': NULL}}
          ELSE {{'z': s_, 'u': 'mm', 'n': NULL, 'amb': true, 'msg': 'Unstandardized dimension format'}} END
        WHEN fam = 'poles' THEN CASE
          WHEN {pn} IS NOT NULL THEN {{'z': CAST({pn} AS VARCHAR), 'u': 'poles', 'n': CAST({pn} AS DOUBLE), 'amb': false, 'msg': NULL}}
          ELSE {{'z': s_, 'u': NULL, 'n': NULL, 'amb': true, 'msg': NULL}} END
        WHEN fam = 'trip' THEN {{'z': coalesce('Class ' || upper({tc}), s_), 'u': NULL, 'n': NULL, 'amb': false, 'msg': NULL}}
        WHEN fam = 'power' THEN CASE
          WHEN {pd} IS NOT NULL THEN {{'z': {num(pd, hit(s, pw, 1))} || ' ' || {pu}, 'u': {pu}, 'n': {pd}, 'amb': false, 'msg': NULL}}
          ELSE {{'z': s_, 'u': NULL, 'n': NULL, 'amb': false, 'msg': NULL}} END
        WHEN fam = 'mounting' THEN {{'z': CASE WHEN contains({low}, 'din') AND contains({low}, 'rail') AND contains({low}, '35') THEN 'DIN Rail (35mm)'
          WHEN contains({low}, 'din') AND contains({low}, 'rail') THEN 'DIN Rail' WHEN contains({low}, 'panel') THEN 'Panel Mount'
          WHEN contains({low}, 'screw') THEN 'Screw Mounting' ELSE s_ END, 'u': NULL, 'n': NULL, 'amb': false, 'msg': NULL}}
        ELSE {{'z': {resolve_tokens(value)}, 'u': NULL, 'n': NULL, 'amb': false, 'msg': NULL}} END AS z_
      FROM (SELECT *, {strip(value)} AS s_, CASE WHEN contains(lower({attr}), 'voltage') THEN 'voltage' WHEN contains(lower({attr}), 'current') THEN 'current'
        WHEN contains(lower({attr}), 'frequency') THEN 'frequency' WHEN contains(lower({attr}), 'dimension') OR contains(lower({attr}), 'size') THEN 'dimensions'
        WHEN contains(lower({attr}), 'pole') THEN 'poles' WHEN contains(lower({attr}), 'trip') THEN 'trip' WHEN contains(lower({attr}), 'power') THEN 'power'
        WHEN contains(lower({attr}), 'mounting') THEN 'mounting' ELSE 'generic' END AS fam FROM {source}) {name}_in) {name}_z"""


def _select(columns: dict[str, str], source: str) -> str:
    def duck(sql: str) -> str:
        return sql.replace("AS STRING", "AS VARCHAR")

    return "SELECT " + ", ".join(f"{duck(sql)} AS {name}" for name, sql in columns.items()) + f" FROM {source}"


NAME_CODE = r"^(.*?)\s*\(([^)]+)\)\s*$"


def strip_suffixes(x: str) -> str:
    for suffix in vocab.COMPANY_SUFFIXES:
        x = strip(f"regexp_replace({x}, {lit(suffix.replace('.', chr(92) + '.') + '$')}, '')")
    return x


def entity_parts(source: str, raw: str) -> str:
    s = strip(raw)
    coded = has(s, NAME_CODE)
    return f"""SELECT *, CASE WHEN NOT r_void THEN {strip('regexp_replace(' + strip(squeeze('lower(r_name)')) + ", '[.,;:]+$', '')")} END AS r_key FROM (
        SELECT *, coalesce({s} = '' OR lower({strip('r_name')}) IN {in_list(vocab.RESOLVER_PLACEHOLDERS)} OR lower({s}) IN {in_list(vocab.RESOLVER_PLACEHOLDERS)}, true) AS r_void
        FROM (SELECT *, CASE WHEN {coded} THEN {strip(f'regexp_extract({s}, {lit(NAME_CODE)}, 1)')} ELSE {s} END AS r_name,
          CASE WHEN {coded} THEN {strip(f'regexp_extract({s}, {lit(NAME_CODE)}, 2)')} END AS r_code FROM {source}))"""


VIEWS: dict[str, str] = {
    "feed0": _select(v.FEED_SQL, "part"),
    "feed": """SELECT product_id, part_number, manufacturer, category, description,
        CASE WHEN product_id % 3 = 0 THEN '-- No Brand --' ELSE variant END AS E1_Brand,
        CASE WHEN product_id % 6 = 0 THEN 'n/a' WHEN product_id % 2 = 0 THEN '' ELSE variant END AS Unilog_Brand,
        variant AS DIB_Brand, variant AS brand FROM feed0""",
    "clean_feed": f"""SELECT product_id, {clean('part_number')} AS part_number,
        coalesce({clean('E1_Brand')}, {clean('Unilog_Brand')}, {clean('DIB_Brand')}) AS brand, {clean('manufacturer')} AS manufacturer,
        {clean('description')} AS description, {clean_category('category')} AS category FROM feed""",
    "mined": f"SELECT *, {strip(chr(34) + 'x' + chr(34))} AS text FROM (SELECT *, coalesce(part_number, '') || ' ' || coalesce(description, '') AS x FROM clean_feed)",
    "brand_master": f"SELECT CAST(i AS BIGINT) AS ord, 'brand#' || i AS key, 'Brand#' || i AS canonical FROM range(1, {v.N_BRANDS + 1}) r(i)",
    "maker_master": f"SELECT CAST(i AS BIGINT) AS ord, 'maker ' || i AS key, 'Maker ' || i AS canonical, 'M' || i AS code FROM range(0, {v.N_MAKERS}) r(i)",
    "claims": _select(v.CLAIM_SQL, "lineitem"),
    "products": _select(v.PRODUCT_SQL, "part"),
    "decisions": _select(v.DECISION_SQL, "events").replace(" FROM events", r", CASE WHEN event_type = 'purchase' AND event_id % 9 <> 0 THEN regexp_extract(props, '(\d+)', 1) || ' V' END AS selected_value FROM events"),
    "docs": "SELECT doc_id AS document_id, source || ' manual.pdf' AS document_name, source, doc_id AS product_id, 1 AS page_number, "
            + v.DOC_TEXT_SQL.replace("AS STRING", "AS VARCHAR") + " AS text FROM documents",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    known = {**VIEWS, **(extra or {})}
    need: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if re.search(rf"\b{name}\b", text) and name not in need:
                # a view's own name inside its text is a base column or table
                visit(re.sub(rf"\b{name}\b", "", known[name]))
                if name not in need:
                    need.append(name)

    visit(sql)
    if not need:
        return sql
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in need) + "\n" + sql


def prefix_hits(names: str, master: str, shortest: int, two_way: bool) -> str:
    """First alias by ord sharing a prefix with each open name."""
    match = "starts_with(m.key, k)" + (f" OR (length(m.key) >= {shortest} AND starts_with(k, m.key))" if two_way else "")
    values = "arg_min(m.canonical, m.ord) AS canonical" + (", arg_min(m.code, m.ord) AS code" if two_way else "")
    return (f"SELECT k, {values} FROM (SELECT DISTINCT {names.split('|')[1]} AS k FROM {names.split('|')[0]}) JOIN {master} m ON {match} "
            f"WHERE length(k) >= {shortest} GROUP BY k")


RES_BRAND = """SELECT {raw} AS raw_value, product_id, CASE WHEN {strip} <> '' THEN r_name END AS raw_name, r_code AS raw_code, r_key AS normalized_value,
    CASE WHEN NOT r_void THEN coalesce(xc, sc, pc, {title}) END AS canonical_value,
    CASE WHEN r_void THEN 0.0 WHEN xc = r_name THEN 0.98 WHEN xc IS NOT NULL THEN 0.95 WHEN sc IS NOT NULL THEN 0.90 WHEN pc IS NOT NULL THEN 0.75 ELSE 0.40 END::DOUBLE AS confidence,
    CASE WHEN r_void THEN 'UNRESOLVED' WHEN xc = r_name THEN 'EXACT' WHEN xc IS NOT NULL OR sc IS NOT NULL THEN 'NORMALIZED' WHEN pc IS NOT NULL THEN 'FUZZY' ELSE 'UNRESOLVED' END AS match_type,
    CASE WHEN r_void THEN 'UNRESOLVED' WHEN xc IS NOT NULL OR sc IS NOT NULL THEN 'RESOLVED' WHEN pc IS NOT NULL THEN 'LOW_CONFIDENCE' ELSE 'UNRESOLVED' END AS status
    FROM (SELECT p.*, x.canonical AS xc, s.canonical AS sc, CASE WHEN x.key IS NULL AND s.key IS NULL THEN f.canonical END AS pc
      FROM {parts} p LEFT JOIN brand_master x ON p.r_key = x.key LEFT JOIN brand_master s ON p.r_bare = s.key LEFT JOIN {prefix} f ON p.r_key = f.k)"""


def _brand_views(tag: str, source: str, raw: str) -> dict[str, str]:
    return {
        f"{tag}_parts": f"SELECT *, {strip_suffixes('r_key')} AS r_bare FROM ({entity_parts(source, raw)})",
        f"{tag}_prefix": prefix_hits(f"{tag}_parts|r_key", "brand_master", 3, False),
        f"{tag}_res": RES_BRAND.format(raw=raw, strip=strip(raw), title=title_flat("r_name"), parts=f"{tag}_parts", prefix=f"{tag}_prefix"),
    }


VIEWS |= _brand_views("brand", "feed", "brand")
VIEWS |= _brand_views("cbrand", "clean_feed", "brand")
VIEWS |= {
    "mfr_parts": f"SELECT *, {strip_suffixes('r_key')} AS r_bare FROM ({entity_parts('feed', 'manufacturer')})",
    "mfr_prefix": prefix_hits("mfr_parts|r_key", "maker_master", 4, True),
    "mfr_codes": "SELECT lower(code) AS k, arg_min(canonical, ord) AS canonical, arg_min(code, ord) AS code FROM maker_master WHERE code <> '' GROUP BY 1",
    "mfr_res": f"""SELECT product_id, manufacturer AS raw_value, CASE WHEN {strip('manufacturer')} <> '' THEN r_name END AS raw_name,
        coalesce(r_code, xcode, scode, pcode) AS raw_code, r_key AS normalized_value,
        CASE WHEN NOT r_void THEN coalesce(xc, sc, cc, pc, {title_flat('r_name')}) END AS canonical_value,
        CASE WHEN r_void THEN 0.0 WHEN xc IS NOT NULL OR sc IS NOT NULL THEN 0.95 WHEN cc IS NOT NULL THEN 0.90 WHEN pc IS NOT NULL THEN 0.78 ELSE 0.40 END::DOUBLE AS confidence,
        CASE WHEN r_void THEN 'UNRESOLVED' WHEN xc IS NOT NULL OR sc IS NOT NULL OR cc IS NOT NULL THEN 'NORMALIZED' WHEN pc IS NOT NULL THEN 'FUZZY' ELSE 'UNRESOLVED' END AS match_type,
        CASE WHEN r_void THEN 'UNRESOLVED' WHEN xc IS NOT NULL OR sc IS NOT NULL OR cc IS NOT NULL THEN 'RESOLVED' WHEN pc IS NOT NULL THEN 'LOW_CONFIDENCE' ELSE 'UNRESOLVED' END AS status
        FROM (SELECT p.*, x.canonical AS xc, x.code AS xcode, s.canonical AS sc, s.code AS scode,
            CASE WHEN x.key IS NULL AND s.key IS NULL AND NOT p.r_void THEN c.canonical END AS cc,
            CASE WHEN x.key IS NULL AND s.key IS NULL AND c.k IS NULL THEN f.canonical END AS pc,
            CASE WHEN x.key IS NULL AND s.key IS NULL AND c.k IS NULL THEN f.code END AS pcode
          FROM mfr_parts p LEFT JOIN maker_master x ON p.r_key = x.key LEFT JOIN maker_master s ON p.r_bare = s.key
          LEFT JOIN mfr_codes c ON lower(p.r_code) = c.k LEFT JOIN mfr_prefix f ON p.r_key = f.k)""",
    "claims_z": f"SELECT *, coalesce(nullif(CASE WHEN u = 'mA' AND n IS NOT NULL THEN {num('n')} || ' A' ELSE z END, ''), {strip('value')}) AS canonical FROM ({norm_ctes('claims', 'cz')})",
    "best": """SELECT * FROM (SELECT product_id, attribute, value, source_name, similarity, count(*) OVER w AS n_claims, min(claim_ord) OVER w AS attr_ord,
        row_number() OVER (PARTITION BY product_id, attribute ORDER BY similarity DESC, claim_ord) AS rn FROM claims
        WINDOW w AS (PARTITION BY product_id, attribute)) WHERE rn = 1""",
    "attributes": f"""SELECT product_id, attribute AS name, value, z AS normalized_value, u AS unit, amb AS is_ambiguous, attr_ord, n_claims,
        similarity AS confidence, CASE WHEN amb OR similarity < 0.9 THEN 'REQUIRES_REVIEW' ELSE 'VERIFIED' END AS status FROM ({norm_ctes('best', 'bz')})""",
    "cvalues": f"""SELECT product_id, attribute, canonical, min(claim_ord) AS first_ord, arg_min(value, claim_ord) AS first_raw, count(*) AS n_claims
        FROM claims_z WHERE {strip('value')} <> '' AND upper(value) <> 'UNKNOWN' GROUP BY ALL""",
    "found_conflicts": """SELECT product_id, attribute, count(*) AS n_values, CAST(sum(n_claims) AS BIGINT) AS n_claims, arg_min(first_raw, first_ord) AS first_value,
        CASE WHEN attribute IN ('voltage', 'current', 'poles') THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'OPEN' AS status,
        'conf_' || left(sha256(product_id || '|' || attribute), 12) AS conflict_id FROM cvalues GROUP BY ALL HAVING count(*) > 1""",
    "conflicts": """SELECT * EXCLUDE (status), CASE product_id % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'RESOLVED' ELSE 'DISMISSED' END AS status FROM found_conflicts""",
    "evidence": "SELECT product_id, attribute, evidence_id, source_name, source_name AS document_name, source_type, page_number, snippet, similarity FROM claims",
}
