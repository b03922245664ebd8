"""Secret scans: places of credentials in texts, and what the whole corpus says about their owners. DataFrame functions only.

Three kinds of matches are always reported: assignments to a secret's name, access keys and hex runs. Spark has no function that tells
places of matches, but cutting a text at a pattern leaves the gaps between its matches, so running sums of gaps and matches are the places. They are
taken over rows, one for each match, so a text may hold any number. What a match names, and every run of letters and digits with enough of both, is a
candidate. Candidates leave the scan as hashes only.

For all documents, candidates are reduced to distinct (hash, owner, repository), then to (hash, owner), then to hash; each step adds up in the
tasks before its shuffle, so a value that a third of all documents hold is a few rows a task. A value with ``WIDE`` owners or more is a widely copied example. One that
a single owner has, in however many repositories, and that looks drawn at random is live: its place is added to the spans. In the given
tables a document is a repository and its source the owner.

Cases: a null text is empty; a text of any length is scanned whole; rows that repeat an id and text are one repository and get equal results; a null owner or
repository counts as one unknown of its kind; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import KEY, row_key, stage

# The patterns of the contract. Access keys and hex runs are as long as they can be where they start, so asking for
# the least length in the pattern drops the same matches as asking afterwards; an assignment's end has to be dropped afterwards.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
ASSIGNED = 6  # least length of what is assigned
# Runs that are only candidates: no mark or letter beside them, a digit among them.
RUN = r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])([A-Za-z0-9]{20,})"
KINDS = ["assign", "access", "hex", "run"]
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, RUN)))
LIVE = "live"

WIDE = 3  # owners from which a value is an example
LENGTH, VARIETY, EACH = 16, 8, 3  # least length of a live value, different characters, and digits and letters each
PLACEHOLDER = "example|sample|dummy|changeme|placeholder|your|xxxx|0123456789|123456789|abcdef"


def matches(docs: DataFrame) -> DataFrame:
    """(key, repository, owner, and for each kind the gaps before its matches, their lengths and values) of rows with a match."""
    def of(kind: str) -> Column:
        pattern = PATTERNS[kind]
        gaps = F.transform(F.split("text", pattern, -1), F.length)
        whole, value = (F.regexp_extract_all("text", F.lit(pattern), F.lit(k)) for k in (0, 1))
        found = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), F.transform(whole, F.length).alias("length"), value.alias("value"))
        return F.when(F.col("text").rlike(pattern), found).alias(kind)

    some = F.lit(False)
    for pattern in PATTERNS.values():
        some = some | F.col("text").rlike(pattern)
    return docs.where(some).select(*KEY, "repository", "owner", *map(of, KINDS))


def digest(value: Column) -> Column:
    return F.unhex(F.sha2(value.cast("binary"), 256))


def looks_live(value: Column) -> Column:
    characters = F.split(value, "")
    count = lambda test: F.size(F.filter(characters, lambda c: c.rlike(test)))
    return ((F.length(value) >= LENGTH) & (F.size(F.array_distinct(characters)) >= VARIETY) & (count("[0-9]") >= EACH) & (count("[A-Za-z]") >= EACH)
            & ~F.lower(value).rlike(PLACEHOLDER))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repositories, owners) of every candidate in rows (hash, repository, owner)."""
    one = found.select("hash", "owner", "repository").distinct()
    of_owner = one.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return of_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def located(found: DataFrame) -> DataFrame:
    """(key, kind, start, stop, from, hash, live) of every match in rows of ``matches``: its place, where its value starts, and the value's hash."""
    every = None
    for kind in KINDS:
        some = found.where(F.col(kind).isNotNull()).select(*KEY, F.lit(KINDS.index(kind)).alias("kind"), F.posexplode(kind).alias("nth", "m")).select(*KEY, "kind", "nth", "m.*")
        every = some if every is None else every.unionAll(some)
    stop = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy(*KEY, "kind").orderBy("nth"))
    every = every.withColumn("stop", stop).where((F.col("kind") != 0) | (F.length("value") >= ASSIGNED))
    return every.select(*KEY, "kind", (F.col("stop") - F.col("length")).alias("start"), "stop", (F.col("stop") - F.length("value")).alias("from"), digest(F.col("value")).alias("hash"), looks_live(F.col("value")).alias("live"))


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_spans, spans (with live ones), n_live, n_example (places of widely copied values)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(F.col("doc_id"), F.coalesce("text", F.lit(""))), F.col(repository).cast("string").alias("repository"),
                       F.col(owner).cast("string").alias("owner"), F.coalesce("text", F.lit("")).alias("text"))
    found = stage(matches(rows), "matches")
    at = stage(located(found.dropDuplicates(KEY)), "located")
    # owners of a text are those of all rows with it
    holders = found.select(*KEY, "repository", "owner").distinct()
    verdicts = ownership(at.select(*KEY, "hash").distinct().join(holders, KEY))
    verdicts = verdicts.where(f"owners = 1 OR owners >= {WIDE}").select("hash", (F.col("owners") >= WIDE).alias("example"))
    judged = at.join(verdicts, "hash", "left")
    span = lambda name, start: F.struct(F.col(start).alias("start"), F.lit(KINDS.index(name) if name in KINDS else len(KINDS)).alias("kind"), F.concat(F.lit(name + ":"), start, F.lit(":"), "stop").alias("told"))
    base = F.when(F.col("kind") == 0, span("assign", "start")).when(F.col("kind") == 1, span("access", "start")).when(F.col("kind") == 2, span("hex", "start"))
    live = F.when(F.col("live") & ~F.col("example"), span(LIVE, "from"))
    example = F.when(F.col("example"), F.struct("from", "stop"))
    sums = judged.groupBy(*KEY).agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:3])),
                                    F.collect_list(base).alias("base"), F.collect_set(live).alias("live"), F.size(F.collect_set(example)).cast("long").alias("n_example"))
    told = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: s["told"]), ",")
    sums = sums.select(*KEY, "n_assign", "n_access", "n_hex", told(F.col("base")).alias("base_spans"), told(F.concat("base", "live")).alias("spans"), F.size("live").cast("long").alias("n_live"), "n_example")
    out = rows.select("doc_id", *KEY).join(sums, KEY, "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex")), *(F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")),
                      *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_live", "n_example")))


def _sql() -> str:
    text = lambda p: "'" + p.replace("'", "''") + "'"
    plain = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "run": "([A-Za-z0-9]{20,})"}  # no look-around here; runs without a digit are left out below
    found = " UNION ALL ".join(f"SELECT r, {k} AS k, string_split_regex(t, {text(p)}) AS g, regexp_extract_all(t, {text(p)}, 0) AS m, regexp_extract_all(t, {text(p)}, 1) AS v FROM d WHERE regexp_matches(t, {text(p)})"
                               for k, p in enumerate(plain.values()))
    count = lambda chars: f"length(regexp_replace(v, '[^{chars}]', '', 'g'))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({found}),
e AS (SELECT r, k, m[i] AS m, v[i] AS v, list_sum(list_transform(g[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0)::BIGINT AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f)),
h AS (SELECT r, k, v, s, s + length(m) AS stop, s + length(m) - length(v) AS a FROM e WHERE (k <> 0 OR length(v) >= {ASSIGNED}) AND (k <> 3 OR regexp_matches(v, '[0-9]'))),
o AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS owners FROM h JOIN d USING (r) GROUP BY v),
j AS (SELECT h.*, owners >= {WIDE} AS wide, owners = 1 AND length(v) >= {LENGTH} AND len(list_distinct(string_split(v, ''))) >= {VARIETY} AND {count('0-9')} >= {EACH} AND {count('A-Za-z')} >= {EACH}
    AND NOT regexp_matches(lower(v), '{PLACEHOLDER}') AS live FROM h JOIN o USING (v)),
x AS (SELECT r, k, s, ['assign', 'access', 'hex'][k + 1] || ':' || s || ':' || stop AS told FROM j WHERE k < 3),
l AS (SELECT DISTINCT r, 4 AS k, a AS s, 'live:' || a || ':' || stop AS told FROM j WHERE live),
b AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(told, ',' ORDER BY s, k, told) AS base FROM x GROUP BY r),
a AS (SELECT r, string_agg(told, ',' ORDER BY s, k, told) AS spans, count(*) FILTER (k = 4) AS n_live FROM (SELECT * FROM x UNION ALL SELECT * FROM l) GROUP BY r),
w AS (SELECT r, count(DISTINCT (a, stop)) AS n_example FROM j WHERE wide GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r) LEFT JOIN w USING (r)
"""


SQL = _sql()
