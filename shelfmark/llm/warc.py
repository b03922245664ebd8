"""WARC revisits: every not-modified record gets the content of the latest earlier full response of its canonical URL.

An as-of join without a task that holds a whole URL: captures are dealt into ranges of (URL, time), so a URL with a third of all captures
spans many ranges. Inside a range, a window finds the last response before a revisit; for the first revisits of a range the last
response of earlier ranges is carried in, from one row for each URL and range. Only ids and validators take part; headers and payload
are joined at the end, by record id.

Records: record_id long, kind string (``response`` or ``revisit``), uri string, at long (any clock), status int, headers
map<string,string>, payload string. Validators are compared as in RFC 9110: entity tags weakly, then dates of last change; they decide
``outcome``: ``resolved``, ``unvalidated`` (no validator on both sides; content is still given), ``changed`` (they differ; no content),
``missing`` (no earlier response), ``no_url``. Merged headers are the stored response's, replaced by those of the revisit that RFC 9111
lets a 304 update.

Cases: full responses are those with status 200; a response at the revisit's own time isn't earlier; of responses at one time the one with
the greatest record id counts; null times or ids of responses can't be referred to and are left out; a revisit with null time is
``missing``; null headers are empty; header names differing in case are one (the last in order counts); repeated revisits each get a
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import lower_ascii, stage

# Header fields of a 304 that update a stored response (RFC 9111, section 3.2), and query fields that only track visitors.
UPDATES = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(uri: Column) -> Column:
    """host/path?query: no scheme, user, default port, fragment, leading ``www.`` or ``m.`` labels while two others are left, trailing slash or tracking fields; sorted query."""
    part = lambda k: F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(:\d+)?([^?#]*)(?:\?([^#]*))?", k)
    host = F.regexp_replace(lower_ascii(part(1)), r"^(?:(?:www|m)\.)+([^.]+\..*)$", "$1")
    port = F.when(part(2).isin(":80", ":443"), "").otherwise(part(2))
    fields = F.array_sort(F.filter(F.split(part(4), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    query = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise("")
    return F.when(part(1) != "", F.concat(host, port, F.regexp_replace(part(3), "/+$", ""), query))


def plain_headers(headers: Column) -> Column:
    """Header entries with lower-case names, one for each."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_sort(F.array_distinct(F.transform(entries, lambda e: lower_ascii(e["key"]))))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(entries, lambda e: lower_ascii(e["key"]) == n), -1)["value"].alias("value"))))


def validators(headers: Column) -> tuple[Column, Column]:
    return F.regexp_replace(headers["etag"], "^W/", ""), headers["last-modified"]


def merged_headers(stored: Column, update: Column) -> Column:
    new = F.map_filter(update, lambda k, _: k.isin(UPDATES))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def last_responses(events: DataFrame) -> DataFrame:
    """(record_id, url, at, source): for every revisit the last response of its URL before it; source is null without one."""
    order = ["url", "at", "full", "record_id"]
    dealt = stage(events.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "captures")
    source = F.when(F.col("full"), F.struct("record_id", "tag", "changed"))
    before = Window.partitionBy("part", "url").orderBy("at", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy("url", "part").agg(F.max_by(source, F.when(F.col("full"), F.struct("at", "record_id"))).alias("end"))
    ranges = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url", "part", F.last("end", ignorenulls=True).over(ranges).alias("carried")).where("carried IS NOT NULL")
    inside = dealt.withColumn("near", F.last(source, ignorenulls=True).over(before)).where(~F.col("full"))
    return inside.join(carried, ["url", "part"], "left").withColumn("source", F.coalesce("near", "carried"))


def resolve(records: DataFrame) -> DataFrame:
    """Per revisit: record_id, url, outcome, response_id, headers (merged), payload."""
    r = records.select(F.col("record_id").cast("long").alias("record_id"), "kind", canonical_url(F.col("uri")).alias("url"), F.col("at").cast("long").alias("at"), "status",
                       plain_headers(F.col("headers")).alias("headers"), "payload")
    tag, changed = validators(F.col("headers"))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    events = r.where("url IS NOT NULL AND at IS NOT NULL").where(F.coalesce(full & F.col("record_id").isNotNull(), F.lit(False)) | (F.col("kind") == "revisit"))
    found = last_responses(events.select("url", "at", full.alias("full"), "record_id", tag.alias("tag"), changed.alias("changed"), F.when(~full, F.col("headers")).alias("headers")))
    by_tag, by_date = F.col("tag") == F.col("source.tag"), F.col("changed") == F.col("source.changed")
    outcome = F.when(F.col("source").isNull(), "missing").when(F.coalesce(by_tag, by_date).isNull(), "unvalidated").when(F.coalesce(by_tag, by_date), "resolved").otherwise("changed")
    found = found.select("record_id", "url", outcome.alias("outcome"), F.col("source.record_id").alias("response_id"), F.col("headers").alias("update"))
    kept = F.col("outcome").isin("resolved", "unvalidated")
    # one row for a record id, should it come twice
    stored = r.where(full).groupBy(F.col("record_id").alias("response_id")).agg(F.max_by(F.struct("headers", "payload"), F.struct("at", F.xxhash64("payload"))).alias("stored"))
    out = found.join(stored, "response_id", "left").select(
        "record_id", "url", "outcome", "response_id", F.when(kept, merged_headers(F.col("stored.headers"), F.col("update"))).alias("headers"), F.when(kept, F.col("stored.payload")).alias("payload"))
    rest = r.where("kind = 'revisit' AND (url IS NULL OR at IS NULL)").select(
        "record_id", "url", F.when(F.col("url").isNull(), "no_url").otherwise("missing").alias("outcome"), F.lit(None).cast("long").alias("response_id"), F.lit(None).cast("map<string,string>").alias("headers"),
        F.lit(None).cast("string").alias("payload"))
    return out.unionByName(rest)


LATER = 5_000  # ids between a page's capture and its revisit


def page_records(pages: DataFrame) -> DataFrame:
    """Every page as a response at the time of its id, and a later revisit by another spelling of its URL with the validators seen then."""
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    text = lambda x: F.col(x).cast("string")
    response = pages.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("uri"), F.col("page_id").alias("at"), F.lit(200).alias("status"), F.create_map(
        F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), text("page_id"), F.lit("Content-Length"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")).alias("headers"),
        F.col("html").alias("payload"))
    later = (F.col("page_id") + LATER)
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.concat(F.regexp_replace("url", "^https?://", "HTTPS://WWW."), F.lit("#again")).alias("uri"),
                           later.alias("at"), F.lit(304).alias("status"), F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("DATE"), later.cast("string"), F.lit("Content-Length"), F.lit("0")).alias("headers"),
                           F.lit(None).cast("string").alias("payload"))
    return response.unionByName(revisit)


SQL = f"""
WITH p AS (SELECT page_id, html, url, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, octet_length(encode(coalesce(html, '')))::VARCHAR AS size,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(:\\d+)?([^?#]*)(?:\\?([^#]*))?', ['host', 'port', 'path', 'query']) AS u FROM pages),
c AS (SELECT page_id, html, tag, size, CASE WHEN u.host <> '' THEN lower(u.host) END AS host, CASE WHEN u.port IN (':80', ':443') THEN '' ELSE u.port END || regexp_replace(u.path, '/+$', '') ||
    CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS rest
    FROM (SELECT *, list_sort(list_filter(string_split(u.query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))) AS q FROM p)),
r AS (SELECT page_id, html, tag, size, regexp_replace(host, '^(?:(?:www|m)\\.)+([^.]+\\..*)$', '\\1') || rest AS url FROM c),
v AS (SELECT page_id, tag, page_id + {LATER} AS seen, url FROM r),
j AS (SELECT v.*, r.page_id AS source, r.tag AS stored, r.size AS size, r.html AS html FROM v ASOF LEFT JOIN r ON v.url = r.url AND v.seen > r.page_id)
SELECT page_id * 2 + 1 AS record_id, url, CASE WHEN url IS NULL THEN 'no_url' WHEN source IS NULL THEN 'missing' WHEN tag = stored THEN 'resolved' ELSE 'changed' END AS outcome, source * 2 AS response_id,
    CASE WHEN tag = stored THEN 'content-length: ' || size || '; content-type: text/html; date: ' || seen || '; etag: W/' || tag END AS headers,
    CASE WHEN tag = stored THEN sha256(html) END AS payload_sha256 FROM j
"""
