"""Benchmark decontamination by a distributed positional inverted index.

Test windows are ``WINDOW`` words of one item, or all words of a shorter item. Of each window the ``ANCHORS`` rarest terms, by their
count in the training corpus, are looked up: their postings (term, document, position) are stored once, and lists are intersected
after shifting positions by the term's offset in the window, rarest first. What is left is compared with the document's words, so
term hashes only propose. Proximity matches come from the same index: documents in which an item's rarest terms stand close.

The terms of the test set go to the scanning tasks if a count shows at most ``FEW_TERMS``; beyond that, all postings are made and
joined with the terms. A frequent passage only makes long posting lists, which are joined row by row, never gathered.

Cases: a null or empty text has no words, hits nothing and isn't contaminated; an item without words has no window; items with
one id, or windows with one text, count once, and items with null id hit words but have no id to list; repeated rows and null or
repeated document ids get results row by row; an empty benchmark or documents table is fine; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import KEY, row_key, stage
from shelfmark.llm.tokens import Reader, byte_class, signed

WINDOW, ANCHORS, FEW_TERMS = 13, 3, 2_000_000
TO_SPACE = bytes((c + 0x20 if 0x41 <= c <= 0x5A else c) if byte_class("marks")[c] or 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(TO_SPACE).split()


def windows_of(benchmark: DataFrame) -> DataFrame:
    """(phrase, terms, items): each different test window, the hashes of its words and the ids of the items that have it."""

    def cut(batches):
        reader = Reader("marks", lower=True)
        for batch in batches:
            out = []
            for at, _, w in reader.slices(batch.column("text")):
                h = reader.hashes(w).view(np.int64)
                for r in range(len(w.first) - 1):
                    a, b = w.first[r], w.first[r + 1]
                    words = w.text(a, b)
                    for i in range(max(1, b - a - WINDOW + 1) if b > a else 0):
                        out.append((batch.column("item_id")[at + r].as_py(), b" ".join(words[i:i + WINDOW]).decode(), h[a + i:min(b, a + i + WINDOW)].tolist()))
            yield pa.record_batch({"item_id": pa.array([x[0] for x in out], pa.string()), "phrase": pa.array([x[1] for x in out], pa.string()),
                                   "terms": pa.array([x[2] for x in out], pa.list_(pa.int64()))})

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(cut, "item_id string, phrase string, terms array<long>")
    return rows.groupBy("phrase").agg(F.first("terms").alias("terms"), F.array_sort(F.collect_set("item_id")).alias("items"))


def _held(spark, terms: DataFrame):
    """The terms as a sorted array for the tasks, if a count allows."""
    if terms.limit(FEW_TERMS + 1).count() > FEW_TERMS:
        return None
    return spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in terms.collect()], np.int64)))


def _scan(keyed: DataFrame, held, counts: bool) -> DataFrame:
    def scan(batches):
        reader = Reader("marks", lower=True)
        for batch in batches:
            for at, _, w in reader.slices(batch.column("text")):
                h = reader.hashes(w).view(np.int64)
                i = np.arange(len(h))
                if held is not None:
                    terms = held.value
                    i = np.flatnonzero(terms[np.searchsorted(terms, h) % len(terms)] == h) if len(terms) else i[:0]
                if counts:
                    t, n = np.unique(h[i], return_counts=True)
                    yield pa.record_batch({"term": pa.array(t), "n": pa.array(n.astype(np.int64))})
                    continue
                ids, texts = (batch.column(k).to_numpy(zero_copy_only=False)[at + w.row[i]] for k in KEY)
                yield pa.record_batch({"term": pa.array(h[i]), "key_id": pa.array(ids), "key_text": pa.array(texts), "place": pa.array((i - w.first[w.row[i]]).astype(np.int32))})

    return keyed.select(*KEY, "text").mapInArrow(scan, "term long, n long" if counts else "term long, key_id long, key_text long, place int")


def index(keyed: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, key, place) of ``terms`` in the training documents, stored."""
    held = _held(keyed.sparkSession, terms)
    rows = _scan(keyed, held, False)
    return stage(rows if held is not None else rows.join(terms, "term"), "postings")


def rarest(windows: DataFrame, keyed: DataFrame, by: str = "phrase", present: bool = False) -> DataFrame:
    """Adds ``anchors``: up to ``ANCHORS`` different terms as (n, term, offset), rarest in the corpus first; with ``present``, of those that occur in it."""
    every = windows.select(by, F.posexplode("terms").alias("offset", "term"))
    terms = stage(every.select("term").distinct(), "terms")
    held = _held(keyed.sparkSession, terms)
    often = _scan(keyed, held, True)
    often = (often if held is not None else often.join(terms, "term")).groupBy("term").agg(F.sum("n").alias("n"))
    once = every.groupBy(by, "term").agg(F.min("offset").alias("offset")).join(often, "term", "inner" if present else "left")
    best = once.groupBy(by).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))), 1, ANCHORS).alias("anchors"))
    return windows.join(best, by)


def starts(windows: DataFrame, postings: DataFrame) -> DataFrame:
    """(key, start, phrase, items): where the windows' anchors all stand at their offsets."""
    w = windows.where("anchors[0].n > 0")
    p = postings.select("term", *KEY, "place")
    found = w.withColumn("term", F.col("anchors")[0]["term"]).join(p, "term").withColumn("start", F.col("place") - F.col("anchors")[0]["offset"]).where("start >= 0").drop("term", "place")
    for k in range(1, ANCHORS):
        a = F.get("anchors", F.lit(k))
        # a window with fewer terms has no such list to meet
        short, rest = found.where(F.size("anchors") <= k), found.where(F.size("anchors") > k)
        rest = rest.withColumn("term", a["term"]).withColumn("place", F.col("start") + a["offset"]).join(p, ["term", *KEY, "place"], "left_semi").drop("term", "place")
        found = rest.unionByName(short)
    return found.select(*KEY, "start", "phrase", "items")


RESULT = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, matches array<struct<start:int,words:int,phrase:string>>")


def _verified(batches):
    for batch in batches:
        out = []
        for doc_id, text, found in zip(*(batch.column(c) for c in ("doc_id", "text", "found"))):
            words = split_words(text.as_buffer().to_pybytes()) if text.is_valid else []
            items, hit, met = set(), 0, []
            if found.is_valid:
                cover = np.zeros(len(words) + 1, np.int32)
                for f in found.as_py():
                    phrase = f["phrase"].encode().split(b" ")
                    if words[f["start"]:f["start"] + len(phrase)] == phrase:
                        cover[f["start"]] += 1
                        cover[f["start"] + len(phrase)] -= 1
                        items.update(f["items"])
                        met.append({"start": f["start"], "words": len(phrase), "phrase": f["phrase"]})
                hit = int((np.cumsum(cover) > 0).sum())
            out.append({"doc_id": doc_id.as_py(), "n_words": len(words), "n_hit": hit, "n_items": len(items), "items_sha256": hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
                        "contaminated": hit > 0 and 20 * hit >= len(words), "matches": met})
        yield pa.RecordBatch.from_pylist(out, pa.schema([
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
            ("matches", pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("phrase", pa.string())])))]))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(F.col("doc_id"), F.col("text")), "text")


def found_starts(keyed: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, found): the proposed windows of each document that has any."""
    w = stage(rarest(stage(windows_of(benchmark), "windows"), keyed), "anchored")
    postings = index(keyed, w.select(F.explode("anchors.term").alias("term")).distinct())
    found = starts(w, postings).groupBy(*KEY).agg(F.collect_set(F.struct("start", "phrase", "items")).alias("found"))
    # what is found grows with the corpus: the same plan at every size
    return stage(found, "found").hint("merge")


def exact_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the exact phrase ``matches``."""
    keyed = _keyed(docs)
    return keyed.join(found_starts(keyed, benchmark), KEY, "left").select("doc_id", "text", "found").mapInArrow(_verified, RESULT)


def _clean(batches):
    for batch in batches:
        bad = pa.concat_arrays([b.column("contaminated") for b in _verified([batch])])
        yield batch.filter(pa.compute.invert(bad)).select(["row", "text"])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones."""
    row = F.struct(*(F.col(f"`{x}`") for x in docs.columns if x != "text")).alias("row")
    whole = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), *row_key(F.col("doc_id"), F.col("text")), "text")
    out = whole.join(found_starts(whole.select(*KEY, "text"), benchmark), KEY, "left").select("row", "doc_id", "text", "found")
    kept = out.mapInArrow(_clean, out.select("row", "text").schema)
    return kept.select(*(F.col("text") if x == "text" else F.col(f"row.`{x}`") for x in docs.columns))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 2 * WINDOW) -> DataFrame:
    """(doc_id, item_id, first, last): the item's ``ANCHORS`` rarest terms stand, in any order, within ``slop`` words of the rarest.

    Terms that no document holds are left out, so an item with a new name or number can still be found."""
    keyed = _keyed(docs)
    w = stage(windows_of(benchmark), "windows")
    items = w.select(F.explode("items").alias("item_id"), "terms").groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    items = stage(rarest(items, keyed, "item_id", present=True), "anchored").where(F.col("anchors")[0]["n"] > 0).select("item_id", "anchors")
    postings = index(keyed, items.select(F.explode("anchors.term").alias("term")).distinct())
    near = items.withColumn("term", F.col("anchors")[0]["term"]).join(postings, "term").select("item_id", "anchors", *KEY, F.col("place").alias("at"), F.col("place").alias("first"), F.col("place").alias("last"))
    for k in range(1, ANCHORS):
        # places meet within a cell of slop words or in the next one to either side
        p = postings.select("term", *KEY, "place").withColumn("cell", F.explode(F.expr(f"array(place div {slop} - 1, place div {slop}, place div {slop} + 1)")))
        left = near.withColumn("term", F.get("anchors", F.lit(k))["term"]).withColumn("cell", F.expr(f"at div {slop}"))
        met = left.where("term IS NOT NULL").join(p, ["term", *KEY, "cell"]).where(f"abs(place - at) <= {slop}")
        met = met.groupBy("item_id", "anchors", *KEY, "at").agg(F.min(F.least("first", "place")).alias("first"), F.max(F.greatest("last", "place")).alias("last"))
        near = met.unionByName(left.where("term IS NULL").drop("term", "cell"))
    ids = keyed.select("doc_id", *KEY)
    return near.join(ids, KEY).groupBy("doc_id", "item_id", *KEY).agg(F.min("first").alias("first"), F.max("last").alias("last")).drop(*KEY)


SQL = r"""
WITH b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
m AS (SELECT r, i, dg.n, item_id FROM dg JOIN bw ON dg.g = bw.g AND dg.n = bw.n),
h AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)
"""
