"""Substring dedup: windows of words that occur twice, found by compacting a De Bruijn graph of the corpus.

An edge is a window of ``WINDOW`` consecutive words. Edges are held in pieces: runs of consecutive windows in which the least
hash of an ``ANCHOR``-word part stands at one place. Equal windows share that hash, so only pieces whose anchor occurs twice can
repeat, and about 93 % of the edges' rows never exist; no piece holds a window twice. Under one anchor, either all pieces are equal (then their windows repeat), or the
differing ones are taken apart into windows, one representative a content, and compared by a 128-bit digest of their words.

Repeated pieces are nodes of a compacted graph: a piece joins its predecessor where each always follows the other (joins of
piece statistics), which leaves nonbranching paths. Source coordinates verify them: each occurrence of a path is read from its
document and digested, and a digest that stands alone shows a collision; the pieces of that path are then taken apart into
windows and the affected part is redone, so the result is exact at any size.

Cases: a null or empty text has no words and keeps the empty text; texts under ``WINDOW`` words are kept whole; repeated rows
and rows with null or repeated ids each count as an occurrence and get equal results; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import KEY, discard, freed, row_key, stage
from shelfmark.llm.tokens import ODD, Reader, mixed, signed

WINDOW, ANCHOR = 35, 8
PIECE = "key_id long, key_text long, start int, n int, anchor long, content long"
PART = "anchor long, content long, place int, copies long, d1 long, d2 long"
RESULT = ("doc_id long, key_id long, key_text long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,stop:int>>, "
          "paths array<struct<anchor:long,content:long,words:int,digest:binary>>")


def leftmost_least(a: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` values in a row stands; the leftmost of equal ones."""
    at, size = np.arange(len(a)), 1
    pick = lambda x, y: np.where(a[x] <= a[y], x, y)
    while size * 2 <= width:
        at = pick(at[:-size], at[size:])
        size *= 2
    return pick(at[:len(at) - (width - size)], at[width - size:])


def cut_pieces(batches, window: int = WINDOW, anchor: int = ANCHOR):
    reader = Reader("space")
    for batch in batches:
        ids, texts = (batch.column(k).to_numpy(zero_copy_only=False) for k in KEY)
        for at, to, w in reader.slices(batch.column("text")):
            h = reader.hashes(w)
            if len(h) < window:
                continue
            prefix = reader.words_.prefix(h)
            grams = reader.windows(h, anchor, prefix)
            least = leftmost_least(grams, window - anchor + 1)
            i = np.flatnonzero(w.row[:len(least)] == w.row[window - 1:])
            if not len(i):
                continue
            new = np.ones(len(i), bool)
            new[1:] = (np.diff(i) != 1) | (least[i[1:]] != least[i[:-1]])
            begin = np.flatnonzero(new)
            n = np.diff(np.append(begin, len(i)))
            s = i[begin]
            content = mixed(reader.words_.spans(prefix, s, s + n + window - 1) + n.astype(np.uint64) * np.uint64(ODD))
            row = w.row[s]
            yield pa.record_batch({"key_id": pa.array(ids[at + row]), "key_text": pa.array(texts[at + row]), "start": pa.array((s - w.first[row]).astype(np.int32)),
                                   "n": pa.array(n.astype(np.int32)), "anchor": signed(grams[least[s]]), "content": signed(content)})


def take_apart(batches, window: int = WINDOW):
    for batch in batches:
        out = [[] for _ in range(5)]
        for text, pieces in zip(batch.column("text"), batch.column("pieces")):
            words = text.as_buffer().to_pybytes().split()
            for p in pieces.as_py():
                for j in range(p["n"]):
                    d = hashlib.blake2b(b" ".join(words[p["start"] + j:p["start"] + j + window]), digest_size=16).digest()
                    for k, v in enumerate((p["anchor"], p["content"], j, p["copies"], d)):
                        out[k].append(v)
        d = np.frombuffer(b"".join(out[4]), np.int64).reshape(-1, 2)
        yield pa.record_batch({"anchor": pa.array(out[0], pa.int64()), "content": pa.array(out[1], pa.int64()), "place": pa.array(out[2], pa.int32()),
                               "copies": pa.array(out[3], pa.int64()), "d1": pa.array(d[:, 0].copy()), "d2": pa.array(d[:, 1].copy())})


def removed(batches, window: int = WINDOW):
    for batch in batches:
        rows = []
        for doc_id, a, b, text, pieces in zip(*(batch.column(c) for c in ("doc_id", *KEY, "text", "pieces"))):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            hit = np.zeros(max(len(words) - window + 1, 0), bool)
            paths, run = [], None
            for p in pieces.as_py() or ():
                s, n = p["start"], p["n"]
                hit[s:s + n] |= np.array([p["mask"] >> j & 1 for j in range(n)], bool)
                if not p["whole"]:
                    continue
                if run and run[3] == s and not p["head"]:
                    run[3] = s + n
                elif not run or run[2] != s:
                    run = [p["anchor"], p["content"], s, s + n]
                    paths.append(run)
            turn = np.zeros(len(words) + 1, np.int32)
            i = np.flatnonzero(hit)
            np.add.at(turn, i, 1)
            np.add.at(turn, i + window, -1)
            gone = np.cumsum(turn[:-1]) > 0
            edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
            kept = b" ".join(compress(words, (~gone).tolist()) if len(i) else words)
            rows.append({"doc_id": doc_id.as_py(), "key_id": a.as_py(), "key_text": b.as_py(), "n_words": len(words), "n_removed": int(gone.sum()),
                         "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": [{"start": int(x), "stop": int(y)} for x, y in edges.reshape(-1, 2)],
                         "paths": [{"anchor": x, "content": c, "words": e - s + window - 1, "digest": hashlib.sha256(b" ".join(words[s:e + window - 1])).digest()[:16]}
                                   for x, c, s, e in paths]})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([
            ("doc_id", pa.int64()), ("key_id", pa.int64()), ("key_text", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
            ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            ("paths", pa.list_(pa.struct([("anchor", pa.int64()), ("content", pa.int64()), ("words", pa.int32()), ("digest", pa.binary())])))]))


SAME = ["anchor", "content"]


def graded(pieces: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds to pieces with a shared anchor the ``mask`` of their windows that repeat, and ``whole`` if all do as one content.

    What is known of contents has a row for each and is written, so the join with the pieces can split a content that very many of them have."""
    per = pieces.groupBy(*SAME).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*KEY, "start", "n")).alias("at"))
    per = stage(per, "contents")
    several = per.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor")
    wanted = per.join(several, "anchor").select("at.*", *SAME, "copies").groupBy(*KEY).agg(F.collect_list(F.struct("start", "n", *SAME, "copies")).alias("pieces"))
    parts = docs.join(wanted.hint("merge"), KEY).select("text", "pieces").mapInArrow(take_apart, PART)
    parts = stage(parts, "parts")
    twice = parts.groupBy("d1", "d2").agg(F.sum("copies").alias("c")).where("c > 1").select("d1", "d2")
    masks = parts.join(twice, ["d1", "d2"]).groupBy(*SAME).agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("part"))
    known = stage(per.drop("at").join(masks, SAME, "left").where("copies > 1 OR part IS NOT NULL"), "known")
    discard(per, parts)
    out = pieces.join(known.hint("merge"), SAME).withColumn("whole", F.col("copies") > 1).withColumn(
        "mask", F.when(F.col("whole"), F.expr("shiftleft(1L, n) - 1")).otherwise(F.col("part"))).drop("part", "copies")
    out = stage(out, "graded")
    discard(known)
    freed(docs.sparkSession)
    return out


def compacted(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds ``head``: the piece starts a nonbranching path, so doesn't follow always and only the piece before it. With it, the nodes it reads."""
    at = Window.partitionBy(*KEY).orderBy("start")
    beside = lambda f, ok: F.when(ok, F.struct(f("anchor", 1).over(at), f("content", 1).over(at)))
    nodes = pieces.where("whole").dropDuplicates([*KEY, "start"])
    nodes = nodes.select(*SAME, beside(F.lead, F.lead("start", 1).over(at) == F.col("start") + F.col("n")).alias("after"),
                         beside(F.lag, F.lag("start", 1).over(at) + F.lag("n", 1).over(at) == F.col("start")).alias("before"))
    s = nodes.groupBy(*SAME).agg(F.count(F.lit(1)).alias("c"), *(F.min(x).alias(f"min_{x}") for x in ("after", "before")),
                                 *(F.max(x).alias(f"max_{x}") for x in ("after", "before")), *(F.count(x).alias(f"n_{x}") for x in ("after", "before")))
    s = stage(s, "nodes")
    one = lambda x: s.where(f"n_{x} = c AND min_{x} = max_{x}")
    up = one("after").select(F.col("anchor").alias("a0"), F.col("content").alias("c0"), F.col("min_after.col1").alias("anchor"), F.col("min_after.col2").alias("content"))
    down = one("before").select(*SAME, F.col("min_before.col1").alias("a0"), F.col("min_before.col2").alias("c0"))
    inner = down.join(up, [*SAME, "a0", "c0"]).select(*SAME, F.lit(False).alias("head"))
    return pieces.join(inner, SAME, "left").withColumn("head", F.coalesce("head", F.lit(True))), s


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and ``spans`` of removed words as [start, stop)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(F.col("doc_id"), F.col("text")), "text")
    cut = keyed.select(*KEY, "text").mapInArrow(cut_pieces, PIECE)
    shared = cut.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor")
    pieces = stage(cut.join(shared, "anchor"), "pieces")
    while True:
        marks = graded(pieces, keyed)
        marked, nodes = compacted(marks)
        held = marked.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("start", "n", *SAME, "mask", "whole", "head"))).alias("pieces"))
        found = stage(keyed.join(held.hint("merge"), KEY, "left").select("doc_id", *KEY, "text", "pieces").mapInArrow(removed, RESULT), "found")
        alone = (found.select(F.explode("paths").alias("p")).groupBy("p.anchor", "p.content", "p.words", "p.digest").agg(F.count(F.lit(1)).alias("c"))
                 .where("c = 1").select(*SAME).distinct())
        alone = stage(alone, "alone")
        if alone.isEmpty():
            discard(pieces, marks, nodes, alone)
            return found.drop(*KEY, "paths")
        # a collision: every occurrence on the path's contents becomes a content of its own and is compared window by window
        odd = marked.join(alone.withColumn("odd", F.lit(True)), SAME, "left")
        on = Window.partitionBy(*KEY).orderBy("start")
        path = F.last(F.when(F.col("head"), F.struct(*SAME, F.col("odd").isNotNull().alias("odd"))), True).over(on)
        bad = odd.where("whole").withColumn("path", path).where("path.odd").select(*SAME).distinct().withColumn("bad", F.lit(True))
        own = F.xxhash64("content", *KEY, "start")
        pieces = stage(pieces.join(bad, SAME, "left").withColumn("content", F.when(F.col("bad"), own).otherwise(F.col("content"))).drop("bad"), "pieces")


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35)),
hit AS (SELECT r, i FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + k AS p FROM hit, (SELECT unnest(range(35)) AS k)),
lost AS (SELECT r, list(p) AS p FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(p, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM t LEFT JOIN lost USING (r)
"""
