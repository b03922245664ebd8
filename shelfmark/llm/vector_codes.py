"""Vector code compression: product codes by exact integer k-means over Hilbert-sorted blocks.

Components become integers, floor(``SCALE`` * x), and a vector is cut into ``PARTS`` equal parts. Each task gathers vectors up to ``CHUNK``
components, sorts every part's points along a Hilbert curve and cuts them into flat blocks of ``BLOCK`` points. A block holds the
least and greatest value of each component (its box), the sums of its components, the points themselves, and where they belong.
The blocks are written once; no vector is shuffled for that.

In each round a codebook goes out to the tasks (``PARTS * ENTRIES`` entries whatever the input). The distances from an entry to the nearest
and the farthest corner of a block's box bound its distances to all points of it. An entry whose nearest corner is farther than
another entry's farthest corner can't win a point; the others are the block's shortlist. A shortlist of one takes the block's sums and count
as they are. Otherwise the points are compared with the entries of the shortlist only, in whole numbers, from the lowest index up.
Bounds that are equal stay in the list, so ties go to the lower index as in a full comparison. Sums and counts by entry are added in each task and
then by one aggregate; so few rows reach the driver. In the end the blocks of a chunk come together by its number and give each vector its code.
Chunks are bounded and made as vectors come, so no key of the data, however common, is ever a group.

Cases: rows with a null vector, or one that holds null or non-finite components, are dropped; components beyond ``+-LARGEST`` count as that
bound, so that no sum overflows; vectors that can't be cut (empty, or of another length than the vector with the smallest id that can
be cut) keep their row with null code and error; fewer than ``ENTRIES`` vectors make as many entries; null ids come last among the first entries, and
equal ids by their components; repeated rows each count; rows with null label are one group; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 24
BLOCK = 32  # points
CHUNK = 1 << 22  # components gathered by a task before they are sorted
BLOCKS = ("chunk long, part int, lows binary, highs binary, sums binary, points binary, places binary, ids array<long>, labels array<{label}>")


def hilbert_order(x: np.ndarray) -> np.ndarray:
    """Order of the rows of ``x`` along a Hilbert curve through their box (Skilling, 2004); up to 63 bits of them are looked at."""
    dims = min(x.shape[1], 63)
    bits = max(1, min(16, 63 // dims))
    return np.argsort(hilbert_keys(grid(x[:, :dims], bits), bits), kind="stable")


def grid(x: np.ndarray, bits: int) -> np.ndarray:
    low = x.min(0)
    wide = np.maximum(x.max(0) - low, 1)
    return ((x - low) * ((1 << bits) - 1) // wide).astype(np.int64)


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of points with whole coordinates below ``2 ** bits``."""
    x, dims = x.T.copy(), x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            on = (x[i] >> b & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    key = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] ^ turn) >> b & 1
    return key


def _flat(x: np.ndarray) -> pa.Array:
    """Rows of ``x`` as binary values."""
    x = np.ascontiguousarray(x).reshape(len(x), -1)
    return pa.array(list(map(bytes, x.view(np.uint8)))) if len(x) else pa.array([], pa.binary())


def _table(column: pa.Array, kind=np.int64) -> np.ndarray:
    """Binary values of one length as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def sorted_blocks(x: np.ndarray, block: int = BLOCK):
    """(part, points, places) of the vectors' parts, cut along the curve."""
    width = x.shape[1] // PARTS
    for part in range(PARTS):
        points = x[:, part * width:(part + 1) * width]
        order = hilbert_order(points)
        for at in range(0, len(order), block):
            places = order[at:at + block]
            yield part, points[places], places


def _blocks(width: int, label: pa.DataType):
    def made(held, chunk):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids, labels = rows.column("vec_id"), rows.column("label")
        blocks = list(sorted_blocks(rows.column("x").flatten().to_numpy().reshape(-1, width * PARTS).astype(np.int64)))
        for at in range(0, len(blocks), 1024):
            some = blocks[at:at + 1024]
            # ids and labels go along with the first part only
            of = lambda column, kind: pa.array([column.take(pa.array(b[2])).to_pylist() if b[0] == 0 else None for b in some], pa.list_(kind))  # noqa: B023, E731
            yield pa.record_batch({
                "chunk": pa.array([chunk] * len(some)), "part": pa.array([b[0] for b in some], pa.int32()),
                "lows": _flat(np.array([b[1].min(0) for b in some], np.int64)), "highs": _flat(np.array([b[1].max(0) for b in some], np.int64)),
                "sums": _flat(np.array([b[1].sum(0) for b in some], np.int64)), "points": pa.array([b[1].astype(np.int32).tobytes() for b in some]),
                "places": pa.array([b[2].astype(np.int32).tobytes() for b in some]), "ids": of(ids, pa.int64()), "labels": of(labels, label)})

    def run(batches):
        chunk, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch) * width * PARTS
            if n >= CHUNK:
                yield from made(held, chunk)
                chunk, held, n = chunk + 1, [], 0
        if held:
            yield from made(held, chunk)

    return run


def shortlists(lows: np.ndarray, highs: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries can be nearest to a point of each box: (boxes, entries) of bool."""
    below, above = lows[:, None] - entries, entries - highs[:, None]
    nearest = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
    farthest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(2)
    return nearest <= farthest.min(1)[:, None]


def nearest_entries(points: np.ndarray, short: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every point of some blocks: (blocks, points of each)."""
    best = np.full(points.shape[:2], np.iinfo(np.int64).max)
    which = np.zeros(points.shape[:2], np.int64)
    for e in range(len(entries)):
        some = np.flatnonzero(short[:, e])
        if len(some):
            apart = ((points[some] - entries[e]) ** 2).sum(2)
            closer = apart < best[some]
            best[some] = np.where(closer, apart, best[some])
            which[some] = np.where(closer, e, which[some])
    return which, best


class Blocks:
    """Blocks of one part, their points filled up to a common number by the last one's copies."""

    def __init__(self, rows: pa.RecordBatch, width: int):
        self.lows, self.highs, self.sums = (_table(rows.column(c)) for c in ("lows", "highs", "sums"))
        points = rows.column("points").to_pylist()
        self.n = np.array([len(p) for p in points]) // (4 * width)
        most = int(self.n.max())
        self.points = np.frombuffer(b"".join(p + p[-4 * width:] * (most - n) for p, n in zip(points, self.n.tolist())), np.int32).reshape(-1, most, width).astype(np.int64)
        self.real = np.arange(most) < self.n[:, None]

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, sums) by entry."""
        short = shortlists(self.lows, self.highs, entries)
        count, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
        one = short.sum(1) == 1
        only = short[one].argmax(1)
        np.add.at(count, only, self.n[one])
        np.add.at(sums, only, self.sums[one])
        which, _ = nearest_entries(self.points[~one], short[~one], entries)
        real = self.real[~one]
        np.add.at(count, which[real], 1)
        np.add.at(sums, which[real], self.points[~one][real])
        return count, sums


def _totals(codebook, width: int):
    """Counts and sums by entry that a task's blocks come to."""
    def run(batches):
        entries = codebook.value
        count, sums = np.zeros(entries.shape[:2], np.int64), np.zeros(entries.shape, np.int64)
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for p in np.unique(parts).tolist():
                c, s = Blocks(batch.filter(pa.array(parts == p)), width).totals(entries[p])
                count[p] += c
                sums[p] += s
        part, entry, at = (x.ravel() for x in np.indices(sums.shape))
        yield pa.record_batch({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "at": pa.array(at, pa.int32()),
                               "total": pa.array(sums.ravel()), "n": pa.array(count[part, entry])})

    return run


def _codes(codebook, width: int, label: pa.DataType):
    """Codes and errors of the vectors of a chunk from all its blocks."""
    def run(table: pa.Table) -> pa.Table:
        entries, parts = codebook.value, table.column("part").to_numpy()
        n = sum(map(len, table.filter(pa.array(parts == 0)).column("places").to_pylist())) // 4
        codes, errors, ids, labels = np.zeros((n, PARTS), np.uint8), np.zeros(n, np.int64), [None] * n, [None] * n
        for p in range(PARTS):
            rows = table.filter(pa.array(parts == p)).combine_chunks().to_batches()[0]
            b = Blocks(rows, width)
            which, best = nearest_entries(b.points, shortlists(b.lows, b.highs, entries[p]), entries[p])
            places = np.frombuffer(b"".join(rows.column("places").to_pylist()), np.int32)
            codes[places, p] = which[b.real]
            errors[places] += best[b.real]
            if p == 0:
                for column, out in (("ids", ids), ("labels", labels)):
                    for at, value in zip(places.tolist(), (v for row in rows.column(column).to_pylist() for v in row)):
                        out[at] = value
        return pa.table({"vec_id": pa.array(ids, pa.int64()), "label": pa.array(labels, label), "code": pa.array([c.tobytes().hex() for c in codes]), "error": pa.array(errors)})

    return run


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, x) of the rows that are kept, x in whole numbers."""
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bounded = lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))).cast("int")
    return embeddings.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", bounded).alias("x"))


def compress(embeddings: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) of every kept row, and the codebooks as (part, entry, component), None if there is nothing to learn from."""
    spark = embeddings.sparkSession
    kept = whole_vectors(embeddings)
    kind = kept.schema["label"].dataType
    can = (F.size("x") > 0) & (F.size("x") % PARTS == 0)
    least = kept.where(can).orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x")).first()
    if least is None:
        return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), None
    dims = least[0]
    width, fits = dims // PARTS, F.size("x") == dims
    first = kept.where(fits).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    entries = np.array([r[0] for r in first], np.int64).reshape(-1, PARTS, width).transpose(1, 0, 2)
    label = spark.createDataFrame([], kept.select("label").schema).toArrow().schema.field("label").type
    blocks = stage(kept.where(fits).mapInArrow(_blocks(width, label), BLOCKS.format(label=kind.simpleString())), "blocks")
    for _ in range(ROUNDS):
        codebook = spark.sparkContext.broadcast(entries)
        sums = blocks.select("part", "lows", "highs", "sums", "points").mapInArrow(_totals(codebook, width), "part int, entry int, at int, total long, n long")
        found = sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").collect()
        entries = entries.copy()
        for r in found:
            entries[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
        codebook.unpersist()
    codebook = spark.sparkContext.broadcast(entries)
    schema = f"vec_id long, label {kind.simpleString()}, code string, error long"
    codes = blocks.select("chunk", "part", "lows", "highs", "sums", "points", "places", "ids", "labels").groupBy("chunk").applyInArrow(_codes(codebook, width, label), schema)
    rest = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return codes.unionByName(rest), entries


def compressed(embeddings: DataFrame) -> DataFrame:
    """Per kept row: vec_id, code, error, label_error (error of all rows of its label) and codebooks_sha256."""
    codes, entries = compress(embeddings)
    codes = stage(codes, "codes")
    told = "" if entries is None else ",".join(map(str, entries.ravel().tolist()))
    by_label = codes.groupBy("label").agg(F.coalesce(F.sum("error"), F.lit(0)).alias("label_error")).withColumnRenamed("label", "of")
    out = codes.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(told.encode()).hexdigest()).alias("codebooks_sha256"))


_NEAREST = "SELECT r, p, min(d * 64 + e) % 64 AS e, min(d) AS d FROM (SELECT r, p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM q JOIN {codes} USING (p)) GROUP BY r, p"
_MOVED = """SELECT p, e, coalesce(m, c) AS c FROM {codes} LEFT JOIN (SELECT p, e, list(s ORDER BY i) AS m FROM (
    SELECT p, e, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS s FROM {near} JOIN q USING (r, p), (SELECT unnest(range(1, w + 1)) AS i FROM dims) GROUP BY p, e, i) GROUP BY p, e) USING (p, e)"""
SQL = rf"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(least(greatest(x::DOUBLE * 256, -16777216), 16777216))::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
dims AS (SELECT len(x) // 16 AS w FROM k WHERE len(x) > 0 AND len(x) % 16 = 0 ORDER BY vec_id NULLS LAST, x LIMIT 1),
f AS (SELECT k.* FROM k, dims WHERE len(x) = 16 * w),
q AS (SELECT r, p, x[p * w + 1:p * w + w] AS v FROM f, dims, (SELECT unnest(range(16)) AS p)),
c0 AS (SELECT p, e, v AS c FROM q JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM f) USING (r) WHERE e < 64),
n0 AS ({_NEAREST.format(codes="c0")}),
c1 AS ({_MOVED.format(codes="c0", near="n0")}),
n1 AS ({_NEAREST.format(codes="c1")}),
c2 AS ({_MOVED.format(codes="c1", near="n1")}),
n2 AS ({_NEAREST.format(codes="c2")}),
o AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM n2 GROUP BY r)
SELECT vec_id, code, error, (sum(coalesce(error, 0)) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(coalesce(string_agg(array_to_string(c, ','), ',' ORDER BY p, e), '')) FROM c2) AS codebooks_sha256
FROM k LEFT JOIN o USING (r)
"""
