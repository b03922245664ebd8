"""Evidence retrieval over a chunk table with unit vectors.

Requests are a table: an id, a query and equality filters. A filtered request meets its chunks by an equi join on one of its
fields; the rest of its filters are checked on the pairs. A request without filters, or whose filters match nothing where that is wanted, is searched in
all chunks: query vectors go out in groups of bounded size, and each task compares them with blocks of chunks. The largest weight of each bucket in a
block bounds every score in it, so a block that can't reach a query's k-th score so far, or the least score asked for, is
skipped for that query. Chunks with equal vectors are compared once. Where there are more queries than such vectors, the vectors go out instead, so a
query meets all of a group in one task. Scores are narrow rows (request, chunk, score), cut to k in each task before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from shelfmark.functions import vocab
from shelfmark.functions.embedding import dense_vector, query_vector, similarity
from shelfmark.functions.text import strip
from shelfmark.operators.extract import evidence_value
from shelfmark.sources.store import Staging

SCORE_DIGITS = 4


@dataclass(frozen=True)
class Request:
    """One search: a phrase and optional equality filters on chunk columns."""

    request_id: int
    text: str
    filters: dict = field(default_factory=dict)


def evidence_id(document_id: Column, page: Column, index: Column) -> Column:
    """Same chunk, same id, on every run."""
    key = F.concat_ws("|", document_id.cast("string"), F.coalesce(page, F.lit(1)).cast("string"), index.cast("string"))
    return F.concat(F.lit("ev_"), F.substring(F.sha2(key, 256), 1, 24))


def named_chunks(chunks: DataFrame) -> DataFrame:
    """Non-blank chunks with id and length."""
    d = chunks.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")
    own = F.col("evidence_id") if "evidence_id" in chunks.columns else F.lit(None).cast("string")
    made = evidence_id(F.col("document_id"), F.col("page_number"), F.col("chunk_index"))
    return d.withColumn("evidence_id", F.coalesce(own, made)).withColumn("char_count", F.length("text"))


def index_chunks(chunks: DataFrame, dim: int = 128, element: str = "double") -> DataFrame:
    """Non-blank chunks with id, length and embedding, ready to be written."""
    return named_chunks(chunks).withColumn("embedding", dense_vector(F.col("text"), dim, element))


def _order(*tie: str):
    return [F.round("raw_score", 8).desc(), *[F.col(t).asc() for t in tie]]


def top_k(scored: DataFrame, k: int, by: list[str], tie: str = "evidence_id", digits: int | None = SCORE_DIGITS) -> DataFrame:
    """Best k rows per group; equal scores go by id. Without ``digits`` the raw score stays."""
    w = Window.partitionBy(*by).orderBy(*_order(tie))
    best = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best if digits is None else best.withColumn("score", F.round("raw_score", digits)).drop("raw_score")


def search(chunks: DataFrame, query: dict[int, float] | str, k: int = 5, filters: dict | None = None,
           tie: str = "evidence_id", vector: str = "embedding", dim: int = 128) -> DataFrame:
    """Best k chunks for one query; filters are applied before scoring."""
    q = query_vector(query, dim) if isinstance(query, str) else query
    d = _filtered(chunks, filters or {})
    scored = d.withColumn("raw_score", similarity(F.col(vector), q)).drop(vector)
    best = scored.orderBy(*_order(tie)).limit(k)
    w = Window.orderBy(*_order(tie))  # at most k rows left
    return (best.withColumn("rank", F.row_number().over(w))
            .withColumn("score", F.round("raw_score", SCORE_DIGITS)).drop("raw_score"))


def _filtered(chunks: DataFrame, filters: dict) -> DataFrame:
    for column, value in filters.items():
        chunks = chunks.filter(F.col(column) == F.lit(value))
    return chunks


#: Fields of a chunk that a filter must match; others are matched where a chunk has them.
STRICT = ("product_id", "document_id", "document_name")
#: Query vectors sent to the tasks at once, in numbers, and chunks whose weights are bounded together. Up to SENT, filtered requests are sent too.
SENT, BLOCK = 1 << 22, 64
#: Queries compared at once with chunks that were sent; so few queries meet chunks as they are, without a search for equal vectors.
QUERIES = 256


def request_table(spark: SparkSession, requests: list[Request]) -> DataFrame:
    """(request_id, query, filters) of requests given one by one."""
    rows = [(r.request_id, r.text, {k: None if v is None else str(v) for k, v in r.filters.items()}) for r in requests]
    return spark.createDataFrame(rows, "request_id int, query string, filters map<string,string>")


def with_query_vector(requests: DataFrame, dim: int = 128) -> DataFrame:
    """Requests with a query, and its vector."""
    d = requests.withColumn("query", strip(F.col("query"))).filter(F.col("query") != "")
    return d if "query_vector" in requests.columns else d.withColumn("query_vector", dense_vector(F.col("query"), dim))


def _dot(a: str, b: str, dim: int) -> Column:
    """Unrolled, so it stays in generated code; in 0..1."""
    total = F.lit(0.0)
    for i in range(dim):
        total = total + F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def _known(index: DataFrame, metadata: tuple[str, ...]) -> list[str]:
    return [f for f in (*STRICT, *metadata) if f in index.columns]


def _leading(fields: list[str]) -> Column:
    """The field by which a request meets its chunks: the first it filters on, null without any."""
    return F.coalesce(*[F.when(F.map_contains_key("filters", F.lit(f)), F.lit(f)) for f in fields], F.lit(None).cast("string"))


def filtered_scores(index: DataFrame, requests: DataFrame, metadata: tuple[str, ...] = (), dim: int = 128, key: str = "evidence_id", vector: str = "embedding") -> DataFrame:
    """(request_id, key, raw_score) of all chunks that meet a request's filters; requests without a known field have none here."""
    fields = _known(index, metadata)
    asked = requests.withColumn("lead", _leading(fields))
    # few rows whatever the input: names of fields
    used = {r["lead"]: r["n"] for r in asked.where("lead IS NOT NULL").groupBy("lead").agg(F.count(F.lit(1)).alias("n")).collect()}
    for lead in [f for f in STRICT if used.get(f, 0) * (dim + 64) > SENT]:
        # of many, only those whose value a chunk has
        there = index.select(F.col(lead).alias("value")).distinct()
        own = asked.where(F.col("lead") == lead).join(there, F.element_at("filters", F.lit(lead)).try_cast(index.schema[lead].dataType) == F.col("value"), "left_semi")
        asked = asked.where(F.coalesce(F.col("lead"), F.lit("")) != lead).unionByName(own)
        used[lead] = own.count()
    out = None
    for lead in sorted(used):
        # so few requests that they go to the chunks; of more, both sides are shuffled
        near = F.broadcast if used[lead] * (dim + 64) <= SENT else lambda d: d
        own = asked.where(F.col("lead") == lead).select("request_id", "query_vector", "filters", F.element_at("filters", F.lit(lead)).alias("wanted"))
        chunks = index.select(key, vector, *fields)
        if lead in STRICT:
            own = own.withColumn("wanted", F.col("wanted").try_cast(index.schema[lead].dataType))
            met = chunks.join(near(own), F.col(lead) == F.col("wanted"))
        else:
            # a chunk without the field meets all values of it
            own = own.withColumn("wanted", F.explode(F.array(F.concat(F.lit("="), "wanted"), F.lit("none"))))
            met = chunks.withColumn("has", F.coalesce(F.concat(F.lit("="), F.col(lead).cast("string")), F.lit("none"))).join(near(own), F.col("has") == F.col("wanted"))
        for f in fields:
            if f != lead:
                value, same = F.element_at("filters", F.lit(f)), F.col(f).cast("string") == F.element_at("filters", F.lit(f))
                free = ~F.map_contains_key("filters", F.lit(f)) if f in STRICT else ~F.map_contains_key("filters", F.lit(f)) | F.col(f).isNull()
                met = met.where(free | F.coalesce(same & value.isNotNull(), F.lit(False)))
        met = met.select("request_id", key, _dot(vector, "query_vector", dim).alias("raw_score"))
        out = met if out is None else out.unionByName(met)
    if out is None:
        return index.select(F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), key, F.lit(0.0).alias("raw_score")).where("false")
    return out


def _best_of_blocks(queries, k: int, least: float, kind: pa.DataType):
    """Best k rows of a task for each query, by blocks of rows whose largest weights bound their scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = queries.value
        floor = np.full(len(ids), least)
        held: list[list] = [[] for _ in ids]
        for batch in batches:
            keys, vectors = batch.column(0), batch.column(1)
            ok = np.flatnonzero(np.diff(vectors.offsets.to_numpy()) == q.shape[1])
            if not len(ok) or not len(ids):
                continue
            x = vectors.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ok), -1)
            # rows of one main bucket stand together, so a block's largest weights say more
            order = np.argsort(x.argmax(1), kind="stable")
            x, names = x[order], keys.take(pa.array(ok[order])).to_pylist()
            for at in range(0, len(x), BLOCK):
                rows = x[at:at + BLOCK]
                top, low = rows.max(0), rows.min(0)
                bound = np.where(q > 0, q * top, q * low).sum(1)
                may = np.flatnonzero(np.minimum(np.maximum(np.round(bound, 8), 0), 1) + 2e-8 >= floor)
                if not len(may):
                    continue
                scores = np.round(np.clip(rows @ q[may].T, 0, 1), 8)
                reach = scores >= floor[may]
                for j in np.flatnonzero(reach.any(0)).tolist():
                    i, some = may[j], np.flatnonzero(reach[:, j])
                    best = held[i] + [(-float(scores[r, j]), names[at + r]) for r in some.tolist()]
                    best.sort()
                    held[i] = best[:k]
                    if len(best) >= k:
                        floor[i] = max(least, -held[i][-1][0])
        rows = [(i, n, -s) for i, best in zip(ids, held) for s, n in best]
        columns = list(zip(*rows)) if rows else ([], [], [])
        yield pa.record_batch({"place": pa.array(columns[0], pa.int64()), "key": pa.array(columns[1], kind), "raw_score": pa.array(columns[2], pa.float64())})

    return run


def _best_of_sent(chunks, k: int, least: float, kind: pa.DataType):
    """Best k of the chunks sent for each query of a task; equal scores go by key. Chunks like the batch's mean query come first, so the k-th score is soon high.

    Products of all pairs are taken in single precision; only pairs that could be among the best by their largest error are scored in double."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = chunks.value
        by_name = sorted(range(len(names)), key=names.__getitem__)
        keys, vectors = pa.array([names[i] for i in by_name], kind), vectors[by_name]
        for batch in batches:
            if not len(batch):
                continue
            places, q = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            order = np.argsort(-(vectors @ q.mean(0)), kind="stable")
            x = vectors[order]
            rough = x.astype(np.float32)
            # of a sum of n products, rounded as the numbers are
            off = x.shape[1] * 2.0 ** -23 * np.linalg.norm(x, axis=1).max(initial=0) * np.linalg.norm(q, axis=1)
            told = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            for at in range(0, len(q), QUERIES):
                own, near = q[at:at + QUERIES], off[at:at + QUERIES]
                rough_own = own.astype(np.float32)
                floor = np.full(len(own), least)
                row, place, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                edges = [0, *range(min(8 * BLOCK, len(x)), len(x), QUERIES * 16), len(x)]
                for a, b in zip(edges, edges[1:]):
                    raw = rough_own @ rough[a:b].T
                    if a == 0 and b > k:
                        kth = np.partition(raw, b - k, axis=1)[:, b - k] - near
                        floor = np.maximum(floor, np.round(np.clip(kth, 0, 1), 8))
                    # the limit is rounded too, so it goes down by a step
                    low = np.nextafter(np.where(floor > 2e-8, floor - 2e-8 - near, -np.inf).astype(np.float32), np.float32(-np.inf))
                    # in one dimension, which is many times faster where few are
                    r, c = np.divmod(np.flatnonzero(raw >= low[:, None]), b - a)
                    if not len(r):
                        continue
                    some = np.round(np.clip(np.einsum("ij,ij->i", own[r], x[a + c]), 0, 1), 8)
                    ok = some >= floor[r]
                    row, place, score = np.concatenate([row, r[ok]]), np.concatenate([place, order[a + c[ok]]]), np.concatenate([score, some[ok]])
                    best = np.lexsort((place, -score, row))
                    nth = np.arange(len(best)) - np.searchsorted(row[best], row[best])
                    full = best[nth == k - 1]
                    floor[row[full]] = np.maximum(least, score[full])
                    best = best[nth < k]
                    row, place, score = row[best], place[best], score[best]
                told = [np.concatenate(x) for x in zip(told, (places[at + row], place, score))]
            yield pa.record_batch({"place": pa.array(told[0], pa.int64()), "key": keys.take(pa.array(told[1])), "raw_score": pa.array(told[2], pa.float64())})

    return run


def searched_once(index: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """(key, head, vector): of chunks with equal vectors the first k, and the key of the first, which alone keeps the vector."""
    alike = Window.partitionBy(vector).orderBy(key)
    so_far = alike.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = index.select(key, vector, F.row_number().over(alike).alias("nth"), F.first(key).over(so_far).alias("head")).where(F.col("nth") <= k)
    return ranked.select(F.col(key).alias("key"), "head", F.when(F.col("nth") == 1, F.col(vector)).alias("vector"))


def search_all(index: DataFrame, requests: DataFrame, k: int = 5, least: float = -1.0, key: str = "evidence_id", vector: str = "embedding") -> DataFrame:
    """(request_id, key, raw_score): best k of all chunks for every request, of those with ``least`` or more. Equal queries are searched once."""
    spark = index.sparkSession
    asked = requests.select("request_id", "query_vector", F.xxhash64("query_vector").alias("place"))
    distinct = Staging(spark).keep(asked.groupBy("query_vector").agg(F.min("place").alias("place")), "queries")
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("query_vector")).alias("dim"), F.count_distinct("place").alias("places")).first()
    if not size["n"]:
        return index.select(F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), key, F.lit(0.0).alias("raw_score")).where("false")
    if size["places"] < size["n"]:
        raise ValueError("two queries share a hash")
    queries = distinct.select("place", "query_vector")
    kind = spark.createDataFrame([], index.select(key).schema).toArrow().schema.field(key).type
    # finding equal vectors takes a shuffle and a sort of all of them, which only many queries make up for
    few = size["n"] <= QUERIES
    if few:
        copies, heads, n = None, index.select(F.col(key).alias("key"), F.col(vector).alias("vector")), size["n"]
    else:
        copies = Staging(spark).keep(searched_once(index, k, key, vector), "once")
        heads = copies.where(F.size("vector") == size["dim"]).select("key", "vector")
        n = heads.count()
    # the side with fewer rows goes out
    sent_rows, by, count = (queries, F.col("place"), size["n"]) if size["n"] <= n else (heads, F.xxhash64("key"), n)
    groups, group = 1, lambda m: F.pmod(by, F.lit(m))
    # as many groups as keep each within what is sent at once
    while count * size["dim"] > SENT and sent_rows.groupBy(group(groups).alias("g")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] * size["dim"] > SENT:
        groups *= 2
    shape, out = f"place long, key {index.schema[key].dataType.simpleString()}, raw_score double", None
    for g in range(groups):
        rows = sent_rows.where(group(groups) == g).collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], np.float64)))
        if sent_rows is queries:
            best = heads.mapInArrow(_best_of_blocks(sent, k, least, kind), shape)
        else:
            best = queries.mapInArrow(_best_of_sent(sent, k, least, kind), shape)
        out = best if out is None else out.unionByName(best)
    if out is None:
        return index.select(F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), key, F.lit(0.0).alias("raw_score")).where("false")
    best_of = lambda d: d.withColumn("nth", F.row_number().over(Window.partitionBy("place").orderBy(*_order("key")))).where(F.col("nth") <= k).drop("nth")
    if not few:
        # the best k vectors hold the best k chunks
        out = best_of(out).withColumnRenamed("key", "head").join(copies.select("key", "head"), "head").select("place", "key", "raw_score")
    return best_of(out).join(asked.select("request_id", "place"), "place").select("request_id", F.col("key").alias(key), "raw_score")


def search_requests(index: DataFrame, requests: DataFrame, k: int = 5, metadata: tuple[str, ...] = (), fallback: bool = False, least: float = -1.0, dim: int = 128,
                    key: str = "evidence_id", vector: str = "embedding") -> DataFrame:
    """(request_id, key, score, rank, is_fallback): best k chunks of every request, equal scores by key.

    ``requests(request_id, query, filters)``; an empty query finds nothing. With ``fallback``, a request whose filters match no chunk searches all.
    ``index`` is read several times, so it should be a stored table (see ``ChunkIndex``)."""
    spark, stage, fields = index.sparkSession, Staging(index.sparkSession), _known(index, metadata)
    links, asked = _asked_once(requests, fields, dim, stage)
    scored = filtered_scores(index, asked, metadata, dim, key, vector)
    lowest = least - 0.5 * 10 ** -SCORE_DIGITS  # rounded, it may reach the least score
    best = Staging(spark).keep(top_k(scored, k, ["request_id"], key, digits=None), "best").drop("rank")
    best = best.join(links, "request_id").withColumn("is_fallback", F.lit(False))
    todo = links.where("free")
    if fallback:
        todo = todo.unionByName(links.where("NOT free").join(best.select("asked_by").distinct(), "asked_by", "left_anti").select(*links.columns))
    wanted = asked.join(todo.select("request_id").distinct(), "request_id", "left_semi")
    # only requests that their filters left without a chunk are still there with filters
    every = search_all(index, wanted, k, lowest, key, vector).join(todo, "request_id").withColumn("is_fallback", ~F.col("free"))
    hits = best.unionByName(every.select(*best.columns)).drop("request_id").withColumnRenamed("asked_by", "request_id")
    hits = top_k(hits, k, ["request_id", "free"], key, digits=None)
    return hits.withColumn("score", F.round("raw_score", SCORE_DIGITS)).where(F.col("score") >= least).select("request_id", key, "score", "rank", "is_fallback")


def _asked_once(requests: DataFrame, fields: list[str], dim: int, stage: Staging) -> tuple[DataFrame, DataFrame]:
    """``(request_id, asked_by, free)`` and ``(request_id, filters, query_vector)``: requests with one query and equal known filters are searched as one, under a number."""
    own = "query_vector" in requests.columns
    d = requests.withColumn("query", strip(F.col("query"))).filter(F.col("query") != "")
    d = d.withColumn("filters", F.map_filter("filters", lambda f, _: f.isin(*fields)))
    told = F.struct(F.col("query_vector" if own else "query").alias("a"), F.array_sort(F.map_entries("filters")).alias("b"))
    d = stage.keep(d.withColumn("same", F.sha2(F.to_json(told), 256)), "asked")
    once = d.dropDuplicates(["same"]).withColumn("number", F.monotonically_increasing_id())
    once = stage.keep(with_query_vector(once, dim).select(F.col("number").alias("request_id"), "same", "filters", "query_vector"), "requests")
    links = d.select(F.col("request_id").alias("asked_by"), "same", _leading(fields).isNull().alias("free")).join(once.select("request_id", "same"), "same")
    return stage.keep(links.select("request_id", "asked_by", "free"), "links"), once.drop("same")


def chunks_of(hits: DataFrame, index: DataFrame, key: str = "evidence_id") -> DataFrame:
    """Found chunks with all their columns but the vector."""
    return hits.join(index.drop("embedding"), key)


def search_batch(chunks: DataFrame, requests: list[Request], k: int = 5, dim: int = 128, vector: str = "embedding", tie: str = "evidence_id") -> DataFrame:
    """Filtered top-k of requests given one by one."""
    hits = search_requests(chunks, request_table(chunks.sparkSession, requests), k, _asked_fields(requests), False, dim=dim, key=tie, vector=vector)
    return hits.drop("is_fallback").join(chunks.drop(vector), tie)


def search_with_fallback(chunks: DataFrame, requests: list[Request], k: int = 5, dim: int = 128, vector: str = "embedding", tie: str = "evidence_id") -> DataFrame:
    """As :func:`search_batch`; requests whose filters match nothing search everything."""
    hits = search_requests(chunks, request_table(chunks.sparkSession, requests), k, _asked_fields(requests), True, dim=dim, key=tie, vector=vector)
    return hits.join(chunks.drop(vector), tie)


def _asked_fields(requests: list[Request]) -> tuple[str, ...]:
    return tuple(sorted({f for r in requests for f in r.filters} - set(STRICT)))


def spec_requests(queries=vocab.SPEC_QUERIES) -> list[tuple[int, str, str]]:
    """(number, attribute, question) of all attributes that a chunk can answer."""
    flat = [(attribute, phrase) for attribute, phrases in queries.items() for phrase in phrases if attribute == "material" or attribute in vocab.EVIDENCE_PATTERNS]
    return [(i, attribute, phrase) for i, (attribute, phrase) in enumerate(flat)]


def _ranks(product: np.ndarray, place: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Ranks 1 to k of rows among those of their product, a column for each question; 0 beyond k and where the score is below 0. Equal scores go by place."""
    by_place = np.lexsort((place, product))
    p = product[by_place]
    whole = np.where(scores < 0, -1, np.rint(scores * 1e8)).astype(np.int64)
    # products stay in their order, so a position belongs to the same product whatever the question
    order = np.argsort(p * (1 << 29) - whole[by_place].T, axis=1, kind="stable")
    nth = np.arange(len(p)) - np.searchsorted(p, p) + 1
    near = np.flatnonzero(nth <= k)
    out = np.zeros(scores.shape, np.int64)
    out[by_place[order[:, near]], np.arange(scores.shape[1])[:, None]] = nth[near]
    return np.where(scores < 0, 0, out)


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the products and, in their order, of the ids of a batch."""
    ids = pa.compute.rank(batch.column("evidence_id"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense")
    return batch.column("product_id").dictionary_encode().indices.to_numpy().astype(np.int64), ids.to_numpy().astype(np.int64)


def _score_batches(questions: np.ndarray, k: int):
    """Rows that are among the best k of their product in a batch for any question, with their questions and scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.num_columns - 1)
            x = np.zeros((len(batch), questions.shape[1]))
            ok = np.flatnonzero(pa.compute.fill_null(pa.compute.list_value_length(vectors), -1).to_numpy() == questions.shape[1])
            if len(ok):
                x[ok] = np.nan_to_num(vectors.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ok), -1))
            scores = np.clip(x @ questions.T, 0, 1)
            best = _ranks(*_codes(batch), scores, k) > 0
            rows = np.flatnonzero(best.any(1))
            ends = pa.array(np.concatenate([[0], best[rows].sum(1).cumsum()]).astype(np.int32))
            told = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (np.nonzero(best[rows])[1].astype(np.int32), scores[rows][best[rows]])]
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *told], names=[*batch.schema.names[:-1], "q", "raw_score"])

    return run


def _best_of_products(attributes: list[int], k: int):
    """Rows among the best k of their product for any question, with the first question of each attribute that chose them.

    Rows of a product stand together; of one that goes on in the next batch, the best so far are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.diff([-1, *attributes]))

        def ranked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            q = batch.column("q")
            scores = np.full((len(batch), len(attributes)), -1.0)
            scores[np.repeat(np.arange(len(batch)), q.value_lengths().to_numpy()), q.flatten().to_numpy()] = batch.column("raw_score").flatten().to_numpy()
            return _ranks(*_codes(batch), scores, k), scores

        def told(batch: pa.RecordBatch) -> pa.RecordBatch:
            ranks, scores = ranked(batch)
            ask = np.where(ranks > 0, np.arange(len(attributes)), len(attributes))
            ask = np.minimum.reduceat(ask, first, axis=1)
            row, at = np.nonzero(ask < len(attributes))
            q = ask[row, at]
            out = batch.take(pa.array(row))
            values = [pa.array(q.astype(np.int32)), pa.array(ranks[row, q].astype(np.int32)), pa.array(scores[row, q])]
            return pa.RecordBatch.from_arrays([*out.columns[:-2], *values], names=[*batch.schema.names[:-2], "q", "rank", "raw_score"])

        held = None
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            product = batch.column("product_id")
            at = pa.compute.index(product, product[len(product) - 1]).as_py()
            if at:
                yield told(batch.slice(0, at))
            held = batch.slice(at)
            held = held.take(pa.array(np.flatnonzero((ranked(held)[0] > 0).any(1))))
        if held is not None:
            yield told(held)

    return run


def spec_evidence(index: DataFrame, k: int = 4, dim: int = 128, queries=vocab.SPEC_QUERIES) -> DataFrame:
    """Values found in the best chunks of each product for every attribute question.

    Rows ``(product_id, attribute, value, ...)``, one per distinct value: the first
    in question order, then rank. A chunk meets all questions at once, is cut to the best of its product in its batch, and is
    shuffled once with its text; no row is made for a pair of chunk and question that can't be among the best."""
    requests = spec_requests(queries)
    asked = [query_vector(p, dim) for _, _, p in requests]
    questions = np.array([[v.get(i, 0.0) for i in range(dim)] for v in asked])
    names = list(dict.fromkeys(a for _, a, _ in requests))
    body = index.select("product_id", "evidence_id", "document_name", "page_number", "text", "embedding").where(F.col("product_id").isNotNull())
    fields = [StructField(f.name, f.dataType) for f in body.schema.fields[:-1]]
    near = body.mapInArrow(_score_batches(questions, k), StructType([*fields, StructField("q", ArrayType(IntegerType())), StructField("raw_score", ArrayType(DoubleType()))]))
    best = near.repartition("product_id").sortWithinPartitions("product_id").mapInArrow(
        _best_of_products([names.index(a) for _, a, _ in requests], k),
        StructType([*fields, StructField("q", IntegerType()), StructField("rank", IntegerType()), StructField("raw_score", DoubleType())]))
    chosen = best.withColumn("attribute", F.element_at(F.array(*[F.lit(a) for _, a, _ in requests]), F.col("q") + 1))
    found = (chosen.withColumn("first", F.struct("q", "rank", F.round("raw_score", SCORE_DIGITS).alias("score")))
             .withColumn("value", evidence_value(F.col("text"), F.col("attribute"))).filter(F.col("value") != ""))
    one = F.min(F.struct("first.q", "first.rank", "first.score", "evidence_id", "document_name", "page_number", "text"))
    return (found.groupBy("product_id", "attribute", "value").agg(one.alias("e"))
            .select("product_id", "attribute", "value", F.col("e.document_name").alias("source_name"),
                    F.lit("PDF").alias("source_type"), F.col("e.evidence_id").alias("evidence_id"),
                    F.col("e.page_number").alias("page_number"), F.col("e.text").alias("snippet"),
                    F.col("e.score").alias("similarity"),
                    (1_000_000 + F.col("e.q") * 1000 + F.col("e.rank")).cast("bigint").alias("claim_ord")))


#: What a product's query asks after its own fields.
ASKED = "technical specifications voltage current frequency mounting poles dimensions standards"


def product_requests(products: DataFrame) -> DataFrame:
    """A request of every product for its own chunks, from its own fields; empty ones are left out."""
    own = [F.when(F.col(f) != "", F.col(f)) for f in ("brand", "part_number", "category", "description")]
    query = F.concat_ws(" ", *own, F.lit(ASKED))
    return products.select(F.col("product_id").alias("request_id"), query.alias("query"), F.create_map(F.lit("product_id"), F.col("product_id").cast("string")).alias("filters"))


def retrieve_for_products(index: DataFrame, products: DataFrame, k: int = 5, minimum: float = 0.05, dim: int = 128) -> DataFrame:
    """Top-k chunks of every product for its own query, weak ones dropped; a product without a chunk searches all of them."""
    hits = search_requests(index, product_requests(products), k, fallback=True, least=minimum, dim=dim)
    return chunks_of(hits.withColumnRenamed("request_id", "product_id"), index.drop("product_id"))


def retrieve_and_extract(index: DataFrame, products: DataFrame, attributes=vocab.REPORTED_ATTRIBUTES, k: int = 5,
                         minimum: float = 0.05, dim: int = 128) -> DataFrame:
    """Best-ranked value of each attribute in a product's retrieved chunks. A chunk is read once, however many products found it."""
    hits = search_requests(index, product_requests(products), k, fallback=True, least=minimum, dim=dim).withColumnRenamed("request_id", "product_id")
    hits = Staging(index.sparkSession).keep(hits, "hits")
    read = index.join(hits.select("evidence_id").distinct(), "evidence_id", "left_semi").select("evidence_id", "text")
    read = read.withColumn("attribute", F.explode(F.array(*[F.lit(a) for a in attributes])))
    values = read.withColumn("value", evidence_value(F.col("text"), F.col("attribute"))).filter(F.col("value") != "").drop("text")
    d = hits.join(values, "evidence_id")
    best = F.min(F.struct("rank", "value", "evidence_id", "score"))
    return (d.groupBy("product_id", "attribute").agg(best.alias("b"))
            .select("product_id", "attribute", "b.value", F.lit("EXTRACTED").alias("status"),
                    F.array("b.evidence_id").alias("evidence_ids"), F.col("b.score").alias("similarity")))


def by_ids(chunks: DataFrame, ids: DataFrame, key: str = "evidence_id") -> DataFrame:
    return chunks.join(ids.select(key), key, "left_semi")


def without_documents(chunks: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """The index after dropping all chunks of some documents."""
    return chunks.join(documents.select(key), key, "left_anti")


def index_size(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct("document_id").alias("n_documents"))


def cleared(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.lit(False))
