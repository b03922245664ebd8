"""The maintained chunk index and searches by requests, against plain Python on small tables."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import retrieve
from shelfmark.sources.chunk_index import ChunkIndex

rng = random.Random(8)
WORDS = "rated voltage current frequency poles mounting rail steel weight trip class the of and unit".split()
CHUNK = "document_id long, document_name string, product_id long, page_number int, chunk_index int, source string, text string"


def rows(documents, per=6, word=""):
    out = []
    for d in documents:
        for k in range(per):
            t = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12))) + word
            out.append((d, f"name {d % 3}", d % 5, 1, k, None if d % 4 == 0 else f"s{d % 2}", t if k else "rated voltage"))
    return out


def table(spark, some):
    return spark.createDataFrame(some, CHUNK)


@pytest.fixture
def index(spark):
    return ChunkIndex(spark, "file://" + tempfile.mkdtemp(prefix="index-", dir="/tmp"), 32)


def content(index):
    return {(r["document_id"], r["chunk_index"]): r["text"] for r in index.read().collect()}


def size(index):
    return tuple(index.counts().first())


def test_steps_are_merged(spark, index):
    assert size(index) == (0, 0)
    first, second = rows(range(8)), rows((2, 3, 9), 4, " again")
    index.add(table(spark, first))
    want = {(r[0], r[4]): r[6] for r in first}
    assert content(index) == want
    index.add(table(spark, second))
    want |= {(r[0], r[4]): r[6] for r in second}
    assert content(index) == want and size(index) == (len(want), 9)
    index.delete(spark.createDataFrame([(2,), (5,), (2,), (77,)], "document_id long"))
    want = {k: v for k, v in want.items() if k[0] not in (2, 5)}
    assert content(index) == want
    index.add(table(spark, rows((5,), 2)))  # comes back after its tombstone
    want = content(index)
    assert len([k for k in want if k[0] == 5]) == 2
    index.compact()
    assert content(index) == want and [kind for _, kind in index._steps()] == ["base"]
    index.delete(spark.createDataFrame([(5,)], "document_id long"))
    assert 5 not in {k[0] for k in content(index)}
    index.clear()
    assert content(index) == {} and size(index) == (0, 0)
    index.add(table(spark, first[:3]))
    assert len(content(index)) == 3


def test_an_unfinished_step_does_not_count(spark, index):
    index.add(table(spark, rows(range(3))))
    before = content(index)
    path = index._next("add")
    index._fs.mkdirs(index._path(path))
    assert content(index) == before
    index.add(table(spark, rows((8,))))
    assert len(content(index)) == len(before) + 6 and not index._next("add").startswith(path[:-4])


def brute(chunks, query, filters, k, least=-1.0, dim=32):
    q = retrieve.query_vector(query, dim)
    found = []
    for r in chunks:
        ok = all((str(r[f]) == v if f in retrieve.STRICT else r[f] is None or str(r[f]) == v) for f, v in filters.items() if f in (*retrieve.STRICT, "source"))
        if ok:
            found.append((-round(min(1.0, max(0.0, sum(r["embedding"][b] * w for b, w in q.items()))), 8), r["evidence_id"]))
    return [(e, round(-s, 4)) for s, e in sorted(found)[:k] if round(-s, 4) >= least]


ASKS = [(1, "rated voltage", {}), (2, "rated voltage", {"product_id": "3"}), (3, "trip class of steel", {"document_name": "name 1", "source": "s1"}), (4, "mounting rail", {"source": "s0"}), (5, "mounting", {"product_id": "99"}),
        (6, "  ", {}), (7, "rated voltage", {"no such field": "x"}), (8, "zzz", {}), (9, "weight", {"document_id": "4", "product_id": "4"}), (10, "weight", {"document_id": "4", "product_id": "3"}), (11, "rated voltage", {"document_id": "not a number"})]


@pytest.mark.parametrize("least", [-1.0, 0.3])
@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("sent", [1 << 22, 64])
def test_search_by_requests(spark, index, least, fallback, sent, monkeypatch):
    monkeypatch.setattr(retrieve, "SENT", sent)  # several groups of queries
    monkeypatch.setattr(retrieve, "BLOCK", 4)
    index.add(table(spark, rows(range(30))))
    stored = index.read()
    chunks = stored.collect()
    asked = spark.createDataFrame(ASKS, "request_id long, query string, filters map<string,string>")
    got = {}
    for r in retrieve.search_requests(stored, asked, 4, ("source",), fallback, least, 32).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append((r["evidence_id"], r["score"], r["is_fallback"]))
    for number, query, filters in ASKS:
        want, back = ([] if not query.strip() else brute(chunks, query, filters, 4, least)), False
        if fallback and query.strip() and not brute(chunks, query, filters, 4):
            want, back = brute(chunks, query, {}, 4, least), True
        assert got.get(number, []) == [(e, s, back) for e, s in want], number


def test_blocks_out_of_reach_are_left_out():
    """No block is compared with a query whose k-th score it can't reach, and the result is the same."""
    import pyarrow as pa
    g = np.random.default_rng(2)
    x = np.abs(g.normal(size=(2000, 16))) * (g.random((2000, 16)) < 0.2)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    q = x[:20]
    sent = type("Sent", (), {"value": (list(range(20)), q)})
    batch = pa.record_batch({"key": pa.array(range(2000)), "v": pa.array(list(map(list, x)))})
    out = next(retrieve._best_of_blocks(sent, 3, -1.0, pa.int64())(iter([batch]))).to_pylist()
    for i in range(20):
        want = sorted((-round(min(1.0, float(s)), 8), n) for n, s in enumerate(x @ q[i]))[:3]
        assert [(r["key"], r["raw_score"]) for r in out if r["place"] == i] == [(n, -s) for s, n in want]


def test_no_nested_loop_in_the_plan(spark, index):
    index.add(table(spark, rows(range(6))))
    products = spark.createDataFrame([(1, "b", "p", "c", "d"), (50, "", "", None, None)], "product_id long, brand string, part_number string, category string, description string")
    found = retrieve.retrieve_for_products(index.read(), products, 2, dim=32)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["product_id"] for r in found.collect()} == {1, 50} and found.where(F.col("product_id") == 50).first()["is_fallback"]
