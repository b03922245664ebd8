"""Searches whose work grows no faster than their tables."""

import random

import numpy as np

from shelfmark.functions import embedding
from shelfmark.functions.embedding import query_vector, sparse_vectors
from shelfmark.operators import retrieve

rng = random.Random(3)
WORDS = "rated voltage current frequency poles mounting rail steel weight trip class 230 V 5 A 50 Hz 2 kg IP20 stainless".split()
CHUNK = "document_id long, document_name string, product_id long, page_number int, chunk_index int, source string, text string"


def chunks(spark, products, per):
    rows = [(p, f"name {p % 3}", p, 1, k, f"s{p % 2}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 14)))) for p in products for k in range(per)]
    return spark.createDataFrame(rows, CHUNK)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_questions_meet_chunks_without_a_row_for_each_pair(spark):
    """A product of 300 chunks goes on over many batches; the best 4 of each question are those of a full sort."""
    d = chunks(spark, range(9), 6).unionByName(chunks(spark, [77], 300))
    index = retrieve.index_chunks(d, 32).cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        found = retrieve.spec_evidence(index, 4, 32)
        assert "Window" not in plan(found)
        got = {(r["product_id"], r["attribute"], r["value"]): (r["evidence_id"], r["claim_ord"], round(r["similarity"], 4)) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = index.collect()
    best = {}
    for q, attribute, phrase in retrieve.spec_requests():
        v = np.zeros(32)
        for b, w in query_vector(phrase, 32).items():
            v[b] = w
        for p in {r["product_id"] for r in rows}:
            own = sorted((-round(min(1.0, max(0.0, float(np.dot(r["embedding"], v)))), 8), r["evidence_id"], r["text"]) for r in rows if r["product_id"] == p)[:4]
            for rank, (s, e, t) in enumerate(own, 1):
                best.setdefault((p, attribute, e, t), (q, rank, round(-s, 4)))
    flat = spark.createDataFrame([(p, a, e, t, *x) for (p, a, e, t), x in best.items()], "p long, a string, e string, t string, q int, rank int, s double")
    want = {}
    for r in flat.withColumn("value", retrieve.evidence_value(flat["t"], flat["a"])).where("value <> ''").collect():
        k = (r["p"], r["a"], r["value"])
        want[k] = min(want.get(k, (9999,)), (r["q"], r["rank"], r["s"], r["e"]))
    assert got == {k: (e, 1_000_000 + q * 1000 + rank, s) for k, (q, rank, s, e) in want.items()}


def test_equal_requests_are_searched_once(spark, monkeypatch):
    """Requests of two texts for names that most chunks have; the number of scored pairs does not grow with the requests."""
    index = retrieve.index_chunks(chunks(spark, range(12), 5), 32).cache()
    asks = [retrieve.Request(i, "rated voltage" if i % 2 else "poles mounting", {"document_name": f"name {i % 4}", "unknown": str(i)}) for i in range(400)]
    pairs = []
    scores = retrieve.filtered_scores
    monkeypatch.setattr(retrieve, "filtered_scores", lambda *a, **b: pairs.append(scores(*a, **b)) or pairs[-1])
    for sent in (retrieve.SENT, 96):  # beyond it, requests for names that no chunk has go first
        monkeypatch.setattr(retrieve, "SENT", sent)
        got = retrieve.search_batch(index, asks, 3, 32).collect()
        assert pairs.pop().count() <= 2 * 60
        assert len(got) == 300 * 3
        for i in (1, 2, 5, 398):
            one = retrieve.search(index, asks[i].text, 3, {"document_name": f"name {i % 4}"}, dim=32).collect()
            assert {(r["evidence_id"], r["rank"], r["score"]) for r in one} == {(r["evidence_id"], r["rank"], r["score"]) for r in got if r["request_id"] == i}
        assert {r["request_id"] % 4 for r in got} == {0, 1, 2}


def test_vectors_shuffle_texts_only(spark):
    rows = [(k % 40 if k % 9 else None, " ".join(rng.choice(WORDS) for _ in range(k % 13))) for k in range(300)]
    d = spark.createDataFrame([*rows, (41, None)], "k long, t string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        out = sparse_vectors(d, "k", "t", 32)
        assert plan(out).split("== Physical Plan ==")[1].split("== Initial")[0].count("Exchange hashpartitioning") == 1
        got = {(r["k"], r["bucket"]): r["weight"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k in range(40):
        v = np.zeros(32)
        for key, t in rows:
            if key == k:
                # the unit vector of a text times its length
                words = t.split()
                n = np.sqrt(sum(x * x for x in raw(words).values()))
                for b, w in query_vector(t, 32).items():
                    v[b] += w * n
        if v.any():
            want |= {(k, b): w / np.linalg.norm(v) for b, w in enumerate(v) if w > 1e-12}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def raw(words):
    import hashlib
    out = {}
    for token, w in [(w.lower(), 1.0) for w in words] + [(f"{a}_{b}".lower(), 1.5) for a, b in zip(words, words[1:])]:
        b = int(hashlib.md5(token.encode()).hexdigest(), 16) % 32
        out[b] = out.get(b, 0.0) + w
    return out
