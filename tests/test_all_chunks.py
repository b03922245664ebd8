"""Searches of all chunks: equal vectors are compared once, and the side with fewer rows is sent."""

import numpy as np
import pytest

from shelfmark.operators import retrieve

SHAPE = "evidence_id string, embedding array<double>"


@pytest.mark.parametrize("asked, sent", [(3, 1 << 22), (400, 1 << 22), (400, 8 * 40)])
def test_copies_are_compared_once(spark, monkeypatch, asked, sent):
    g = np.random.default_rng(4)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(g.normal(size=(n, 8)))
    some, q = unit(60), unit(asked)
    names = [f"ev_{i:05d}" for i in g.permutation(900)]
    own = [some[0] if i < 500 else some[i % 60] for i in range(900)]
    index = spark.createDataFrame([(n, list(map(float, v))) for n, v in zip(names, own)], SHAPE)
    requests = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(q)], "request_id long, query_vector array<double>")
    seen = []
    for name in ("_best_of_blocks", "_best_of_sent"):
        real = getattr(retrieve, name)
        monkeypatch.setattr(retrieve, name, lambda rows, *a, real=real, name=name: seen.append((name, len(rows.value[0]))) or real(rows, *a))
    monkeypatch.setattr(retrieve, "SENT", sent)
    # several blocks of queries and of chunks
    monkeypatch.setattr(retrieve, "BLOCK", 1)
    monkeypatch.setattr(retrieve, "QUERIES", 1)
    once = retrieve.searched_once(index, 3, "evidence_id", "embedding").collect()
    assert sum(r["vector"] is not None for r in once) == 60 and len(once) <= 60 * 3
    for least in (-1.0, 0.6):
        got = {}
        for r in retrieve.search_all(index, requests, 3, least).collect():
            got.setdefault(r["request_id"], set()).add((r["evidence_id"], round(r["raw_score"], 8)))
        for i in range(asked):
            best = sorted((-round(min(1.0, max(0.0, float(v @ q[i]))), 8), n) for n, v in zip(names, own))[:3]
            assert got.get(i, set()) == {(n, -s) for s, n in best if -s >= least}, i
    assert {n for n, _ in seen} == {"_best_of_blocks" if asked < 60 else "_best_of_sent"}
    assert all(rows * 8 <= sent for _, rows in seen)
