"""Searches of all chunks by few queries, and the hashes of words they rest on."""

import hashlib

import numpy as np
import pytest

from shelfmark.functions import embedding
from shelfmark.operators import retrieve

SHAPE = "evidence_id string, document_name string, source string, text string, embedding array<double>"


def test_few_queries_sort_no_vectors(spark, monkeypatch):
    """Equal vectors are looked for only where many queries make up for it; requests without filters and those whose filters fail are searched together."""
    g = np.random.default_rng(2)
    x = g.random((40, 128))
    index = spark.createDataFrame([(f"ev_{i:03d}", "d", f"s{i % 3}", "t", list(map(float, x[i % 20] / np.linalg.norm(x[i % 20])))) for i in range(40)], SHAPE)
    asks = [retrieve.Request(1, "rated voltage", {}), retrieve.Request(2, "rail steel", {"source": "none such"}), retrieve.Request(3, "trip class", {"source": "s1"}), retrieve.Request(4, "rated voltage", {})]
    searched, real = [], retrieve.search_all
    monkeypatch.setattr(retrieve, "search_all", lambda *a, **b: searched.append(1) or real(*a, **b))
    monkeypatch.setattr(retrieve, "searched_once", lambda *a: pytest.fail("vectors were sorted for a few queries"))
    got = {(r["request_id"], r["rank"]): (r["evidence_id"], r["is_fallback"]) for r in retrieve.search_with_fallback(index, asks, 3).collect()}
    assert len(searched) == 1
    for r in asks:
        q = np.zeros(128)
        for b, w in embedding.query_vector(r.text, 128).items():
            q[b] = w
        own = [i for i in range(40) if r.request_id != 3 or i % 3 == 1]
        best = sorted((-round(float(x[i % 20] @ q / np.linalg.norm(x[i % 20])), 8), f"ev_{i:03d}") for i in own)[:3]
        assert [got[r.request_id, k] for k in (1, 2, 3)] == [(n, r.request_id == 2) for _, n in best]
    assert len(got) == 12


def test_buckets_of_both_halves():
    tokens = ["a", "voltage_current", "äöü", "", "x" * 300]
    for dim in (1, 7, 100, 128, 1 << 20, (1 << 31) - 1):
        want = [int.from_bytes(hashlib.md5(t.encode()).digest(), "big") % dim for t in tokens]
        assert embedding._buckets([t.encode() for t in tokens], dim).tolist() == want
