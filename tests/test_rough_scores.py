"""Pairs are compared in single precision first: scores that only double precision tells apart must come out right."""

import numpy as np
import pyarrow as pa

from shelfmark.operators import retrieve


def test_scores_nearer_than_single_precision():
    g = np.random.default_rng(5)
    base = g.normal(size=128)
    x = base + 1e-6 * g.normal(size=(9000, 128))
    x[::9] = g.normal(size=(1000, 128))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = base + 0.3 * g.normal(size=(300, 128))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    names = [f"ev_{i:05d}" for i in g.permutation(len(x))]
    sent = type("Sent", (), {"value": (names, x)})
    lists = pa.ListArray.from_arrays(pa.array(np.arange(301, dtype=np.int32) * 128), pa.array(q.ravel()))
    batch = pa.record_batch({"place": pa.array(range(300)), "vector": lists})
    for least in (-1.0, 0.9):
        out = next(retrieve._best_of_sent(sent, 5, least, pa.string())(iter([batch])))
        got = {}
        for r in out.to_pylist():
            got.setdefault(r["place"], []).append((-round(r["raw_score"], 8), r["key"]))
        exact = np.round(np.clip(q @ x.T, 0, 1), 8)
        for i in range(300):
            best = sorted((-s, n) for s, n in zip(exact[i].tolist(), names))[:5]
            assert sorted(got.get(i, [])) == [(s, n) for s, n in best if -s >= least]


def test_products_of_all_pairs_are_single(monkeypatch):
    """The comparison of every pair, which is all but all of the time, runs on numbers of half the size."""
    seen = []
    real = np.partition
    monkeypatch.setattr(retrieve.np, "partition", lambda raw, *a, **b: seen.append(raw.dtype) or real(raw, *a, **b))
    x = np.eye(128)[:40]
    sent = type("Sent", (), {"value": ([f"e{i}" for i in range(40)], x)})
    lists = pa.ListArray.from_arrays(pa.array(np.arange(4, dtype=np.int32) * 128), pa.array(np.eye(128)[:3].ravel()))
    out = next(retrieve._best_of_sent(sent, 2, 0.5, pa.string())(iter([pa.record_batch({"place": pa.array(range(3)), "vector": lists})])))
    assert [(r["place"], r["key"], r["raw_score"]) for r in out.to_pylist()] == [(i, f"e{i}", 1.0) for i in range(3)]
    assert seen and all(d == np.float32 for d in seen)
