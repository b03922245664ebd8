"""The learned part of the quality model runs in the driver: what it holds beside its vectors must stay small."""

import tracemalloc

import numpy as np

from shelfmark.llm.quality import latent_space


def test_latent_space_holds_no_second_copy():
    x = np.random.default_rng(1).random((300, 4104), np.float32)
    tracemalloc.start()
    centre, project = latent_space(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes
    c = (x - centre).astype(np.float64)
    values, u = np.linalg.eigh(c @ c.T)
    best = np.argsort(values)[::-1][:48]
    assert np.allclose(np.abs(project), np.abs(c.T @ u[:, best] / np.sqrt(values[best])), atol=1e-6)
