"""Cases that went wrong once: hosts of two labels, ties of neighbours, repeated labelled rows and copies in samples, planted similarities."""

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import common, decontaminate, embeddings, languages, quality, warc


def test_hosts_keep_two_labels(spark):
    urls = ["http://m.org/x", "http://www.org/x", "http://org/x", "http://www.m.de/", "http://www.www.a.org", "http://m.a.org", "http://mm.a.org", "http://www.a", "http://www.1.2.3.4/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.canonical_url(F.col("u"))).collect()]
    assert got == ["m.org/x", "www.org/x", "org/x", "m.de", "a.org", "a.org", "mm.a.org", "www.a", "1.2.3.4"]


def test_equal_neighbours_go_to_the_earlier_vector():
    g = np.random.default_rng(5)
    for _ in range(100):
        labelled = quality.unit(g.normal(size=(12, 4)))[g.integers(0, 12, 300)]  # many copies
        z, marks = quality.unit(g.normal(size=(6, 4))), g.integers(0, 2, 300).astype(float)
        near = z @ labelled.T
        for row, score in zip(near, quality.vote(z, labelled, marks)):
            at = sorted(range(300), key=lambda k: (-row[k], k))[:quality.NEIGHBOURS]
            weight = np.maximum(row[at], 1e-6)
            assert abs((weight * marks[at]).sum() / weight.sum() - score) < 1e-9


def test_copies_of_a_labelled_row_count_once(spark):
    texts = [(k, f"word{k} " * (k + 3)) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    one = quality.learn(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    many = quality.learn(spark.createDataFrame(texts + texts[:9] * 50, "doc_id long, text string"), labels)
    assert len(one[3]) == len(many[3]) and np.allclose(one[2], many[2])


def test_copies_do_not_fill_a_language_sample(spark):
    rows = [("en", f"the word{k} of this and that") for k in range(30)] + [("de", f"das wort{k} von dem und der") for k in range(30)]
    plain = languages.learn(spark.createDataFrame(rows, "lang string, text string"))
    copied = languages.learn(spark.createDataFrame(rows + rows[:1] * 3000, "lang string, text string"))
    assert plain[0] == copied[0] and all(np.allclose(plain[1][k], copied[1][k]) for k in plain[1])


def test_items_with_a_term_of_their_own_are_found_nearby(spark):
    d = spark.createDataFrame([(1, "zig a b zag c zog"), (2, "zog " + "a " * 80 + "zig zag")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "unheardof zig zag zog")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.proximity_matches(d, b).collect()] == [(1, "7", 0, 5)]


def test_links_near_the_threshold_are_found(spark):
    g = np.random.default_rng(9)
    x = g.normal(size=(900, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    across = g.normal(size=x.shape)
    across -= (across * x).sum(1, keepdims=True) * x
    across /= np.linalg.norm(across, axis=1, keepdims=True)
    cosines = np.repeat([0.931, 0.94, 0.95], 300)[:, None]
    y = cosines * x + np.sqrt(1 - cosines ** 2) * across
    rows = [(2 * k, list(map(float, a)), 1) for k, a in enumerate(x)] + [(2 * k + 1, list(map(float, b)), 1) for k, b in enumerate(y)]
    got = {r["vec_id"]: r["component_id"] for r in embeddings.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for k in range(3):
        found = sum(got[2 * i + 1] == got[2 * i] for i in range(300 * k, 300 * k + 300)) / 300
        assert found >= 0.9, (cosines[300 * k, 0], found)


def test_staged_tables_go(spark):
    t = common.stage(spark.range(5), "t")
    assert t.count() == 5
    common.discard(t)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.staged_in)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
