"""Operators against their SQL or a brute-force version, on odd small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import common, decontaminate, embeddings, jaccard, languages, licenses, line_dedup, mixing, quality, substrings, warc
from workload.check import compare

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key_id long, score double, h string, line int, term long"
rng = random.Random(5)
WORDS = ["the", "of", "Mit", "license", "apache", "é́tude", "x1", "Ünder", "general", "public", "so", "it", "goes", "|", "!!"] + [f"w{k}" for k in range(60)]


def sentence(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    base, passage = sentence(120), sentence(40)
    near = base.split(" ")
    near[7] = near[60] = "changed"
    texts = [base, base, " ".join(near), base + " tail", passage, sentence(20) + " " + passage + "\n" + sentence(9), passage + "\t" + passage, None, "", " \n\t ", "one", "two words",
             "Released under the MIT License.\nmit license", "General  public-license apache\u000blicense; the Apache License", "la " * 50, "la " * 90, sentence(12), sentence(13),
             "\n".join([sentence(30)] * 3 + ["", "..."]), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", sentence(5000), sentence(35), sentence(34)]
    rows = [(k, t, rng.choice(["en", "fr", None]), rng.choice(["b", "a", "\U0001f600", "￮", None]), len(t or "")) for k, t in enumerate(texts)]
    rows += [(None, base, None, None, None), (None, None, None, "a", 0), (None, passage, "en", "a", 1), rows[4], rows[4], rows[5], (3, "another text for id 3", "en", "b", 9)]
    return [(*r, 1, 0.5, "x", 2, 3) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(0, odd_rows()[5][1] and " ".join(odd_rows()[4][1].split(" ")[3:30])), (1, "two words"), (1, "two words"), (2, None), (None, "another TEXT for"), (4, "..."), (5, " ".join(["la"] * 20))]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("start", F.lit(1))


def sql(text, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"{name}_in", df.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_in")
    return con.execute(text).df()


def same(df, expected):
    got = df.toPandas()
    assert len(got) == len(expected)
    if len(expected):
        assert compare(got[list(expected.columns)], expected) == ""


@pytest.fixture(params=["odd", "empty"])
def docs(request, odd):
    return odd if request.param == "odd" else odd.where("false")


def test_substrings(docs):
    same(substrings.remove_repeats(docs), sql(substrings.SQL, documents=docs))


def test_substrings_survive_hash_collisions(odd, monkeypatch):
    # contents named by their length alone collide often; what is verified from the source must not change
    from shelfmark.llm import tokens
    spans = tokens.Rolling.spans
    monkeypatch.setattr(substrings, "mixed", lambda x: x & tokens.np.uint64(1))
    assert spans is tokens.Rolling.spans
    same(substrings.remove_repeats(odd), sql(substrings.SQL, documents=odd))


@pytest.mark.parametrize("limits", [(256, 16), (1, 0), (2, 1)])
def test_jaccard(docs, monkeypatch, limits):
    monkeypatch.setattr(jaccard, "LONG", limits[0])
    monkeypatch.setattr(jaccard, "SPARE", limits[1])
    same(jaccard.near_groups(docs), sql(jaccard.SQL, documents=docs))


def test_one_of_each(odd):
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    groups = sql(jaccard.SQL, documents=odd)
    full = groups[groups.n_shingles > 0]
    assert kept.count() == full.component_id.nunique() + (groups.n_shingles == 0).sum()


def test_mixing(docs):
    same(mixing.mix(docs), sql(mixing.SQL, documents=docs))


def test_mixing_hits_targets_and_limits(odd):
    got = mixing.mix(odd).toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    by = got.assign(source=got.source.fillna("~")).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"), size=("size", "sum"))
    assert ((by.taken - by.target).abs() <= by.most * 4).all() and (by.target <= 3 * by["size"] + 1e-9).all() and by.target.sum() == pytest.approx(by["size"].sum())


@pytest.mark.parametrize("few", [2_000_000, 0])
def test_decontaminate(docs, bench, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "FEW_TERMS", few)
    same(decontaminate.exact_matches(docs, bench).drop("matches"), sql(decontaminate.SQL, documents=docs, benchmark=bench))


def test_clean_and_proximity(odd, bench, spark):
    bad = sql(decontaminate.SQL, documents=odd, benchmark=bench)
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == (~bad.contaminated).sum()
    assert decontaminate.exact_matches(odd, bench.where("false")).where("contaminated").count() == 0
    d = spark.createDataFrame([(1, "zig a b zag c zog"), (2, "zog " + "a " * 80 + "zig zag"), (3, "zig"), (None, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, "zig zag zog")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.proximity_matches(d, b).collect()] == [(1, "7", 0, 5)]


def test_licenses(docs):
    same(licenses.scan(docs), sql(licenses.SQL, documents=docs))


def test_embeddings(spark):
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    rows = [(10 * k + j, [x + rng.gauss(0, 0.1 * (j > 1)) for x in b], k % 2) for k, b in enumerate(base) for j in range(5)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, base[0], None), (905, base[0][:3], 0), (906, [2 * x for x in base[0]], 0), (907, [], 1),
             (None, base[0], 0), (None, None, None), (908, [float("inf")] + [1.0] * 15, 1), rows[2], rows[2]]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    same(embeddings.near_copies(e), sql(embeddings.SQL, embeddings=e))
    same(embeddings.near_copies(e.where("false")), sql(embeddings.SQL, embeddings=e.where("false")))


def test_revisits(spark):
    pages = spark.createDataFrame([(1, "http://A.org/x/?b=2&a=1&utm_source=q#t", "<p>"), (2, "https://www.a.org:443/x?a=1&b=2", "<q>"), (3, "nothing", "z"), (4, None, None), (5, "http://a.org/y", None),
                                   (5, "http://a.org/y", ""), (6, "http://u@m.a.org/x?a=1&b=2&ref=1", "<p>")], "page_id long, url string, html string").withColumn("tag", F.lit("t"))
    got = {r["record_id"]: r for r in warc.resolve(warc.page_records(pages)).collect()}
    assert [got[k]["outcome"] for k in (3, 5, 7, 9, 13)] == ["resolved", "changed", "no_url", "no_url", "resolved"]
    assert got[3]["response_id"] == 12 and got[3]["payload"] == "<p>" and got[3]["headers"]["date"] == "5001" and got[3]["headers"]["content-length"] == "3"
    rows = [(1, "response", "http://a.org/", 5, 200, {"ETag": '"b"', "X": "1"}, "p"), (2, "revisit", "http://a.org", 5, 304, None, None), (3, "revisit", "http://a.org", 6, 304, {"X": "2", "Vary": "v"}, None),
            (4, "revisit", "http://a.org", None, 304, {}, None), (5, "response", "http://a.org", 5, 404, {}, "no"), (None, "response", "http://a.org", 7, 200, {}, "?")]
    r = spark.createDataFrame(rows, "record_id long, kind string, uri string, at long, status int, headers map<string,string>, payload string")
    got = {x["record_id"]: (x["outcome"], x["response_id"], x["headers"], x["payload"]) for x in warc.resolve(r).collect()}
    assert got == {2: ("missing", None, None, None), 3: ("unvalidated", 1, {"etag": '"b"', "x": "1", "vary": "v"}, "p"), 4: ("missing", None, None, None)}
    assert warc.resolve(r.where("false")).count() == 0
    names = spark.range(1).select(warc.plain_headers(F.expr("map('ETag', 'a', 'etag', 'b', 'X', 'c')")).alias("h")).first()["h"]
    assert names == {"etag": "b", "x": "c"}
    # one URL over many ranges
    n = 400
    one = spark.range(n).selectExpr("id record_id", "IF(id % 9 = 0, 'response', 'revisit') kind", "'http://a.org/z' uri", "id at", "200 status", "map('etag', 'e') headers", "string(id) payload").repartition(6)
    assert all(x["response_id"] == x["record_id"] // 9 * 9 for x in warc.resolve(one).collect())


def edits(a, b):
    """Edit distance; what both begin and end with makes no difference."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(d[j] + 1, new[-1] + 1, d[j - 1] + (x != y)))
        d = new
    return d[-1]


def reduced(line):
    import re
    return " ".join(w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", line.lower()) if w)


def brute_lines(rows):
    """Text of each row as line dedup leaves it, by edit similarity alone; rows in the order of the operator."""
    import zlib

    import numpy as np
    names = list({reduced(x): None for _, t in rows for x in (t or "").split("\n") if reduced(x)})
    top = {x: x for x in names}
    find = lambda x: x if top[x] == x else find(top[x])
    # an edit takes away three character triples and brings three others at most, so pairs further apart need no look
    triples = np.zeros((len(names), 512), np.int16)
    for i, x in enumerate(names):
        for k in range(len(x) - 2):
            triples[i, zlib.crc32(x[k:k + 3].encode()) % 512] += 1
    sizes = np.array([len(x) for x in names])
    for i in range(len(names)):
        limit = 0.1 * np.maximum(sizes[i], sizes[i + 1:]) + 1e-9
        near = np.flatnonzero(np.abs(sizes[i + 1:] - sizes[i]) <= limit)
        near = near[np.abs(triples[i + 1 + near] - triples[i]).sum(1) <= 6 * limit[near]]
        for j in near:
            if edits(names[i], names[i + 1 + j]) <= limit[j]:
                top[find(names[i])] = find(names[i + 1 + j])
    seen, out = set(), {}
    for doc_id, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0])):
        kept = []
        for x in (t or "").split("\n"):
            g = find(reduced(x)) if reduced(x) else None
            if g is None or g not in seen:
                kept.append(x)
            if g is not None:
                seen.add(g)
        out.setdefault((doc_id, t), []).append(None if t is None else "\n".join(kept))
    return out


def test_lines(spark, odd):
    words = [sentence(60) for _ in range(6)]
    edited = [" " + w.replace(" ", "  ", 3) + "!\t" for w in words] + [" ".join([*w.split(" ")[:-1], "zz"]) for w in words] + [w.upper() for w in words]
    texts = ["\n".join(words[:3] + ["a", "..."]), "\n".join(edited[:9]), "\n".join(edited[9:] + words), None, "", "\n\n", "a\na\nb"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (None, None), (None, "fresh line here\nb")]
    d = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, n_lines int, line int, gone string")
    want = brute_lines(rows)
    got = line_dedup.dedup_lines(d).collect()
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append(r["text"])
    expected = {}
    for (k, _), ts in want.items():
        expected.setdefault(k, []).extend(ts)
    order = lambda x: sorted(x, key=lambda t: (t is None, t))
    assert {k: order(v) for k, v in have.items()} == {k: order(v) for k, v in expected.items()}
    assert line_dedup.dedup_lines(d.where("false")).count() == 0 and line_dedup.dedup_lines(odd).count() == odd.count()


def test_long_lines_are_compared_whole(spark):
    lines = [sentence(n) for n in (1800, 511, 512)]
    # far from each other's starts and ends
    other = [" ".join([*x.split(" ")[:n // 2], "quite", "other", *x.split(" ")[n // 2:]]) for x, n in zip(lines, (1800, 511, 512))]
    half = [" ".join(w if k % 2 else w + "zz" for k, w in enumerate(x.split(" "))) for x in lines]
    rows = list(enumerate(["\n".join(lines), "\n".join(other), "\n".join(half)]))
    want = brute_lines(rows)
    assert want[rows[1]] == [""] and want[rows[2]] == [rows[2][1]]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: want[(k, t)][0] for k, t in rows}


SF = "/root/testdata/sf0.01"


def test_languages(spark, odd):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = languages.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in languages.identify(odd).collect()}
    assert all(0 <= s <= 1 and p in ("en", "fr", "und") for _, p, s in got) and (7, "und", 0.0) in got and (8, "und", 0.0) in got
    assert {r["lang_pred"] for r in languages.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert languages.identify(odd.where("false")).count() == 0
    groups, _ = languages.learn(d.select("lang", "text"))
    assert sorted(x for g in groups for x in g) == ["de", "en", "es", "fr"] and len(groups) == 2


def test_quality(spark, odd):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(d, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    assert (got.quality == got.predicted).mean() > 0.95 and got[got.quality == 1].score.min() >= 0.3
    marks = spark.createDataFrame([(0, 1), (2, 0), (2, 1), (3, None), (None, 1), (99, 0), (4, 7), (6, 1)], "doc_id long, quality int")
    rows = quality.scored(odd, marks).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.scored(odd, marks.where("false")).collect()} == {1.0}
    assert quality.classify(odd.where("false"), marks).count() == 0


def test_neighbours_are_exact():
    import numpy as np
    g = np.random.default_rng(1)
    z, known = quality.unit(g.normal(size=(50, 8))), quality.unit(g.normal(size=(200, 8)))
    marks = g.integers(0, 2, 200).astype(float)
    for row, score in zip(z, quality.vote(z, known, marks)):
        near = sorted(((float(row @ k), m) for k, m in zip(known, marks)), reverse=True)[:quality.NEIGHBOURS]
        assert abs(sum(s * m for s, m in near) / sum(s for s, _ in near) - score) < 1e-9


def test_connected(spark):
    edges = [(k, k + 1) for k in range(0, 60, 2)] + [(k, k + 3) for k in range(0, 30, 3)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}
    for a, b in edges:
        if a != b:
            top.setdefault(a, a), top.setdefault(b, b)
    change = True
    while change:
        change = False
        for a, b in edges:
            if a != b and top[a] != top[b]:
                top[a] = top[b] = min(top[a], top[b])
                change = True
    assert got == top
