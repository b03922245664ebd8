"""Operators over several rows: conflicts, scores, reviews, retrieval, exports, streams."""

import json
import math
import random

from pyspark.sql import functions as F

from shelfmark.functions import embedding
from shelfmark.operators import catalog, claims as cl, retrieve, review, score, validate
from shelfmark.sources import documents, feed, sinks, store

CLAIM = "product_id int, attribute string, value string, source_name string, evidence_id string, similarity double, claim_ord bigint"


def _claims(spark, rows):
    return spark.createDataFrame([(p, a, v, s, f"e{i}", 0.9, i) for i, (p, a, v, s) in enumerate(rows)], CLAIM)


def test_spelling_is_no_conflict(spark):
    c = _claims(spark, [(1, "voltage", "400 volts", "A"), (1, "voltage", "400V", "B"), (1, "voltage", "0.4 kV", "C"), (2, "current", "10 A", "A"),
                        (2, "current", "12 A", "B"), (3, "current", "500 mA", "A"), (3, "current", "0.5 A", "B"), (4, "poles", "UNKNOWN", "A"), (4, "poles", "3P", "B")])
    found = {(r.product_id, r.attribute, r.severity, r.n_values) for r in cl.conflicts(c).collect()}
    assert found == {(2, "current", "HIGH", 2)}
    assert cl.conflicts(c, fold_milliamps=False).count() == 2
    shuffled = c.orderBy(F.rand(1))
    assert {r.conflict_id for r in cl.conflicts(shuffled).collect()} == {r.conflict_id for r in cl.conflicts(c).collect()}


def test_hot_group_keeps_every_source(spark):
    c = _claims(spark, [(1, "current", f"{i % 3} A", f"S{i}") for i in range(5000)])
    r = cl.compare_sources(c).first()
    assert r.is_conflict and r.n_claims == 5000 and r.message.count("S") == 5000
    said = cl.with_canonical(c)
    assert cl.claim_sources(said).count() == 5000
    assert len(cl.conflict_lists(cl.conflict_headers(cl.claim_values(said)), said).first().sources) == 5000


def test_repeated_claims_of_a_source_are_counted(spark):
    """A group of many claims by few sources stays small: one entry for each value and source."""
    c = _claims(spark, [(1, "current", f"{(i % 2) * 2 + 10} A", "Sheet" if i < 20000 else "Site") for i in range(20001)]
                + [(2, "poles", "3P", "B"), (2, "poles", "3P", "B"), (2, "poles", "3P", None), (3, "voltage", None, "A")])
    got = {r.product_id: r for r in cl.with_evidence_ids(cl.compare_sources(c), c).collect()}
    hot = got[1]
    assert hot.n_claims == 20001 and hot.n_values == 2 and len(hot.sources) == 3 and hot.conflicting_values == ["10 A", "12 A"]
    assert hot.message == "Conflicting values detected for 'current' across sources: '10 A' (Sheet x10000, Site) vs '12 A' (Sheet x10000)."
    assert [(s.source_name, s.raw_value, s.n_claims) for s in hot.sources] == [("Sheet", "10 A", 10000), ("Sheet", "12 A", 10000), ("Site", "10 A", 1)]
    assert "across 2 sources (B x2, Unknown Source)" in got[2].message and not got[2].conflicting_values
    assert got[3].message == "Single source 'A' supports 'voltage' with value 'None'."
    assert all(len(r.evidence_ids) == len(set(r.evidence_ids)) for r in got.values())


def test_validation_severities(spark):
    a = spark.createDataFrame([(1, "voltage", "400 kg", "400 V", "kg", "VERIFIED", 0), (1, "frequency", "5000 Hz", "5000 Hz", "Hz", "VERIFIED", 1),
                               (1, "current", "10-16 A", "10-16 A", "A", "VERIFIED", 2)],
                              "product_id int, name string, value string, normalized_value string, unit string, status string, attr_ord int")
    got = {(r.attribute, r.rule): (r.passed, r.severity) for r in validate.row_rules(a).collect()}
    assert got[("voltage", "UnitConsistencyCheck")] == (False, "CRITICAL")
    assert got[("frequency", "ImpossibleValueCheck")] == (False, "CRITICAL")
    assert got[("current", "NumericFormatCheck")] == (True, "LOW")
    p = spark.createDataFrame([(1,), (2,)], "product_id int")
    req = {(r.product_id, r.attribute): r.passed for r in validate.required_rule(p, a).collect()}
    assert req == {(1, "voltage"): True, (1, "current"): True, (2, "voltage"): False, (2, "current"): False}


def test_confidence_bands(spark):
    a = spark.createDataFrame([(1, "voltage", "400 V", "VERIFIED"), (1, "current", "10 A", "VERIFIED"), (1, "poles", None, "UNKNOWN")],
                              "product_id int, name string, value string, status string")
    e = spark.createDataFrame([(1, n, s, s, 0.95) for n in ("voltage", "current") for s in ("Datasheet.pdf", "Catalog.pdf")],
                              "product_id int, attribute string, source_name string, document_name string, similarity double")
    res = spark.createDataFrame([(1, "none", True, "LOW")], "product_id int, attribute string, passed boolean, severity string")
    bad = spark.createDataFrame([(1, "current")], "product_id int, attribute string")
    got = {r.attribute: (r.confidence_score, r.confidence_band, r.is_blocked) for r in score.score_attributes(a, e, res, bad).collect()}
    assert got["voltage"][1] == "HIGH" and got["current"][0] < 70 and got["current"][2] and got["poles"] == (0.0, "LOW", False)


def test_review_replay_and_previous_values(spark):
    a = spark.createDataFrame([(1, "current", "10 A", "10 A", "A", 0.5, "REQUIRES_REVIEW")],
                              "product_id int, name string, value string, normalized_value string, unit string, confidence double, status string")
    d = spark.sql("""SELECT * FROM VALUES (1,'current','SELECT_ALTERNATIVE','12 amps','r',timestamp_ntz'2024-01-01 00:00:00',1),
        (1,'current','BOGUS',NULL,'r',timestamp_ntz'2024-01-01 01:00:00',2), (1,'current','MARK_UNKNOWN',NULL,'r',timestamp_ntz'2024-01-02 00:00:00',3),
        (1,'current','ACCEPT_AI_VALUE',NULL,'r',timestamp_ntz'2024-01-04 00:00:00',4) AS t(product_id,attribute,action,selected_value,reason,ts,decision_id)""")
    r = review.apply_decisions(a, d).first()
    assert (r.value, r.status, r.confidence) == (None, "VERIFIED", 1.0)
    before = {x.decision_id: x.previous_value for x in review.previous_values(d, a).collect()}
    assert before == {1: "10 A", 3: "12 amps", 4: None}
    assert review.split_decisions(d)[1].count() == 1


def test_approval_gate(spark):
    p = spark.createDataFrame([(1, "REVIEWED"), (2, "REVIEWED")], "product_id int, status string")
    c = spark.createDataFrame([(1, "OPEN", "CRITICAL"), (2, "OPEN", "MEDIUM")], "product_id int, status string, severity string")
    ok, blocked = review.approve(p, c)
    assert [r.product_id for r in ok.collect()] == [2] and [r.product_id for r in blocked.collect()] == [1]


def test_search_matches_brute_force(spark):
    words = "voltage rating current weight mount rail class specifications cable frame".split()
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices(words, k=6)) for _ in range(80)]
    chunks = spark.createDataFrame([(str(i), 1, 0, t, i % 4) for i, t in enumerate(texts)],
                                   "document_id string, page_number int, chunk_index int, text string, product_id int")
    index = retrieve.index_chunks(chunks, 128)
    q = embedding.query_vector("voltage rating specifications", 128)
    want = sorted((sum(w * embedding.query_vector(t, 128).get(b, 0.0) for b, w in q.items()) for t in texts), reverse=True)[:7]
    got = retrieve.search(index, "voltage rating specifications", 7).collect()
    assert all(math.isclose(g.score, w, abs_tol=1e-4) for g, w in zip(got, want))
    back = retrieve.search_with_fallback(index, [retrieve.Request(1, "voltage", {"product_id": 99}), retrieve.Request(2, "voltage", {"product_id": 1})], 3, 128).collect()
    assert {(r.request_id, r.is_fallback) for r in back} == {(1, True), (2, False)} and len(back) == 6


def _split(text, limit):
    """Plain statement of the packing rule."""
    if len(text) <= limit:
        return [text]
    out, cur = [], ""
    for para in text.split("\n\n"):
        long = len(para) > limit
        for i, (body, sep) in enumerate([(x, "\n") for x in para.split("\n")] if long else [(para, "\n\n")]):
            if cur and (len(cur) + len(body) + len(sep) > limit or (long and i == 0)):
                out.append(cur.strip())
                cur = ""
            cur += body + sep
    return out + ([cur.strip()] if cur.strip() else [])


def test_chunks_match_brute_force(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(["alpha ", "beta\n", "gamma\n\n", "x" * 30], k=rnd.randint(5, 60))).strip() for _ in range(40)]
    d = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "document_id int, page_number int, text string")
    got = {}
    for r in documents.chunk_pages(d, 100).collect():
        got.setdefault(r.document_id, {})[r.chunk_index] = r.text
    assert {i: [p[k] for k in sorted(p)] for i, p in got.items()} == {i: _split(t, 100) for i, t in enumerate(texts)}


def test_large_twin_is_one_document(spark):
    p = spark.createDataFrame([(1, "PN"), (2, "PX")], "product_id int, part_number string")
    kids = spark.createDataFrame([(1, f"a{i}") for i in range(50)], "product_id int, name string")
    none = kids.filter("false")
    docs = sinks.twin_json(p, kids, none, none, none, none, {s: ["name"] for s in sinks.SECTIONS}).collect()
    parsed = [json.loads(r.document) for r in docs]
    assert sum(len(x["attributes"]) for x in parsed) == 50 and sorted(r.product_id for r in docs) == [1, 2]


def test_store_updates(spark):
    cur = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, n string, s string")
    out = {tuple(r) for r in store.upsert(cur, spark.createDataFrame([(2, None, "z"), (3, "c", "w")], "id int, n string, s string"), "id").collect()}
    assert out == {(1, "a", "x"), (2, "b", "z"), (3, "c", "w")}
    fresh = spark.createDataFrame([(2, "new", "n")], "id int, n string, s string")
    assert {tuple(r) for r in store.replace_children(cur, fresh, fresh, "id").collect()} == {(1, "a", "x"), (2, "new", "n")}


def test_summary_and_search(spark):
    p = spark.createDataFrame([(1, "P1", "ABB", "d", "c", "VERIFIED", 90.0, 2), (2, "P2", "X", "d", "c", "REQUIRES_REVIEW", 60.0, 1)],
                              "product_id int, part_number string, brand string, description string, category string, status string, overall_quality_score double, updated_at int")
    c = spark.createDataFrame([(1, "OPEN")], "product_id int, status string")
    r = catalog.summary(p, c).first()
    assert (r.total_products, r.verified_count, r.needs_review_count, r.conflicts_count, r.average_quality_score) == (2, 1, 1, 1, 75.0)
    assert catalog.search(p, "abb").count() == 1 and catalog.search(p, status="REQUIRES_REVIEW").count() == 1


def test_feed_errors(spark, tmp_path):
    import pytest

    (tmp_path / "f.csv").write_text("MPN,Brand\n")
    with pytest.raises(feed.EmptyFeed):
        feed.read_feed_csv(spark, str(tmp_path / "f.csv"))
    (tmp_path / "g.csv").write_text("MPN,Brand\nP1,ABB\n,ABB\n")
    good, bad = feed.reject_split(feed.canonical_header(feed.read_feed_csv(spark, str(tmp_path / "g.csv"))))
    assert good.count() == 1 and bad.first().reject_reason == "Missing part number"


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    from shelfmark.plans.enrich import Rules, enrich
    from shelfmark.streaming import batches

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.csv").write_text("part_number,brand,description\nP1,siemens,circuit breaker 230 V AC 10 A\n,abb,none\n")
    stream = lambda: batches.feed_stream(spark, str(src), ["part_number", "brand", "description"], 1)
    run = lambda: batches.run_batches(stream(), str(tmp_path / "out"), str(tmp_path / "cp"), Rules.starter)
    run()
    (src / "b.csv").write_text("part_number,brand,description\nP2,3m,flap disc 60 grit\n")
    run()
    status = {r.batch_id: (r.processed, r.failed) for r in batches.batch_status(spark, str(tmp_path / "out")).collect()}
    assert status == {0: (2, 1), 1: (1, 0)}
    rows = spark.createDataFrame([("P1", "siemens", "circuit breaker 230 V AC 10 A"), ("P2", "3m", "flap disc 60 grit")], "part_number string, brand string, description string")
    whole = enrich(rows.withColumn("product_id", feed.natural_id("part_number", "brand", "description")), Rules.starter(spark))["attributes"]
    cols = ["product_id", "name", "value", "confidence", "status"]
    got = batches.read_output(spark, str(tmp_path / "out"), "attributes", ["product_id", "name"])
    assert {tuple(r) for r in got.select(*cols).collect()} == {tuple(r) for r in whole.select(*cols).collect()}
