"""Chunk numbers of pages over several ranges, and grounding of values, against plain statements."""

from shelfmark.operators import validate
from shelfmark.sources import documents


def test_chunk_numbers_run_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(documents, "PAGES_A_RANGE", 3)
    pages = [(d, p, u, "\n\n".join(f"part {d} {p} {u} {k} " + "x" * 30 for k in range((d + (p or 0) + u) % 4 + 1))) for d in (1, 2) for p in [*range(1, 11), None] for u in (0, 1)]
    got = documents.chunk_pages(spark.createDataFrame(pages, "document_id int, page_number int, unit int, text string"), limit=50, shortest=1)
    rows = sorted((r["document_id"], r["chunk_index"], r["text"]) for r in got.collect())
    want = []
    for d in (1, 2):
        texts = [t for *_, t in sorted((p for p in pages if p[0] == d), key=lambda p: (p[1] is not None, p[1] or 0, p[2]))]
        want += [(d, k, c) for k, c in enumerate(c.strip() for t in texts for c in t.split("\n\n"))]
    assert rows == want


def test_no_text_in_a_window(spark):
    d = documents.chunk_pages(spark.createDataFrame([(1, 1, "some text " * 20)], "document_id int, page_number int, text string"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window" in x]
    assert windows and not any("text" in x or "parts" in x for x in windows)


def test_grounding(spark):
    from shelfmark.functions import vocab

    name = vocab.GROUNDED_ATTRIBUTES[0]
    attributes = [(1, name, "12 A"), (1, vocab.GROUNDED_ATTRIBUTES[-1], "Steel"), (2, name, "unknown"), (3, name, "5 V"), (4, name, ""), (5, name, "x")]
    evidence = [(1, "rated 112 ABC"), (1, None), (1, "iron"), (3, "none"), (3, "at 5 v"), (3, "5 V again"), (9, "5 V")]
    got = validate.grounded_rule(spark.createDataFrame(attributes, "product_id int, name string, value string"), spark.createDataFrame(evidence, "product_id int, evidence_text string"))
    # product 5 has no evidence at all
    assert sorted((r["product_id"], r["attribute"], r["passed"]) for r in got.collect()) == sorted([(1, name, True), (1, vocab.GROUNDED_ATTRIBUTES[-1], False), (3, name, True)])
