"""Lines of documents that lie in one part of a file are made and hashed by many tasks."""

from shelfmark.sources import documents


def test_documents_are_dealt_out_before_their_lines(spark):
    d = spark.createDataFrame([(i, f"a {i}\n\n b {i} ") for i in range(200)] + [(None, "x\ny")], "document_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = documents.line_chunks(d)
        sizes = [len(p) for p in lines.rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and max(sizes) < 402
    got = {(r["document_id"], r["chunk_index"], r["text"]) for r in lines.collect()}
    assert got == {(i, k, f"{w} {i}") for i in range(200) for k, w in enumerate("ab")} | {(None, 0, "x"), (None, 1, "y")}
