"""Retrieval asks each product's own question; products without a chunk search everything."""

from shelfmark.operators import retrieve


def test_each_product_asks_its_own_question(spark):
    texts = [(1, 10, "siemens breaker data"), (1, 10, "abb contactor data"), (2, 20, "siemens breaker data"), (2, 20, "abb contactor data")]
    rows = [(p, d, k, 1, "a.pdf", t) for k, (p, d, t) in enumerate(texts)]
    index = retrieve.index_chunks(spark.createDataFrame(rows, "product_id long, document_id long, chunk_index int, page_number int, document_name string, text string"), 128)
    products = spark.createDataFrame([(1, "siemens", "", "breaker", None), (2, "abb", None, "contactor", ""), (3, "abb", "", "contactor", "")],
                                     "product_id long, brand string, part_number string, category string, description string")
    got = {r["product_id"]: r["text"] for r in retrieve.retrieve_for_products(index, products, 1).collect()}
    assert got == {1: "siemens breaker data", 2: "abb contactor data", 3: "abb contactor data"}
