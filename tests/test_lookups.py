from sleuthgrid.operators import search
from sleuthgrid.plans import lookups


def test_every_document_has_a_mac(spark, tmp_path):
    ids = [0, 1, 106_038, 106_039, 106_040, 10**9, 5 * 10**9, 2**62 + 12345]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    digits = {i: f"{i * 2654435761 % 2**48:012X}" for i in ids}
    want = {i: (":".join(x[k : k + 2] for k in range(0, 12, 2)), bool(int(x[:2], 16) >> 1 & 1)) for i, x in digits.items()}
    assert {r["doc_id"]: (r["mac"], r["is_local"]) for r in lookups.mac_normalise(spark, str(tmp_path)).collect()} == want


def test_a_saved_index_is_read_by_its_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three"), (2, "two three"), (3, "four"), (4, None)], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "two three"), (2, "four")], "query_id int, query string")
    whole = search.token_index(docs, "doc_id", "text")
    search.save_index(whole, f"{tmp_path}/index", 8)
    want = sorted(map(tuple, search.search_tokens(whole, queries, "doc_id").collect()))
    assert want == [(1, 1, 2), (1, 2, 2), (2, 3, 1)]
    for index in (search.saved_index(spark, f"{tmp_path}/index", queries, 8), search.token_index(docs, "doc_id", "text", only=queries)):
        assert sorted(map(tuple, search.search_tokens(index, queries, "doc_id").collect())) == want
