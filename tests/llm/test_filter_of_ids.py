from sleuthgrid.llm.ngram_join import _wanted


def test_plans_do_not_hold_the_filter(spark):
    docs = spark.range(400_000).selectExpr("id as doc_id", "'t' || id as text")
    taken = _wanted(docs, spark.range(0, 400_000, 4))
    assert len(taken._jdf.queryExecution().toString()) < 50_000
    found = {r["doc_id"] for r in taken.select("doc_id").collect()}
    assert set(range(0, 400_000, 4)) <= found and len(found) < 200_000
