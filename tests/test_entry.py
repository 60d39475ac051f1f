import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["tier", "n_docs", "n_entities"]
    assert sum(r.n_docs for r in rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
