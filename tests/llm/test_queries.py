"""Registered queries against their SQL at sf0.01 (those without SQL have tests of their own)."""

import duckdb
import pytest

from ledgershield.llm.queries import QUERIES, SQL
from oracle_compare import TABLES, digest

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key", sorted(SQL))
def test_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[key])
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(cols) and len(rows) == len(want)
    assert digest(df.columns, rows)[0] == digest(cols, want)[0]
