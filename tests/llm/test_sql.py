from __future__ import annotations

import duckdb
import pytest

from strandlake.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLE_SQL[name]).project(", ".join(columns)).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(columns).collect())
