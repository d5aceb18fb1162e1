"""Queries that SQL can state, against DuckDB at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

from pelagraph.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda row: repr([round(x, 12) if isinstance(x, float) else str(x) for x in row])
    found = con.execute(registry.ORACLE[name])
    columns = [d[0] for d in found.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(plain, df.select(*columns).collect())) == sorted(map(plain, found.fetchall()))
