"""Training-data queries against their SQL on the smallest tables."""

import duckdb
import pytest

from compare import compare
from conftest import SMALL
from shelfspark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark):
    if ORACLES[name] is None:
        return
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    assert compare(QUERIES[name](spark, SMALL), con, ORACLES[name]) == ""
