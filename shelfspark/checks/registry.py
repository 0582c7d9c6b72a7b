"""Where queries and the SQL they are checked against are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspark.checks.fixtures import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# DuckDB-only views: the planted vectors need its list functions.
DUCKDB_VIEWS = {
    "v_vectors": "SELECT vec_id AS product_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part)",
    "v_emb_dup": """
SELECT vec_id AS product_id, embedding::DOUBLE[] AS e FROM embeddings
UNION ALL
SELECT a.vec_id + 1 * (SELECT max(vec_id) + 1 FROM embeddings), [x[1] + 0.3::DOUBLE * x[2] for x in list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[])]
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 10 = 0
UNION ALL
SELECT a.vec_id + 2 * (SELECT max(vec_id) + 1 FROM embeddings), [x[1] + 0.6::DOUBLE * x[2] for x in list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[])]
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 10 = 0""",
}


def check(name: str, sql: str | None = None):
    """Register a query over ``Tables``; ``sql`` is the DuckDB statement with the same result."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql, DUCKDB_VIEWS)
        return build

    return wrap
