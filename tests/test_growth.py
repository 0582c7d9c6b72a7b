"""Inputs on which queries once failed or differed at larger sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.checks import load
from shelfspark.operators import ranking, upserts, vectors
from shelfspark.plans import dedup, product_search, refresh, store_search
from shelfspark.sources import tables as archives
from test_jobs import vector_frame, walk

QUERIES = load()[0]



def test_large_candidate_batch_from_the_masters_own_table(spark):
    # More candidates than are shipped, and both sides stem from one table.
    n = vectors.BROADCAST_QUERIES + 10
    rng = np.random.default_rng(9)
    table = vector_frame(spark, rng.normal(size=(2 * n, 4)))
    candidates = table.where(F.col("id") >= n).select(F.col("id").alias("candidate_id"), F.lit("x").alias("text"), "embedding")
    masters = table.where(F.col("id") < n).select(F.col("id").alias("master_id"), F.lit("m").alias("name"), "embedding")
    matrix = np.array([r.embedding for r in table.orderBy("id").collect()])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    best = np.round(unit[n:] @ unit[:n].T, 9).max(axis=1)
    got = {r.candidate_id: r.similarity for r in vectors.match_to_masters(candidates, masters).collect()}
    assert len(got) == n
    assert all(abs(got[n + i] - score) < 1e-8 for i, score in enumerate(best))


def test_a_vector_with_more_than_fifty_neighbours_lists_them_all(spark):
    rng = np.random.default_rng(3)
    matrix = np.ones((70, 6)) + 0.01 * rng.normal(size=(70, 6))
    matrix[60:] = matrix[0]  # copies
    got = vectors.near_duplicate_pairs(vector_frame(spark, matrix), 0.95)
    assert got.count() == 70 * 69
    assert got.agg(F.max("rank")).first()[0] == 69


def test_an_archive_of_many_stores_has_few_files(spark, tmp_path):
    raw = spark.range(3000).select(
        (F.col("id") % 1000).alias("store_id"), (F.col("id") % 3).alias("page"), F.lit("u").alias("store_url"),
        F.concat(F.lit("b"), F.col("id")).alias("body"), F.to_timestamp(F.lit("2024-01-31 10:11:12")).alias("scraped_at"),
    ).repartition(8)
    path = str(tmp_path / "archive")
    archives.archive(raw, path)
    read = archives.read_archive(spark, path)
    assert sorted(r.body for r in read.collect()) == sorted(f"b{i}" for i in range(3000))
    assert {r.scraped_at for r in read.collect()} == {"20240131T101112"}
    assert sorted(r.body for r in archives.read_archive(spark, path, "7").collect()) == ["b1007", "b2007", "b7"]
    assert sum(1 for _ in (tmp_path / "archive").rglob("*.json.gz")) <= 3 * archives.ARCHIVE_BUCKETS


def test_distinct_results_equal_the_dedup_of_all_ranks(tables):
    asked = tables.sql("SELECT * FROM v_queries").join(tables.embeddings.select("vec_id", "embedding"), "vec_id", "left")
    args = (asked, tables.listings, tables.products, tables.stores, tables.product_vectors)
    shown = ["query_id", "product_id", "store_id", "rank"]
    want = product_search.query_time_dedup(product_search.ranked_results(*args)).select(*shown)
    got = product_search.distinct_results(product_search.filtered_results(*args), shown)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_query_parameters_do_not_shuffle_the_rows(spark):
    queries = spark.range(50).select(F.col("id").alias("query_id"), F.lit("x").alias("city"))
    rows = spark.range(1000).select((F.col("id") % 50).alias("query_id"), F.col("id").alias("product_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if sizes were unknown
    try:
        plan = product_search._with_parameters(rows, queries)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan


def test_stores_at_one_place_send_no_more_than_is_shown(spark, monkeypatch):
    seen = []
    inner = store_search.near_join
    monkeypatch.setattr(store_search, "near_join", lambda q, s: seen.append(s) or inner(q, s))
    stores = spark.range(300).select(F.col("id").alias("store_id"), (30.0 + F.col("id") % 3 * 0.1).alias("lat"), F.lit(34.5).alias("lng"))
    asked = spark.createDataFrame([("q", 30.0, 34.5, 15.0)], "query_id string, q_lat double, q_lng double, radius_km double")
    listings = stores.select("store_id", F.col("store_id").alias("listing_id"))
    got = store_search.store_search_near(asked, stores, listings, 4)
    assert sorted((r["rank"], r["store_id"]) for r in got.collect()) == [(1, 0), (2, 3), (3, 6), (4, 9)]
    assert seen[0].count() == 3 * 4


def test_ranked_lists_move_only_what_they_show(tables, monkeypatch):
    seen = []
    inner = ranking.one_per_product_store
    monkeypatch.setattr(ranking, "one_per_product_store", lambda rows: seen.append(rows.columns) or inner(rows))
    QUERIES["t03_instock_first"](tables.spark, tables.folder)
    assert "partner_url" not in seen[0]


def test_aggregates_of_rows_carry_each_value_once(spark):
    rows = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", "x"), (2, 5, None, "y")], "k int, position int, v string, w string")
    picked = ranking.first_per_key(rows, ["k"], ["position"])
    fed = rows.groupBy("k").agg(upserts.last_row("v", "w").alias("r"), upserts.last_set("w"), upserts.first_value("v"))
    for df in (picked, fed):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "min_by" not in plan and "minby" not in plan and "max_by" not in plan and "maxby" not in plan
    assert sorted(map(tuple, picked.collect())) == [(1, 1, "a", "x"), (2, 5, None, "y")]
    assert sorted((r.k, r.r.v, r.r.w, r.w, r.v) for r in fed.collect()) == [(1, "b", None, "x", "a"), (2, None, "y", "y", None)]


@pytest.mark.parametrize("name", ["c12_stores", "c12_refreshed_runs"])
def test_status_and_audit_rows_make_no_product_snapshot(tables, monkeypatch, name):
    monkeypatch.setattr(refresh, "upsert_products", None)
    assert QUERIES[name](tables.spark, tables.folder).count() > 0


def test_groups_move_each_vector_to_few_blocks(spark, monkeypatch):
    # One cell of 8 blocks: half of the blocks meet, and what the ids settle is not compared with the leaders.
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    moved = []
    inner = vectors._blocks
    monkeypatch.setattr(vectors, "_blocks", lambda *args: moved.append(inner(*args)) or moved[-1])
    rng = np.random.default_rng(11)
    matrix = rng.normal(size=(400, 24))
    matrix[200:260] = matrix[:60] + 0.05 * matrix[100:160]
    got = dedup.duplicate_groups(vector_frame(spark, matrix), 0.95)
    assert sorted(map(tuple, got.collect())) == walk(matrix, list(range(400)), 0.95) != []
    assert sum(b.count() for b in moved) <= 400 * 11


def test_capped_keyword_search_ranks_few_products_of_a_common_text(spark, monkeypatch):
    ranked = []
    inner = product_search.top_n
    monkeypatch.setattr(product_search, "top_n", lambda df, keys, *rest: ((ranked.append(df) if keys == ["query_id"] else None), inner(df, keys, *rest))[1])
    products = spark.range(3000).select(
        F.col("id").alias("product_id"), F.when(F.col("id") % 3 < 2, "red ring").otherwise("blue box").alias("canonical_name"),
        F.when(F.col("id") % 2 == 0, "acme").alias("brand"),
    )
    products = products.unionByName(spark.createDataFrame([(3000, "odd cup", "zed"), (3001, None, "odd")], "product_id bigint, canonical_name string, brand string"))
    listings = products.select("product_id").where("product_id % 5 <> 0")
    queries = spark.createDataFrame([("q1", "red"), ("q2", "odd"), ("q3", "blue acme")], "query_id string, search_text string")
    whole = product_search.keyword_products(queries, listings, products).collect()
    got = product_search.keyword_products(queries, listings, products, 50).collect()
    want = [r for q in ("q1", "q2", "q3") for r in sorted((r for r in whole if r.query_id == q), key=lambda r: r.product_id)[:50]]
    assert sorted((r.query_id, r.product_id, r.similarity) for r in got) == sorted((r.query_id, r.product_id, r.similarity) for r in want)
    assert {q: sum(r.query_id == q for r in got) for q in ("q1", "q2", "q3")} == {"q1": 50, "q2": 1, "q3": 50}
    assert max(df.count() for df in ranked) < 300
