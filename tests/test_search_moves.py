"""Searches move and write no more rows than they count or show."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from shelfspark.operators import ranking
from shelfspark.plans import product_search, refresh
from shelfspark.session import cut_lineage


def test_totals_write_counts_only(spark, monkeypatch):
    """All rows that pass the filters were written, to be counted and ranked."""
    draw = random.Random(2)
    queries = [("a", 1, 20), ("b", 2, 20), ("c", 3, 7), ("d", 1, 5), ("none", 1, 20)]
    rows = {"a": 500, "b": 300, "c": 200, "d": 3}
    kept = [(q, p, 0, round(draw.choice([0.2, 0.8949, 0.8951, 0.9, 1.0, draw.random()]), 4), 1) for q, n in rows.items() for p in range(n)]
    df = spark.createDataFrame(kept, "query_id string, product_id int, store_id int, similarity double, tier int")
    df = df.withColumn("match_score", F.round("similarity", 3))
    written = []
    cut = product_search.cut_lineage
    monkeypatch.setattr(product_search, "cut_lineage", lambda x: written.append(x.columns) or cut(x))
    asked = spark.createDataFrame(queries, "query_id string, page int, page_size int")
    got = {r.query_id: (r.total, r.total_available, r.exact_matches, r.similar_matches) for r in product_search.search_totals(asked, df).collect()}
    for q, page, size in queries:
        ranked = sorted((-s, p) for x, p, _, s, _ in kept if x == q)
        on_page = [round(-s, 3) >= 0.9 for s, _ in ranked][(page - 1) * size : page * size]
        assert got[q] == (len(on_page), len(ranked), sum(on_page), len(on_page) - sum(on_page)), q
    assert not any({"product_id", "store_id"} & set(columns) for columns in written)


def test_a_chat_batch_is_cut_before_it_is_shuffled(tables):
    """The retry without the city shuffled all rows of all queries to find those without an answer."""
    asked = tables.sql("SELECT * FROM v_queries").join(tables.embeddings.select("vec_id", "embedding"), "vec_id", "left")
    found = product_search.chat_product_search(asked, tables.listings, tables.products, tables.stores)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and "WindowGroupLimit" in plan
    assert plan.count("Scan parquet") and found.groupBy("query_id").count().agg(F.max("count")).first()[0] <= product_search.CHAT_ROWS


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    """Shuffle files of a finished write stayed until the driver's next garbage collection."""
    df = spark.range(200_000).select((F.col("id") % 5000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    runs = []
    for _ in range(2):
        before = shuffled(spark)
        assert cut_lineage(df.groupBy("k").agg(F.max("v").alias("v"))).count() == 5000
        for _ in range(50):  # files go in the background
            if (left := shuffled(spark) - before) <= 0:
                break
            time.sleep(0.1)
        runs.append(left)
    assert max(runs) < 50_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def shuffled(spark):
    """Bytes of shuffle files on the local disk."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(p.stat().st_size for folder in folders for p in Path(folder).rglob("shuffle_*.data") if p.exists())


def test_a_refresh_writes_what_its_outputs_read(tables, monkeypatch):
    """Price changes alone wrote all columns of the feed and a snapshot of the products."""
    written = []
    monkeypatch.setattr(refresh, "cut_lineage", lambda df: written.append(set(df.columns)) or cut_lineage(df))
    row = [F.lit(x).alias(n) for n, x in {"brand": "b", "category_path": "c", "product_url": "u", "raw_name": "r", "image_url": "i", "currency": "ILS", "availability": True}.items()]
    feed = tables.products.select(
        F.struct(F.lit(1).cast("bigint").alias("store_id"), F.lit(0).alias("kind"), F.lit(0).alias("page"), F.col("product_id").alias("index")).alias("position"),
        F.lit(1).cast("bigint").alias("store_id"), F.concat(F.col("canonical_name"), F.col("product_id").cast("string")).alias("canonical_name"), F.lit(5.0).alias("price"), *row)
    known = feed.where("position.index % 2 = 0").select(F.col("position.index").alias("product_id"), "canonical_name", F.lit(None).cast("string").alias("brand"), F.lit(None).cast("string").alias("category_path"))
    listings = known.select(
        F.col("product_id").cast("string").alias("listing_id"), "product_id", F.lit(1).cast("bigint").alias("store_id"), F.lit("u").alias("product_url"), (F.col("product_id") % 4 + 5.0).alias("price"),
        F.lit(True).alias("availability"), F.lit("old").alias("raw_name"), F.lit("i").alias("image_url"), F.lit(None).cast("timestamp").alias("image_url_updated_at"), F.lit("ILS").alias("currency"),
        F.lit(None).cast("timestamp").alias("updated_at"))
    args = (feed, known, listings, tables.stores, F.lit("2030-01-01").cast("timestamp"))
    got = refresh.refresh_catalog(*args, parts=["price_changes"])["price_changes"]
    assert got.count() == known.where("product_id % 4 = 2").count() > 0
    assert not any({"brand", "category_path", "raw_name", "image_url", "is_new"} & columns for columns in written)
    out = refresh.refresh_catalog(*args, parts=["listings", "products"])
    pairs = out["listings"].join(out["products"], "product_id").where("raw_name = canonical_name OR raw_name = 'r'").count()
    assert any({"product_id", "product_url"} <= columns for columns in written)  # else the feed is on disk three times at once
    assert list(out) == ["products", "listings"] and pairs == out["listings"].count() == feed.count()


def test_ranking_few_keys_shuffles_no_ranked_row(spark):
    """The written rows were shuffled once more, to meet one count per key and partition."""
    rows = spark.range(200_000).select((F.col("id") % 8).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        ranked = ranking.rank_all(rows, ["k"], [F.col("v")])
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert ranked.groupBy("k").agg(F.max("rank").alias("n"), F.count_distinct("rank").alias("d")).where("n = 25000 AND d = 25000").count() == 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
