"""Jobs against brute force, skewed inputs and repeated runs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.operators import filters, patterns, percentiles, quarantine, ranking, upserts, vectors
from shelfspark.plans import dedup, product_search
from shelfspark.plans.refresh import price_history
from shelfspark.session import shared_folder
from shelfspark.streaming import jobs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def vector_frame(spark, matrix, ids=None):
    ids = ids or list(range(len(matrix)))
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, matrix)], "id bigint, embedding array<double>")


def walk(matrix, ids, threshold):
    """The sequential rule: by id, a free product takes its free neighbours."""
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 9) >= threshold
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    taken, out = set(), set()
    for i in order:
        if i in taken:
            continue
        group = [j for j in order if j != i and near[i, j] and j not in taken]
        if group:
            taken.add(i)
            taken.update(group)
            out.update((ids[j], ids[i]) for j in [i, *group])
    return sorted(out)


def clustered(seed, n=120, d=8, spread=0.25, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    matrix = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, d))
    if copies:
        matrix[:copies] = matrix[0]
    ids = [int(x) for x in rng.permutation(1000)[:n]]
    return matrix, ids


@pytest.mark.parametrize("seed, threshold, copies", [(1, 0.9, 0), (2, 0.95, 0), (3, 0.8, 40), (4, 0.9, 40)])
def test_groups_equal_the_sequential_walk(spark, monkeypatch, seed, threshold, copies):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)  # several sub-blocks per cell
    matrix, ids = clustered(seed, copies=copies)
    assert rows(dedup.duplicate_groups(vector_frame(spark, matrix, ids), threshold)) == walk(matrix, ids, threshold)


def test_no_vectors_give_no_groups(spark):
    empty = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "id bigint, embedding array<double>")
    assert rows(dedup.duplicate_groups(empty, 0.95)) == []


@pytest.mark.parametrize("copies", [0, 60])
def test_pairs_equal_brute_force(spark, monkeypatch, copies):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    matrix, ids = clustered(7, copies=copies)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 9)
    want = []
    for i, a in enumerate(ids):
        near = sorted((-cos[i, j], b) for j, b in enumerate(ids) if j != i and cos[i, j] >= 0.85)[:5]
        want += [(a, b, rank + 1) for rank, (_, b) in enumerate(near)]
    got = vectors.near_duplicate_pairs(vector_frame(spark, matrix, ids), 0.85, k=5).select("id", "neighbour", "rank")
    assert rows(got) == sorted(want)


@pytest.mark.parametrize("shipped", [2048, 3])
def test_top_k_in_both_ways(spark, monkeypatch, shipped):
    """A small batch is shipped to the tasks, a larger one meets the items in blocks; both are exact."""
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", shipped)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    matrix, ids = clustered(9, copies=20)
    queries, _ = clustered(10, n=10)
    got = vectors.top_k_similar(
        vector_frame(spark, queries).withColumnRenamed("id", "query_id"),
        vector_frame(spark, matrix, ids).repartition(5).withColumnRenamed("id", "item_id"), k=7, min_similarity=0.1,
    ).select("query_id", "item_id", "rank")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = np.round(unit(queries) @ unit(matrix).T, 9)
    want = []
    for q in range(len(queries)):
        best = sorted((-c, i) for c, i in zip(cos[q], ids) if c >= 0.1)[:7]
        want += [(q, i, r + 1) for r, (_, i) in enumerate(best)]
    assert rows(got) == sorted(want)


def test_matching_without_masters(spark):
    candidates = spark.createDataFrame([("a", "text", [1.0, 0.0]), ("b", "text", None)], "candidate_id string, text string, embedding array<double>")
    none = spark.createDataFrame([], "master_id string, name string, embedding array<double>")
    got = {r["candidate_id"]: r for r in vectors.match_to_masters(candidates, none).collect()}
    assert got["a"]["reason"] == got["b"]["reason"] == "No existing products to compare against."
    one = spark.createDataFrame([("m2", "two", [2.0, 0.0]), ("m1", "one", [1.0, 0.0])], "master_id string, name string, embedding array<double>")
    got = {r["candidate_id"]: r for r in vectors.match_to_masters(candidates, one).collect()}
    assert (got["a"]["is_duplicate"], got["a"]["master_id"], got["b"]["reason"]) == (True, "m1", "embedding failed")


@pytest.mark.parametrize("rows", [40_000, 7, 21, 203])
def test_percentiles_with_one_hot_group(spark, rows):
    """Bracketed ranks agree with the sorted list; one key holds most rows and many equal values."""
    rnd = random.Random(3)
    data = [("hot" if i % 3 else f"k{i % 4}", float(rnd.choice([5, rnd.uniform(0, 1000)]))) for i in range(rows)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r for r in percentiles.exact_percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95}).collect()}
    picks = {r["k"]: r for r in percentiles.exact_percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95}, method="pick").collect()}
    for key in got:
        values = sorted(v for k, v in data if k == key)
        assert got[key]["a"] == pytest.approx(np.percentile(values, 50))
        assert got[key]["b"] == pytest.approx(np.percentile(values, 95))
        assert picks[key]["a"] == values[len(values) // 2]
        assert picks[key]["b"] == values[int(len(values) * 0.95)]


def test_ranks_of_hot_and_null_keys(spark):
    data = [("hot", i * 7919 % 5000) for i in range(5000)] + [(None, 1), (None, None), ("b", 3), ("b", 2)]
    df = spark.createDataFrame(data, "k string, v int").repartition(7)
    got = ranking.rank_all(df, ["k"], [F.desc("v")])
    assert got.schema["rank"].dataType.simpleString() == "int"
    assert sorted(map(repr, got.collect())) == sorted(map(repr, ranking.rank_within(df, ["k"], [F.desc("v")]).collect()))
    assert ranking.rank_all(df.limit(0), ["k"], [F.desc("v")]).collect() == []


def test_equal_positions_have_one_winner(spark):
    """Feed rows of one position: the greatest values win, however the rows are dealt."""
    data = [("p", 1, "u", 21215.9, False, "a", "i1", "USD", 5), ("p", 1, "u", 85323.69, True, "a", "i2", "ILS", 5), ("p", 1, "u", 3.0, True, "z", None, "EUR", 4)]
    feed = spark.createDataFrame(data, "product_id string, store_id int, product_url string, price double, availability boolean, raw_name string, image_url string, currency string, position int")
    target = feed.limit(0).select(F.lit("l").alias("listing_id"), "product_id", "store_id", "product_url", "price", "availability", "raw_name", "image_url",
                                  F.lit(None).cast("timestamp").alias("image_url_updated_at"), "currency", F.lit(None).cast("timestamp").alias("updated_at"))
    for dealt in (feed.coalesce(1), feed.orderBy(F.desc("price")).coalesce(1), feed.repartition(3)):
        row = upserts.upsert_listings(target, dealt, F.lit(None).cast("timestamp")).first()
        assert (row.price, row.availability, row.image_url, row.currency) == (85323.69, True, "i2", "EUR")
    stores = spark.createDataFrame([(1, "u", "old", "c")], "store_id int, partner_url string, name_he string, store_category string")
    said = spark.createDataFrame([("u", "a", "x", 1), ("u", "b", None, 1)], "partner_url string, name_he string, store_category string, position int")
    row = upserts.upsert_stores(stores, said, ["name_he"]).first()
    assert row.name_he == "b"
    assert upserts.update_store_categories(stores, said).first().store_category == "x"


def test_pattern_join_equals_a_loop(spark):
    texts = ["Red Ring", "string", "50% off", "a_b", "axb", "", "Ünï"]
    asked = ["%ring%", "%50\\%%", "%a_b%", "%a\\_b%", "%%", "%ÜN%", "%x%", "%r\\ing%", "_xb"]
    found = patterns.pattern_join(spark.createDataFrame([(p,) for p in asked], "pattern string").withColumn("id", F.col("pattern")),
                                  spark.createDataFrame([(t,) for t in texts], "text string"))
    import re

    def like(value, pattern):
        regex = re.sub(r"\\(.)|(%)|(_)|(.)", lambda m: re.escape(m[1]) if m[1] else ".*" if m[2] else "." if m[3] else re.escape(m[4]), pattern)
        return re.fullmatch(regex, value, re.I | re.S) is not None

    assert rows(found.select("id", "text")) == sorted((p, t) for p in asked for t in texts if like(t, p))


def test_near_join_equals_a_loop(spark):
    rnd = random.Random(5)
    places = [(i, rnd.uniform(-70, 70), rnd.uniform(-179, 179)) for i in range(60)] + [(100 + i, 32 + i * 0.02, 34.8) for i in range(20)]
    asked = [(i, rnd.uniform(-70, 70), rnd.uniform(-170, 170), rnd.choice([0.1, 3.0, 80.0, 500.0])) for i in range(30)] + [(50, 32.1, 34.8, 2.0), (51, 32.0, 34.9, 500.0)]
    got = patterns.near_join(spark.createDataFrame(asked, "query_id int, q_lat double, q_lng double, radius_km double"),
                             spark.createDataFrame(places, "store_id int, lat double, lng double"))

    def km(q, s):
        return math.sqrt(((q[1] - s[1]) * 111.0) ** 2 + ((q[2] - s[2]) * 111.0 * math.cos(math.radians(q[1]))) ** 2)

    assert rows(got.select("query_id", "store_id")) == sorted((q[0], s[0]) for q in asked for s in places if km(q, s) <= q[3])


def test_filters_commute(spark, tables):
    wide = tables.listings_wide.withColumnRenamed("product_brand", "brand")
    both = filters.search_filters(wide, max_price=50000.0, city="nation_1", online_only=True)
    steps = filters.search_filters(filters.search_filters(filters.search_filters(wide, online_only=True), max_price=50000.0), city="nation_1")
    assert rows(both.select("listing_id")) == rows(steps.select("listing_id"))


def test_max_price_keeps_and_min_price_drops_unpriced(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 50.0)], "id int, price double")
    assert rows(filters.search_filters(df, max_price=10.0).select("id")) == [(1,), (2,)]
    assert rows(filters.search_filters(df, min_price=10.0).select("id")) == [(3,)]


def test_restore_undoes_quarantine(spark, tables):
    data = tables.listings.dropDuplicates(["listing_id"])
    clean, saved = quarantine.quarantine(data, filters.bogus_price_targets(data), "listing_id", "price")
    assert clean.where("price = 999999 OR price <= 0").count() == 0
    back = quarantine.restore(clean, saved, "listing_id", "price")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, data.collect()))


def test_upserts_are_idempotent(spark):
    as_of = F.to_timestamp(F.lit("2030-01-01"))
    target = spark.createDataFrame([("l1", "p", 1, "u", 5.0, True, "old", None, None, "ILS", None)],
                                   "listing_id string, product_id string, store_id int, product_url string, price double, availability boolean, raw_name string, "
                                   "image_url string, image_url_updated_at timestamp, currency string, updated_at timestamp")
    feed = spark.createDataFrame([("p", 1, "u", None, False, "n", "img", "USD", 1), ("p", 1, "u", 7.0, True, "m", None, "USD", 2), ("p", 2, "w", 1.0, True, "x", None, "USD", 3)],
                                 "product_id string, store_id int, product_url string, price double, availability boolean, raw_name string, image_url string, currency string, position int")
    once = upserts.upsert_listings(target, feed, as_of)
    twice = upserts.upsert_listings(once.drop("is_new"), feed, as_of)
    assert rows(once.drop("is_new").select(sorted(once.drop("is_new").columns))) == rows(twice.drop("is_new").select(sorted(once.drop("is_new").columns)))
    kept = once.where("listing_id = 'l1'").first()
    assert (kept["price"], kept["image_url"], kept["currency"], kept["raw_name"]) == (7.0, "img", "ILS", "m")


def test_price_history_does_not_depend_on_buckets(spark, tables):
    keys = ["store_id"]  # few keys with long histories
    by_month = price_history(tables.price_snapshots, keys, "month")
    assert rows(by_month) == rows(price_history(tables.price_snapshots, keys, "year"))


def test_search_results_are_candidates(spark, tables):
    asked = tables.sql("SELECT query_id, search_text FROM v_queries").limit(5)
    found = product_search.hybrid_product_search(asked.withColumn("show_out_of_stock", F.lit(True)), tables.listings, tables.products, tables.stores)
    matched = product_search.matching_products(asked, tables.products).select("query_id", "product_id")
    assert found.count() > 0 and found.join(matched, ["query_id", "product_id"], "left_anti").count() == 0


def test_rerank_without_a_brand_changes_nothing(spark):
    df = spark.createDataFrame([("q", 1, "b"), ("q", 2, None), ("q", 3, "a")], "query_id string, rank int, brand string")
    assert rows(ranking.rerank_by_brand(df, F.lit("")).select("rank", "brand")) == [(1, "b"), (2, None), (3, "a")]
    assert rows(ranking.rerank_by_brand(df, F.lit("A")).select("rank", "brand")) == [(1, "a"), (2, "b"), (3, None)]


def test_stream_in_many_batches_equals_its_batch_twin(spark, tables, tmp_path):
    """Replay in time order, several files, one file per batch."""
    events = tables.events.select("ts", F.col("event_type").alias("intent"))
    for part, (low, high) in enumerate([(0, 300), (300, 700), (700, 10**9)]):
        tables.events.where(f"event_id >= {low} AND event_id < {high}").select("ts", F.col("event_type").alias("intent")).coalesce(1).write.parquet(str(tmp_path / f"in{part}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in*"))
    state = jobs.run_available(jobs.trace_counts(stream, watermark="3650 days"), ["window_start", "intent"])
    assert rows(state) == rows(jobs.trace_counts(events))


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "session_id string, ts timestamp, cost double"
    write = lambda name, data: spark.createDataFrame(data, "session_id string, t string, cost double").select(
        "session_id", F.to_timestamp("t").alias("ts"), "cost").coalesce(1).write.parquet(str(tmp_path / name))
    source = lambda: jobs.daily_cost(
        spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")

    def drain():
        (source().writeStream.trigger(availableNow=True).outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(jobs.write_updates(out)).start().awaitTermination())

    write("in/a", [("s", "2024-01-01 10:00:00", 1.0), ("s", "2024-01-03 10:00:00", 2.0)])
    drain()
    write("in/b", [("s", "2024-01-01 11:00:00", 50.0), ("s", "2024-01-03 11:00:00", 0.0), ("s", "2024-01-03 09:30:00", 4.0)])
    drain()
    state = jobs.latest(spark.read.parquet(out), ["day_start"])
    assert [(str(d)[:10], c) for d, c in rows(state)] == [("2024-01-01", 1.0), ("2024-01-03", 6.0)]


def test_shared_folder_is_the_sessions_own(spark):
    class Session:
        class conf:
            get = staticmethod({"spark.checkpoint.dir": "hdfs://shared/checkpoints/"}.get)

        class sparkContext:
            master = "spark://host:7077"

    assert shared_folder(Session) == "hdfs://shared/checkpoints"
    Session.conf.get = staticmethod({}.get)
    with pytest.raises(RuntimeError):
        shared_folder(Session)  # a cluster without a shared folder
    assert shared_folder(spark) == shared_folder(spark)


def test_task_functions_need_no_package_on_the_workers(tmp_path):
    """A worker started elsewhere can load what the tasks run."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    payload = cloudpickle.dumps(vectors._best)
    code = "import pickle, sys, numpy as np; f = pickle.loads(sys.stdin.buffer.read()); print(f(np.array([1.0, 3.0, 3.0]), np.array([5, 9, 2]), 2).tolist())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], input=payload, capture_output=True, cwd=tmp_path, env=env, timeout=60)
    assert done.stdout.decode().strip() == "[2, 1]"
