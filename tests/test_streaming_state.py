"""Keyed tables of streaming batches and the live state of sessions."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from shelfspark.streaming import jobs, live_sessions
from shelfspark.streaming.keyed_table import KeyedTable
from test_jobs import rows


def counted(df):
    return df.groupBy("key").agg(F.sum("n").alias("n"), F.max("at").alias("at"))


def table(spark, folder, **sizes):
    schema = spark.createDataFrame([], "key string, n bigint, at bigint").schema
    return KeyedTable(spark, str(folder), schema, ["key"], counted, **sizes)


def batch(spark, number):
    return spark.createDataFrame([(f"k{i % 7}", 1, number) for i in range(number, number + 5)], "key string, n bigint, at bigint").coalesce(1)


def test_fifty_batches_leave_few_runs(spark, tmp_path):
    kept, want = table(spark, tmp_path / "t", buckets=2), {}
    most = 0
    for number in range(50):
        kept.add(batch(spark, number), number)
        for i in range(number, number + 5):
            n, _ = want.get(f"k{i % 7}", (0, 0))
            want[f"k{i % 7}"] = (n + 1, number)
        most = max(most, len(kept.runs()))
    assert rows(kept.read()) == sorted((k, *v) for k, v in want.items())
    assert most <= 3 * 3 + 1 and len(os.listdir(tmp_path / "t")) == len(kept.runs())
    assert sum(spark.read.parquet(kept._place(r)).count() for r in kept.runs()) <= 7 * len(kept.runs())
    assert rows(kept.lookup("k3")) == [("k3", *want["k3"])] and rows(kept.lookup("none")) == []


def test_repeated_and_interrupted_batches_count_once(spark, tmp_path):
    kept = table(spark, tmp_path / "t", buckets=2, fan=2)
    kept.add(batch(spark, 0), 0)
    kept.add(batch(spark, 0), 0)
    assert rows(kept.read()) == rows(counted(batch(spark, 0)))
    kept.add(batch(spark, 1), 1)
    assert kept.runs() == [(0, 1)]
    kept.add(batch(spark, 1), 1)  # again, after it was merged
    os.makedirs(kept._place((2, 3)))  # a merge that never ended
    kept._write(counted(batch(spark, 0)), (0, 0))  # covered, not yet removed
    both = batch(spark, 0).unionAll(batch(spark, 1))
    assert rows(kept.read()) == rows(counted(both))
    for number in (2, 3):
        kept.add(batch(spark, number), number)
    assert kept.runs() == [(0, 3)] and os.listdir(tmp_path / "t") == ["run-000000000-000000003"]
    assert table(spark, tmp_path / "none").read().count() == 0


EVENTS = "session_id string, ts timestamp, turn_id bigint, user_message string, assistant_message string, results array<string>, facts map<string,string>"


@pytest.fixture
def chat(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)

    def say(name, *turns):
        data = [(s, day + datetime.timedelta(minutes=m), i, f"u{i}", f"a{i}", [f"r{k}" for k in range(i)], facts) for s, m, i, facts in turns]
        spark.createDataFrame(data, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        kept = live_sessions.session_table(spark, str(tmp_path / "state"))
        live_sessions.run_live(stream, kept, str(tmp_path / "checkpoint"), watermark="10 minutes")
        return {r.session_id: r for r in live_sessions.live(kept).collect()}

    return say


def test_live_sessions(chat):
    got = chat("a", ("s", 0, 1, {"city": "Haifa", "brand": ""}), ("s", 5, 30, {"brand": "LG"}), ("t", 3, 2, None))
    assert (got["s"].user_message, len(got["s"].results), got["s"].fact_city, got["s"].fact_brand, got["s"].turns) == ("u30", 20, "Haifa", "LG", 2)
    assert got["t"].turns == 1 and got["t"].fact_city is None  # readable long before it closes
    got = chat("b", ("s", 100, 31, {"city": "Akko"}), ("s", 2, 3, {"city": "Old", "max_price": "9"}))
    assert (got["s"].user_message, got["s"].fact_city, got["s"].fact_brand, got["s"].fact_max_price, got["s"].turns) == ("u31", "Akko", "LG", "9", 4)
    got = chat("c", ("x", 140, 40, None))  # the watermark passes t's last turn by two hours
    assert set(got) == {"s", "x"} or set(got) == {"s", "t", "x"}
    got = chat("d", ("x", 141, 41, None))
    assert set(got) == {"s", "x"}
    got = chat("e", ("s", 400, 50, {"brand": "Sony"}))  # more than two hours later: a new session
    assert (got["s"].turns, got["s"].fact_city, got["s"].fact_brand) == (1, None, "Sony")
    got = chat("f", ("y", 900, 60, None))
    got = chat("g", ("y", 901, 61, None))
    assert set(got) == {"y"}


def test_price_batches_write_what_they_touch(spark, tmp_path):
    keys = [(f"l{i}", str(i), 1, f"u{i}", 10.0 + i) for i in range(200)]
    start = spark.createDataFrame(keys, "listing_id string, product_id string, store_id long, product_url string, price double").selectExpr(
        "*", "true AS availability", "'r' AS raw_name", "CAST(NULL AS string) AS image_url", "CAST(NULL AS timestamp) AS image_url_updated_at",
        "'ILS' AS currency", "timestamp'2024-01-01' AS updated_at")
    feed_schema = "product_id string, store_id long, product_url string, price double, availability boolean, raw_name string, image_url string, currency string, position long"
    listings = jobs.listing_table(spark, str(tmp_path / "listings"), start)
    for number in range(6):
        batch = [(str(i), 1, f"u{i}", 500.0 + number, True, "r", None, "ILS", i) for i in (number, number + 1)] + [("new", 1, f"n{number}", 1.0, True, "r", None, "ILS", 9)]
        spark.createDataFrame(batch, feed_schema).coalesce(1).write.parquet(str(tmp_path / "feed" / f"b{number}"))
        stream = spark.readStream.schema(feed_schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "feed"))
        jobs.track_prices(stream, listings, str(tmp_path / "changes"), F.to_timestamp(F.lit("2030-01-01")), str(tmp_path / "ck")).awaitTermination()
        if number == 0:
            assert spark.read.parquet(listings._place((1, 1))).count() == 3  # not the table
    got = {r.product_url: r.price for r in listings.read().collect()}
    want = {f"u{i}": 10.0 + i for i in range(200)} | {f"u{i}": 500.0 + min(i, 5) for i in range(7)} | {f"n{i}": 1.0 for i in range(6)}
    assert got == want
    changes = rows(spark.read.parquet(str(tmp_path / "changes")).where("product_url = 'u1'").select("batch", "old_price", "new_price"))
    assert changes == [(0, 11.0, 500.0), (1, 500.0, 501.0)]
