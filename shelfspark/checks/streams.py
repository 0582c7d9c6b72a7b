"""Streams drained with ``availableNow``, checked against SQL over the same events."""

from pyspark.sql import functions as F

from shelfspark.checks.registry import check
from shelfspark.operators import ranking
from shelfspark.session import scratch_path
from shelfspark.streaming import jobs, live_sessions


def events(t):
    """The events table as a file stream."""
    return jobs.event_stream(t.spark, t.folder, t.events.schema, "events.parquet")


def micros(column):
    return F.unix_micros(F.col(column)).alias(column)


@check("st02_stream_daily_cost", """
SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS day_start, round(sum(value * 0.001::DOUBLE), 6) AS cost FROM events WHERE value > 5 GROUP BY 1""")
def _(t):
    spent = events(t).withColumn("cost", F.when(F.col("value") > 5, F.col("value") * 0.001).otherwise(0.0))
    state = jobs.run_available(jobs.daily_cost(spent), ["day_start"], label="daily")
    return state.select(micros("day_start"), F.round("cost", 6).alias("cost"))


SESSIONS = """
e AS (SELECT *, user_id AS session_id, lag(ts) OVER w AS prev FROM events {where} WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)"""
CLOSED = "max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@check("st03_stream_session_cost", f"""
WITH {SESSIONS.format(where="WHERE value > 5")}
SELECT session_id, epoch_us(min(ts)) AS started, round(sum(value * 0.001::DOUBLE), 6) AS cost FROM n GROUP BY session_id, s
HAVING {CLOSED.replace("FROM events", "FROM events WHERE value > 5")}""")
def _(t):
    spent = events(t).withColumn("cost", F.when(F.col("value") > 5, F.col("value") * 0.001).otherwise(0.0)).withColumn("session_id", F.col("user_id"))
    closed = jobs.run_available(jobs.session_cost(spent), mode="append", label="sessions")
    return closed.select("session_id", micros("started"), F.round("cost", 6).alias("cost"))


@check("st03_session_cost_batch_twin", f"""
WITH {SESSIONS.format(where="WHERE value > 5")}
SELECT session_id, epoch_us(min(ts)) AS started, round(sum(value * 0.001::DOUBLE), 6) AS cost FROM n GROUP BY session_id, s""")
def _(t):
    spent = t.events.withColumn("cost", F.when(F.col("value") > 5, F.col("value") * 0.001).otherwise(0.0)).withColumn("session_id", F.col("user_id"))
    return jobs.session_cost(spent).select("session_id", micros("started"), F.round("cost", 6).alias("cost"))


def turns(df):
    e = F.col("event_id")
    return df.select(
        F.col("user_id").alias("session_id"), "ts", e.alias("turn_id"), F.concat(F.lit("u"), e.cast("string")).alias("user_message"), F.concat(F.lit("a"), e.cast("string")).alias("assistant_message"),
        F.transform(F.sequence(F.lit(1), (e % 30 + 1).cast("int")), lambda i: F.concat(F.lit("r"), i.cast("string"))).alias("results"),
        F.map_filter(F.create_map(F.lit("city"), F.when(e % 3 == 0, "").otherwise(F.concat(F.lit("C"), e.cast("string"))), F.lit("brand"), F.when(e % 4 == 0, F.concat(F.lit("B"), e.cast("string")))),
                     lambda k, v: v.isNotNull()).alias("facts"),
    )


STATE = f"""
WITH {SESSIONS.format(where="")}
SELECT session_id, epoch_us(min(ts)) AS started, 'u' || cast(arg_max(event_id, ts) AS varchar) AS user_message, least(20, arg_max(event_id, ts) % 30 + 1)::INT AS items,
 'C' || cast(arg_max(event_id, ts) FILTER (WHERE event_id % 3 <> 0) AS varchar) AS fact_city, 'B' || cast(arg_max(event_id, ts) FILTER (WHERE event_id % 4 = 0) AS varchar) AS fact_brand, count(*) AS turns
FROM n GROUP BY session_id, s"""


def shown_state(df, *more):
    return df.select("session_id", micros("started"), "user_message", F.size("results").alias("items"), "fact_city", "fact_brand", "turns", *more)


@check("st04_stream_session_state", f"{STATE} HAVING {CLOSED}")
def _(t):
    return shown_state(jobs.run_available(jobs.session_state(turns(events(t))), mode="append", label="state"))


# The last session of each user; it has expired once the watermark is two hours past its last turn.
@check("st04_live_session_state", f"""
SELECT session_id::VARCHAR AS session_id, started, user_message, items, fact_city, fact_brand, turns,
  last <= (SELECT max(ts) FROM events) - INTERVAL 3 HOUR AS expired
FROM ({STATE.replace("SELECT session_id,", "SELECT session_id, max(ts) AS last,", 1)}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY started DESC) = 1""")
def _(t):
    folder = scratch_path(t.spark, "live")
    table = live_sessions.session_table(t.spark, folder)
    live_sessions.run_live(turns(events(t)), table, f"{folder}-checkpoint")
    return shown_state(table.read(), "expired")


@check("st04_session_state_batch_twin", STATE)
def _(t):
    return shown_state(jobs.session_state(turns(t.events)))


@check("st05_stream_signal_upsert", """
SELECT user_id, event_type AS signal_value, count(*) AS count, round(1.0::DOUBLE + 0.1::DOUBLE * (count(*) - 1), 6) AS weight, epoch_us(max(ts)) AS last_seen FROM events GROUP BY 1, 2""")
def _(t):
    rows = events(t).select("user_id", F.lit("city_search").alias("signal_type"), F.col("event_type").alias("signal_value"), "ts")
    folder = scratch_path(t.spark, "signals")
    table = jobs.upsert_stream(rows, jobs.signal_parts, jobs.merge_signals, jobs.SIGNAL_KEYS, folder, f"{folder}-checkpoint")
    return jobs.weighed_signals(table.read()).select("user_id", "signal_value", "count", "weight", micros("last_seen"))


def statements(df):
    e = F.col("event_id")
    name = F.when(F.col("event_type") == "view", "interests").otherwise(F.col("event_type"))
    value = F.when(e % 5 == 0, F.lit(None).cast("string")).when((name == "interests") & (e % 5 == 1), "[]").otherwise(F.concat(F.lit("v"), e.cast("string")))
    return df.select("user_id", name.alias("attribute"), value.alias("value"), "ts", F.repeat(F.col("event_type"), 100).alias("source"))


ATTRIBUTES = """
WITH s AS (SELECT user_id, CASE WHEN event_type = 'view' THEN 'interests' ELSE event_type END AS attribute, event_id, ts FROM events WHERE event_id % 5 <> 0 AND NOT (event_type = 'view' AND event_id % 5 = 1))
SELECT user_id, attribute, 'v' || cast(arg_max(event_id, ts) AS varchar) AS value, CASE WHEN attribute = 'interests' THEN 0.65 ELSE 0.7 END::DOUBLE AS confidence, 200 AS source_length FROM s GROUP BY 1, 2"""


@check("st06_stream_attribute_upsert", ATTRIBUTES)
def _(t):
    folder = scratch_path(t.spark, "attributes")
    table = jobs.upsert_stream(statements(events(t)), jobs.attributes, jobs.merge_attributes, jobs.ATTRIBUTE_KEYS, folder, f"{folder}-checkpoint")
    return table.read().select("user_id", "attribute", "value", "confidence", F.length("source").alias("source_length"))


@check("st06_attribute_upsert_batch_twin", ATTRIBUTES)
def _(t):
    return jobs.attributes(statements(t.events)).select("user_id", "attribute", "value", "confidence", F.length("source").alias("source_length"))


@check("st07_stream_rate_breach", """
SELECT user_id % 10 AS client_id, epoch_us(date_trunc('day', ts)::TIMESTAMP) AS minute, count(*) AS events FROM events GROUP BY 1, 2 HAVING count(*) > 3""")
def _(t):
    # A day of the sparse test events is folded into its first minute.
    rows = events(t).select((F.col("user_id") % 10).alias("client_id"), F.date_trunc("day", F.col("ts")).alias("ts"))
    state = jobs.run_available(jobs.rate_breaches(rows, 3), ["client_id", "minute"], label="rates")
    return state.select("client_id", micros("minute"), "events")


@check("st08_stream_trace_counts", "SELECT epoch_us(date_trunc('hour', ts)::TIMESTAMP) AS window_start, event_type AS intent, count(*) AS traces FROM events GROUP BY 1, 2")
def _(t):
    rows = events(t).select("ts", F.col("event_type").alias("intent"))
    state = jobs.run_available(jobs.trace_counts(rows), ["window_start", "intent"], label="traces")
    return state.select(micros("window_start"), "intent", "traces")


@check("st08_sliding_batch_twin", """
SELECT epoch_us(date_trunc('hour', ts)::TIMESTAMP - (k * INTERVAL 1 HOUR)) AS window_start, event_type AS intent, count(*) AS traces FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2""")
def _(t):
    rows = t.events.select("ts", F.col("event_type").alias("intent"))
    return jobs.trace_counts(rows, "2 hours", "1 hour").select(micros("window_start"), "intent", "traces")


@check("st01_stream_price_changes", """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY product_id, store_id, product_url ORDER BY updated_at, listing_id) AS rn FROM v_listings WHERE product_url IS NOT NULL)
SELECT a.product_id, a.store_id, a.product_url, a.price AS old_price, b.price AS new_price, a.availability AS old_availability, b.availability AS new_availability
FROM s a JOIN s b USING (product_id, store_id, product_url) WHERE a.rn = 1 AND b.rn = 2 AND (a.price IS DISTINCT FROM b.price OR a.availability IS DISTINCT FROM b.availability)""")
def _(t):
    keys = ["product_id", "store_id", "product_url"]
    rows = ranking.top_n(t.listings.where("product_url IS NOT NULL"), keys, [F.col("updated_at"), F.col("listing_id")], 2)
    folder = scratch_path(t.spark, "prices")
    first = rows.where("rank = 1").select(
        "listing_id", *keys, "price", "availability", F.lit("r").alias("raw_name"), "image_url", F.lit(None).cast("timestamp").alias("image_url_updated_at"), "currency",
        F.col("updated_at").cast("timestamp").alias("updated_at"))
    feed = rows.where("rank = 2").select(*keys, "price", "availability", F.lit("r").alias("raw_name"), "image_url", "currency", F.col("listing_id").alias("position"))
    feed.write.parquet(f"{folder}/feed")
    stream = t.spark.readStream.schema(feed.schema).parquet(f"{folder}/feed")
    now = F.to_timestamp(F.lit("2030-01-01 00:00:00"))
    jobs.track_prices(stream, jobs.listing_table(t.spark, f"{folder}/listings", first), f"{folder}/changes", now, f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/changes").select(*keys, "old_price", "new_price", "old_availability", "new_availability")
