"""Streaming jobs and their batch twins.

Each job is one function over a DataFrame of events: give it a stream and it is a
streaming aggregate, give it a table and it is the batch twin. ``run_available`` drains
the files of a source into a folder of updates; ``latest`` reads the current state.
Event time must be ``timestamp`` (watermarks refuse ``timestamp_ntz``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators.joins import price_changes
from shelfspark.operators.upserts import last_row, upsert_listings
from shelfspark.plans.profiles import attribute_rows
from shelfspark.session import cut_lineage, scratch_path
from shelfspark.streaming.keyed_table import KeyedTable

SESSION_GAP = "2 hours"


def with_event_time(events: DataFrame, ts: str = "ts", watermark: str | None = "1 hour") -> DataFrame:
    """Event time as ``timestamp``; a stream also gets its watermark."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, watermark) if watermark and events.isStreaming else events


def daily_cost(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Cost per UTC day; only positive costs count. The watermark is the grace after midnight."""
    timed = with_event_time(events, watermark=watermark).where("cost > 0")
    return timed.groupBy(F.window("ts", "1 day")).agg(F.sum("cost").alias("cost")).select(
        F.col("window.start").alias("day_start"), "cost"
    )


def session_cost(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Cost per session; the total starts anew after two hours without spending."""
    timed = with_event_time(events, watermark=watermark).where("cost > 0")
    return timed.groupBy("session_id", F.session_window("ts", SESSION_GAP)).agg(F.sum("cost").alias("cost")).select(
        "session_id", F.col("session_window.start").alias("started"), "cost"
    )


def session_state(events: DataFrame, watermark: str = "1 hour", facts: tuple[str, ...] = ("brand", "max_price", "city"),
                  items: int = 20) -> DataFrame:
    """State of each session: results and messages of the last turn, merged facts, two hours to live.

    Events: ``session_id, ts, turn_id, user_message, assistant_message, results
    array<string>, facts map<string,string>``. The last turn's results are cut to 20;
    a fact keeps its newest value that is not blank.
    """
    timed = with_event_time(events, watermark=watermark)
    order = F.struct("ts", "turn_id")
    # A map cannot be compared, so each fact is a column of its own.
    merged = []
    for name in facts:
        value = F.nullif(F.try_element_at("facts", F.lit(name)), F.lit(""))
        merged.append(F.max_by(value, F.when(value.isNotNull(), order)).alias(f"fact_{name}"))
    last = F.max_by(
        F.struct("user_message", "assistant_message", F.slice("results", 1, items).alias("results")), order
    ).alias("last")
    grouped = timed.groupBy("session_id", F.session_window("ts", SESSION_GAP)).agg(
        last, *merged, F.count("*").alias("turns")
    )
    return grouped.select(
        "session_id", F.col("session_window.start").alias("started"), "last.*", *[f"fact_{n}" for n in facts], "turns"
    )


SIGNAL_KEYS = ["user_id", "signal_type", "signal_value"]
ATTRIBUTE_KEYS = ["user_id", "attribute"]


def signal_parts(events: DataFrame) -> DataFrame:
    """Counts and last times of the signals in some events."""
    return events.groupBy(*SIGNAL_KEYS).agg(F.count("*").alias("count"), F.max(F.col("ts").cast("timestamp")).alias("last_seen"))


def merge_signals(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*SIGNAL_KEYS).agg(F.sum("count").alias("count"), F.max("last_seen").alias("last_seen"))


def weighed_signals(merged: DataFrame) -> DataFrame:
    """The first sight of a signal weighs 1, repeats raise the weight by 0.1."""
    return merged.withColumn("weight", F.round(F.lit(1.0) + F.lit(0.1) * (F.col("count") - 1), 6))


def signals(events: DataFrame) -> DataFrame:
    """Implicit signals of a table of events."""
    return weighed_signals(signal_parts(events))


def merge_attributes(parts: DataFrame) -> DataFrame:
    """The latest row of each attribute; of rows of one time the greatest value."""
    row = F.struct("last_updated", "value", "confidence", "source")
    return parts.groupBy(*ATTRIBUTE_KEYS).agg(F.max(row).alias("v")).select(*ATTRIBUTE_KEYS, "v.value", "v.confidence", "v.source", "v.last_updated")


def attributes(events: DataFrame) -> DataFrame:
    """Latest inferred attribute per user."""
    told = attribute_rows(events.withColumn("ts", F.col("ts").cast("timestamp")))
    return merge_attributes(told.select(*ATTRIBUTE_KEYS, "value", "confidence", "source", F.col("ts").alias("last_updated")))


def listing_versions(rows: DataFrame) -> DataFrame:
    """The last version of each listing."""
    values = [c for c in rows.columns if c not in ("listing_id", "version")]
    row = F.struct("version", *values)
    return rows.groupBy("listing_id").agg(F.max(row).alias("v")).select("listing_id", "v.*").select(*rows.columns)


def rate_breaches(events: DataFrame, per_minute: int, watermark: str = "1 minute") -> DataFrame:
    """Clients with more than the allowed events in a minute."""
    timed = with_event_time(events, watermark=watermark)
    counted = timed.groupBy("client_id", F.window("ts", "1 minute")).agg(F.count("*").alias("events"))
    return counted.where(F.col("events") > per_minute).select(
        "client_id", F.col("window.start").alias("minute"), "events"
    )


def trace_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Traces per intent and window, tumbling or sliding."""
    timed = with_event_time(events, watermark=watermark)
    return timed.groupBy(F.window("ts", size, slide), "intent").agg(F.count("*").alias("traces")).select(
        F.col("window.start").alias("window_start"), "intent", "traces"
    )


# ---------------------------------------------------------------------------
# running
# ---------------------------------------------------------------------------


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int | None = None):
    """A file stream over Parquet events."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def write_updates(folder: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: each batch's changed rows under its batch number; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Current state of the update folder: the newest batch per key."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")


def run_available(result: DataFrame, keys: list[str] | None = None, mode: str = "update", label: str = "stream") -> DataFrame:
    """Drain what the source holds now and return the state.

    ``update`` writes changed rows per batch and reads the newest per key; ``append``
    keeps the rows the watermark has closed (session windows emit this way).
    """
    spark = result.sparkSession
    folder = scratch_path(spark, label)
    writer = result.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}-checkpoint")
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", folder).start().awaitTermination()
        return spark.read.schema(result.schema).parquet(folder)
    writer.outputMode(mode).foreachBatch(write_updates(folder)).start().awaitTermination()
    schema = T.StructType([*result.schema.fields, T.StructField("batch", T.IntegerType())])
    return latest(spark.read.schema(schema).parquet(folder), keys or [])


def upsert_stream(
    events: DataFrame, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], keys: list[str], folder: str, checkpoint: str
) -> KeyedTable:
    """Drain what the source holds now into a keyed table: each batch adds its own partial aggregate.

    The query itself has no state, so nothing grows with the number of batches but the
    rows of new keys.
    """
    spark = events.sparkSession
    schema = partial(spark.createDataFrame([], events.schema)).schema
    table = KeyedTable(spark, folder, schema, keys, merge)
    query = events.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    query.foreachBatch(lambda batch, number: table.add(partial(batch), number)).start().awaitTermination()
    return table


def listing_table(spark: SparkSession, folder: str, listings: DataFrame) -> KeyedTable:
    """The listings as versions per listing; a new folder starts with the rows of ``listings``."""
    start = listings.withColumn("version", F.lit(0).cast("bigint"))
    table = KeyedTable(spark, folder, start.schema, ["listing_id"], listing_versions)
    if not table.runs():
        table.add(start, 0)
    return table


def track_prices(feed: DataFrame, listings: KeyedTable, changes_folder: str, as_of: Column, checkpoint: str):
    """Scrape batches against the current listings: writes the changes and the listings that a batch touches.

    A batch reads the listings of its own keys and adds their new versions, so what it
    writes follows the batch, not the table. A batch that runs again after a failure writes
    the same rows, or nothing where it had come to its end.
    """
    keyed = ["product_id", "store_id", "product_url"]

    def apply(batch: DataFrame, number: int) -> None:
        if listings.has(number + 1):
            return  # its changes were written before
        batch = cut_lineage(batch)  # read four times
        current = cut_lineage(listings.read().join(batch.select(*keyed).distinct(), keyed, "left_semi").drop("version"))
        arriving = batch.groupBy(*keyed).agg(last_row("price", "availability").alias("v")).select(*keyed, "v.*")
        price_changes(current, arriving, keyed, as_of).write.mode("overwrite").parquet(f"{changes_folder}/batch={number}")
        touched = upsert_listings(current, batch, as_of).drop("is_new")
        listings.add(touched.withColumn("version", F.lit(number + 1).cast("bigint")), number + 1)

    return feed.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(apply).start()
