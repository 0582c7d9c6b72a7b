"""Store list, store search and the city-expanded search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.numbers import flat_earth_km
from shelfspark.functions.text import expand_city
from shelfspark.operators.filters import list_filter, store_filter
from shelfspark.operators.joins import stores_with_counts
from shelfspark.operators.patterns import near_join, pattern_join
from shelfspark.operators.ranking import first_per_key, rank_all, rank_within, top_n

# Rows per bucket and the multiple of the limit at which a capped search stops; no defaults.
BUCKET_ROWS = 10
STOP_FACTOR = 3


def list_stores(stores: DataFrame, city=None, category=None, online_only=False, page=1, page_size=50) -> DataFrame:
    """One page of stores by name, each row with the total of matching stores."""
    matching = list_filter(stores, city, category, online_only)
    total = matching.agg(F.count("*")).scalar()
    rows = matching.orderBy("name_he", "store_id").offset((page - 1) * page_size).limit(page_size)
    return rows.withColumn("total", total)


def store_search(
    stores: DataFrame, listings: DataFrame, *, query=None, store_type=None, city=None, hint=None, lat=None, lng=None,
    radius_km=10.0, page=1, page_size=40,
) -> DataFrame:
    """One store search: nearest first with a location, else most listings first; each row has the total.

    The unrounded distance is compared with the radius, the rounded one is shown and sorted by.
    """
    found = store_filter(stores, query=query, store_type=store_type, city=city, hint=hint, located=lat is not None)
    found = stores_with_counts(found, listings)
    if lat is not None:
        exact = flat_earth_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
        found = found.where(exact <= radius_km).withColumn("distance_km", F.round(exact, 2))
        order = [F.col("distance_km"), F.col("store_id")]
    else:
        found = found.withColumn("distance_km", F.lit(None).cast("double"))
        order = [F.desc("product_count"), F.col("store_id")]
    total = found.agg(F.count("*")).scalar()
    page_rows = found.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    return page_rows.withColumn("total_available", total)


def store_search_near(queries: DataFrame, stores: DataFrame, listings: DataFrame, rows: int | None = None) -> DataFrame:
    """Batch of located searches: ``query_id, q_lat, q_lng, radius_km``; all stores in reach, or the ``rows`` nearest.

    Stores at one place are equally far, so of each place the ``rows`` lowest ids are all
    that any list can show.
    """
    counted = stores_with_counts(stores, listings)
    if rows is not None:
        counted = top_n(counted.where("lat IS NOT NULL AND lng IS NOT NULL"), ["lat", "lng"], [F.col("store_id")], rows).drop("rank")
    found = near_join(queries, counted).withColumn("distance_km", F.round("exact_km", 2)).drop("exact_km")
    order = [F.col("distance_km"), F.col("store_id")]
    return rank_within(found, ["query_id"], order) if rows is None else top_n(found, ["query_id"], order, rows)


def city_expanded_search(
    queries: DataFrame, stores: DataFrame, listings: DataFrame, buckets=None, bucket_rows: int | None = None,
    stop_factor: int | None = None,
) -> DataFrame:
    """Batch store search over a city and its regional buckets.

    Queries: ``query_id, city, store_type, online_only, limit``. The online filter comes
    first; each bucket gives its stores by number of listings (``bucket_rows`` of them, if
    given); a store counts at its first bucket; with ``stop_factor`` buckets after the one
    that brings the list to so many times the limit are not used. Stores have no free-text
    filter here.
    """
    asked = queries.withColumn("buckets", expand_city(F.col("city"), buckets)).withColumn(
        "buckets", F.when(F.size("buckets") == 0, F.array(F.lit(""))).otherwise(F.col("buckets"))
    )
    patterns = asked.select("query_id", F.posexplode("buckets").alias("bucket", "_text")).select(
        "query_id", "bucket", F.concat(F.lit("%"), F.col("_text"), F.lit("%")).alias("pattern")
    )
    # An empty city text stands for "no city filter": it matches the stores without a city too.
    cities = stores.select(F.coalesce("city", F.lit("")).alias("_city")).distinct()
    counted = stores_with_counts(stores, listings).withColumn("_city", F.coalesce("city", F.lit("")))
    matched = pattern_join(patterns, cities, "_city").select("query_id", "bucket", "_city")
    parameters = queries.select("query_id", "store_type", "online_only", "limit")
    found = matched.join(counted, "_city").join(parameters, "query_id")
    found = found.where(F.col("store_type").isNull() | F.ilike(F.col("store_category"), F.col("store_type")))
    found = found.where(~F.coalesce("online_only", F.lit(False)) | F.col("is_online"))
    order = [F.desc("product_count"), F.col("store_id")]
    if bucket_rows is not None:
        found = top_n(found, ["query_id", "bucket"], order, bucket_rows).drop("rank")
    # Stores of one bucket keep their order, whatever the other buckets hold.
    found = found.withColumn("_less", -F.col("product_count"))
    merged = first_per_key(found, ["query_id", "store_id"], ["bucket"])
    if stop_factor is not None:
        merged = _stop_early(merged, stop_factor)
    # No list is longer than the longest asked for, so no task ranks more rows of a query than that.
    longest = queries.agg(F.max("limit")).first()[0] or 0
    ranked = top_n(merged, ["query_id"], [F.col("bucket"), F.col("_less"), F.col("store_id")], longest)
    return ranked.where(F.col("rank") <= F.col("limit")).drop("_less", "_city")


def _stop_early(merged: DataFrame, factor: int) -> DataFrame:
    """Drop buckets that start after the list is ``factor`` times as long as its limit."""
    sizes = merged.groupBy("query_id", "bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("query_id").orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("query_id", "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    used = merged.join(sizes, ["query_id", "bucket"]).where(F.col("_before") < F.col("limit") * factor)
    return used.drop("_before")


def collapse_chains(results: DataFrame, links: DataFrame) -> DataFrame:
    """Stores of one chain shown as one row with the number of locations; other stores stay as they are.

    ``results`` has ``query_id, rank, store_id``; ``links`` has ``store_id, chain_id``.
    The best ranked store stands for its chain.
    """
    keyed = results.join(links, "store_id", "left").withColumn(
        "card", F.coalesce(F.concat(F.lit("chain:"), F.col("chain_id").cast("string")), F.col("store_id").cast("string"))
    )
    cards = keyed.groupBy("query_id", "card").agg(
        F.min("rank").alias("_rank"), F.min_by("store_id", "rank").alias("store_id"), F.count("*").alias("locations")
    )
    return rank_within(cards, ["query_id"], [F.col("_rank")]).drop("_rank", "card")


def instock_first(df: DataFrame, score: str = "similarity", keys: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Availability first, then score, ties by product and store; all rows, or the first ``rows`` of each key."""
    order: list[Column] = [F.desc("availability"), F.desc(score), F.col("product_id"), F.col("store_id")]
    return rank_all(df, keys or ["query_id"], order) if rows is None else top_n(df, keys or ["query_id"], order, rows)
