"""Joins of the catalogue, the traffic tables and their worklists.

A side is broadcast only behind a check of its size: ``small_side`` counts the rows of
the store dimension, everywhere else Spark's own threshold decides. Skewed partitions of
shuffled joins are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import small_side


def listings_wide(listings: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Listings with their product and store."""
    return listings.join(products, "product_id").join(small_side(stores), "store_id")


def stores_with_counts(stores: DataFrame, listings: DataFrame) -> DataFrame:
    """Every store with its number of listings, 0 when it has none."""
    counts = listings.groupBy("store_id").agg(F.count("listing_id").alias("product_count"))
    return stores.join(counts, "store_id", "left").withColumn(
        "product_count", F.coalesce("product_count", F.lit(0).cast("bigint"))
    )


def first_store_category(products: DataFrame, listings: DataFrame, stores: DataFrame) -> DataFrame:
    """Products with the category of the store of their first listing (lowest id).

    The first listing is chosen before the store join, so that join sees one row
    per product.
    """
    first = listings.groupBy("product_id").agg(F.min_by("store_id", "listing_id").alias("store_id"))
    category = first.join(small_side(stores.select("store_id", "store_category")), "store_id").drop("store_id")
    return products.join(category.withColumnRenamed("store_category", "first_store_category"), "product_id", "left")


def embedding_worklist(products: DataFrame, listings: DataFrame, limit: int | None = None, by_id: bool = False):
    """Products without an embedding: most listed first, or by id."""
    todo = products.where(~F.col("has_embedding"))
    if by_id:
        ranked = todo.orderBy("product_id")
    else:
        counts = listings.groupBy("product_id").agg(F.count("listing_id").alias("listing_count"))
        ranked = (
            todo.join(counts, "product_id", "left")
            .withColumn("listing_count", F.coalesce("listing_count", F.lit(0).cast("bigint")))
            .orderBy(F.desc("listing_count"), "product_id")
        )
    return ranked.limit(limit) if limit is not None else ranked


def products_of_store(products: DataFrame, listings: DataFrame, stores: DataFrame) -> DataFrame:
    """Products listed in any of the given stores."""
    held = listings.join(small_side(stores.select("store_id")), "store_id", "left_semi")
    return products.join(held.select("product_id").distinct(), "product_id", "left_semi")


def imported_session_users(users: DataFrame, searches: DataFrame, grace: str = "5 minutes") -> DataFrame:
    """Users who had searched before ``created_at`` + grace, i.e. brought a session along.

    Some search is early enough exactly when the first one is, so a minimum per
    user replaces the range join.
    """
    first = searches.groupBy("user_id").agg(F.min("searched_at").alias("first_search"))
    bound = F.col("created_at") + F.expr(f"INTERVAL {grace}")
    return users.join(first, "user_id").where(F.col("first_search") < bound)


def searches_to_stores(searches: DataFrame, stores: DataFrame) -> DataFrame:
    """Searches whose top result is a store's name in either language, one row per (search, store).

    The OR of two equalities becomes one equality against the store's list of
    distinct names, which hashes instead of looping.
    """
    names = stores.select(
        "store_id", "store_category",
        F.explode(F.array_distinct(F.array_compact(F.array("name_he", "name_en")))).alias("top_result_name"),
    )
    return searches.join(names, "top_result_name")


def favorites_wide(favorites: DataFrame, stores: DataFrame) -> DataFrame:
    return favorites.join(stores.select("store_id", "name_he", "partner_url", "city"), "store_id")


def explode_tool_calls(traces: DataFrame) -> DataFrame:
    """One row per tool call of a trace."""
    return traces.select("*", F.inline("tool_calls")).drop("tool_calls")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not there yet."""
    return incoming.join(existing.select(key), key, "left_anti")


def repoint_listings(listings: DataFrame, mapping: DataFrame) -> DataFrame:
    """Move listings of a duplicate product to its canonical product.

    ``mapping`` has ``product_id, canonical_id``. A listing stays where it is when
    the canonical product already has the same store and URL, or when a listing
    that moves earlier takes that place. A NULL URL never collides.
    """
    target = listings.join(mapping, "product_id", "left").withColumn(
        "target_id", F.coalesce("canonical_id", "product_id")
    )
    # The place belongs to a listing already there, else to the mover with the lowest (product, listing) id.
    holder = (
        target.where("product_url IS NOT NULL")
        .groupBy("target_id", "store_id", "product_url")
        .agg(
            F.min(F.struct(F.col("canonical_id").isNotNull().alias("moves"), "product_id", "listing_id")).alias("first"),
            F.count("canonical_id").alias("movers"),
        )
        .where("movers > 0")
        .select("target_id", "store_id", "product_url", F.col("first.listing_id").alias("holder_id"))
    )
    placed = target.join(holder, ["target_id", "store_id", "product_url"], "left")
    moves = F.col("canonical_id").isNotNull() & (
        F.col("holder_id").isNull() | (F.col("holder_id") == F.col("listing_id"))
    )
    keep = [c for c in listings.columns if c != "product_id"]
    return placed.select(
        F.when(moves, F.col("canonical_id")).otherwise(F.col("product_id")).alias("product_id"),
        *keep, moves.alias("moved"),
    )


def price_changes(old: DataFrame, new: DataFrame, keys: list[str], detected_at=None) -> DataFrame:
    """Listings whose price or availability differs between two snapshots; NULL to value is a change.

    Keys compare with ``=``, so rows with a NULL key never pair up. One row per key
    and side is expected.
    """
    before = old.select(*keys, "listing_id", F.col("price").alias("old_price"),
                        F.col("availability").alias("old_availability"))
    after = new.select(*keys, F.col("price").alias("new_price"), F.col("availability").alias("new_availability"))
    changed = before.join(after, keys).where(
        ~F.col("old_price").eqNullSafe(F.col("new_price"))
        | ~F.col("old_availability").eqNullSafe(F.col("new_availability"))
    )
    return changed if detected_at is None else changed.withColumn("detected_at", detected_at)


def link_chains(stores: DataFrame, enriched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link stores to the chain named in their enrichment; make the chain's row where none exists.

    ``enriched`` has ``store_id, chain_name``. A parent is the store whose first
    name equals the chain name (lowest id). Returns (links, new_parents); a new
    parent takes over category and network of its first store.
    """
    wanted = enriched.where("chain_name IS NOT NULL AND chain_name <> ''")
    known = stores.groupBy(F.col("name_he").alias("chain_name")).agg(F.min("store_id").alias("parent_id"))
    linked = wanted.join(known, "chain_name", "left").withColumn(
        "parent_key", F.coalesce(F.col("parent_id").cast("string"), F.concat(F.lit("chain:"), F.col("chain_name")))
    )
    new_parents = (
        linked.where("parent_id IS NULL")
        .join(stores.select("store_id", "store_category"), "store_id")
        .groupBy("chain_name", "parent_key")
        .agg(F.min_by("store_category", "store_id").alias("store_category"))
        .select("parent_key", F.col("chain_name").alias("name_he"), "store_category", F.lit(False).alias("is_online"))
    )
    return linked.select("store_id", "chain_name", "parent_key"), new_parents


def eval_join(golden: DataFrame, responses: DataFrame) -> DataFrame:
    """Golden queries with their response; a missing response is an error."""
    found = golden.join(responses, "id", "left")
    return found.withColumn("error", F.when(F.col("latency_ms").isNull() & F.col("error").isNull(), "no response")
                            .otherwise(F.col("error")))
