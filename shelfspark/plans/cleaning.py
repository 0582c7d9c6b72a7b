"""Clean-up jobs: prices, brands, categories, cities, chains, taxonomy.

Each job returns the changed table and what it changed, so that every change can be
taken back (``operators.quarantine``). Nothing is overwritten by a back-fill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import rules
from shelfspark.functions.records import merged_name, top_level
from shelfspark.functions.text import (
    city_from_address, classify_category, detect_brand, detect_brand_longest, detect_chain,
)
from shelfspark.operators.filters import (
    bogus_price_targets, brand_candidates, category_candidates, city_candidates, installment_targets, sibling_outliers,
)
from shelfspark.operators.joins import first_store_category, products_of_store
from shelfspark.operators.quarantine import backfill, quarantine


def price_cleanup(
    listings: DataFrame, stores: DataFrame | None = None, installment_stores: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Clear bogus prices, then sibling outliers, then installment prices of the named stores.

    Returns (clean, saved); ``saved`` has ``listing_id, original, reason``.
    """
    clean, saved = quarantine(listings, bogus_price_targets(listings), "listing_id", "price")
    saved = saved.withColumn("reason", F.lit("bogus"))
    after, outliers = quarantine(clean, sibling_outliers(clean), "listing_id", "price")
    saved = saved.unionByName(outliers.withColumn("reason", F.lit("outlier")))
    if installment_stores:
        targets = installment_targets(after, stores, installment_stores)
        after, cheap = quarantine(after, targets, "listing_id", "price")
        saved = saved.unionByName(cheap.withColumn("reason", F.lit("installment")))
    return after, saved


def category_assignments(products: DataFrame, listings: DataFrame, stores: DataFrame) -> DataFrame:
    """``product_id, value`` for products whose missing category can be told."""
    todo = first_store_category(category_candidates(products), listings, stores)
    value = classify_category(F.col("canonical_name"), F.col("first_store_category"))
    return todo.select("product_id", value.alias("value")).where("value IS NOT NULL")


def category_backfill(products: DataFrame, listings: DataFrame, stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    assigned = category_assignments(products, listings, stores)
    return backfill(products, assigned, "product_id", "category_path"), assigned


def brand_assignments(products: DataFrame) -> DataFrame:
    return (
        brand_candidates(products)
        .select("product_id", detect_brand(F.col("canonical_name")).alias("value"))
        .where("value IS NOT NULL")
    )


def brand_backfill(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    assigned = brand_assignments(products)
    return backfill(products, assigned, "product_id", "brand"), assigned


def store_brand_assignments(
    products: DataFrame, listings: DataFrame, stores: DataFrame, name_patterns: list[str], brands: list[str] | None = None
) -> DataFrame:
    """Literal brands for the brandless (NULL) products of stores whose name matches a pattern."""
    hit = F.lit(False)
    for pattern in name_patterns:
        hit = hit | F.coalesce(F.col("name_he").ilike(pattern), F.lit(False))
        hit = hit | F.coalesce(F.col("name_en").ilike(pattern), F.lit(False))
    todo = products_of_store(products.where("brand IS NULL"), listings, stores.where(hit))
    value = detect_brand_longest(F.col("canonical_name"), brands)
    return todo.select("product_id", value.alias("value")).where("value IS NOT NULL")


def city_backfill(stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    assigned = (
        city_candidates(stores)
        .select("store_id", city_from_address(F.col("address")).alias("value"))
        .where("value IS NOT NULL")
    )
    return backfill(stores, assigned, "store_id", "city"), assigned


def chain_links(stores: DataFrame) -> DataFrame:
    """``store_id, chain, parent_id``: the lowest store id of a chain is its parent; the parent itself has none."""
    named = stores.select("store_id", detect_chain(F.col("name_he"), F.col("name_en")).alias("chain")).where(
        "chain IS NOT NULL"
    )
    parents = named.groupBy("chain").agg(F.min("store_id").alias("first_id"))
    return named.join(parents, "chain").select(
        "store_id", "chain", F.when(F.col("store_id") != F.col("first_id"), F.col("first_id")).alias("parent_id")
    )


def chain_linking(stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stores with ``parent_chain_id``, changed links). Stores that point to the right parent are left alone."""
    if "parent_chain_id" not in stores.columns:
        stores = stores.withColumn("parent_chain_id", F.lit(None).cast(stores.schema["store_id"].dataType))
    links = chain_links(stores).where("parent_id IS NOT NULL")
    changed = links.join(stores.select("store_id", "parent_chain_id"), "store_id").where(
        "NOT (parent_chain_id <=> parent_id)"
    )
    linked = (
        stores.join(links.select("store_id", "parent_id"), "store_id", "left")
        .withColumn("parent_chain_id", F.coalesce("parent_id", "parent_chain_id"))
        .drop("parent_id")
    )
    return linked, changed.select("store_id", "chain", "parent_id")


def label_distribution(assigned: DataFrame, label: str = "value") -> DataFrame:
    return assigned.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def taxonomy_check(classified: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Keep a path that is in the taxonomy, else the default path; add the top level.

    ``taxonomy`` is a parameter: one ``category_path`` per row.
    """
    known = taxonomy.select("category_path", F.lit(True).alias("_known")).distinct()
    path = F.when(F.col("_known"), F.col("category_path")).otherwise(F.lit(rules.DEFAULT_CATEGORY_PATH))
    return (
        classified.join(known, "category_path", "left")
        .withColumn("category_path", path)
        .withColumn("top_level_category", top_level(F.col("category_path")))
        .select(*classified.columns, "top_level_category")
    )


def normalize_products(products: DataFrame, extractor, taxonomy: DataFrame | None = None) -> DataFrame:
    """Run a normaliser hook and merge its parts.

    ``extractor`` is a column function or pandas UDF ``(name) -> struct<name_brand,
    name_model, spec_brand, spec_model, category_path>`` that gives NULL parts on failure. The
    name part wins, the specification part fills the gaps.
    """
    rows = products.withColumn("_x", extractor(F.col("canonical_name")))
    merged = rows.select(
        "product_id", "canonical_name",
        merged_name(F.col("_x.name_brand"), F.col("_x.spec_brand")).alias("brand"),
        merged_name(F.col("_x.name_model"), F.col("_x.spec_model")).alias("model"),
        F.col("_x.category_path").alias("category_path"),
    )
    return taxonomy_check(merged, taxonomy) if taxonomy is not None else merged


def rule_extractor(name):
    """Default normaliser: brand rules for both parts and keyword categories, no model."""
    none = F.lit(None).cast("string")
    return F.struct(
        detect_brand(name).alias("name_brand"), none.alias("name_model"),
        detect_brand_longest(name).alias("spec_brand"), none.alias("spec_model"),
        classify_category(name, none).alias("category_path"),
    )
