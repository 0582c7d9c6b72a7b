"""Data-quality audits of the catalogue and the gate over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import rules
from shelfspark.operators.percentiles import exact_percentiles
from shelfspark.plans.traffic import _as_of


def _pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(F.lit(0.0))


def _gap(column: str) -> Column:
    return F.count_if(F.coalesce(F.col(column), F.lit("")) == "")


def catalog_health(products: DataFrame, stores: DataFrame) -> DataFrame:
    """Totals, embedded and geocoded counts, embedding coverage."""
    p = products.agg(F.count("*").alias("products_total"), F.count_if("has_embedding").alias("products_embedded"))
    return p.withColumn("stores_total", stores.agg(F.count("*")).scalar()).withColumn(
        "stores_geocoded", stores.agg(F.count("lat")).scalar()
    ).withColumn("embedding_coverage_pct", _pct(F.col("products_embedded"), F.col("products_total"), 1))


def last_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def listing_counts(listings: DataFrame, by: str) -> DataFrame:
    return listings.groupBy(by).agg(F.count("*").alias("listing_count"))


def price_quality_audit(listings: DataFrame, gate_pct: float = 0.5) -> DataFrame:
    """One pass over the prices; suspects are non-positive, sentinel, 100k and above, or below ten."""
    price = F.col("price")
    bad = F.count_if(price <= 0)
    sentinel = F.count_if(price == rules.PRICE_SENTINEL)
    high = F.count_if((price >= 100_000) & (price != rules.PRICE_SENTINEL))
    low = F.count_if((price > 0) & (price < 10))
    suspect = F.count_if((price <= 0) | (price >= 100_000) | (price < 10))
    return (
        listings.agg(
            F.count("*").alias("rows"),
            F.count_if(price.isNull()).alias("null_price"),
            bad.alias("non_positive"),
            sentinel.alias("sentinel"),
            high.alias("very_high"),
            low.alias("below_ten"),
            F.min(F.when(price > 0, price)).alias("min_positive"),
            F.max(price).alias("max_price"),
            F.round(F.avg(F.when(price > 0, price)), 2).alias("avg_positive"),
            suspect.alias("suspect"),
        )
        .withColumn("suspect_pct", _pct(F.col("suspect"), F.col("rows")))
        .withColumn("passed", F.col("suspect_pct") < gate_pct)
    )


def null_rate_audit(products: DataFrame) -> DataFrame:
    """Missing categories and brands of the catalogue, and how many category values there are."""
    return products.agg(
        F.count("*").alias("products"),
        _gap("category_path").alias("missing_category"),
        _gap("brand").alias("missing_brand"),
        F.count_distinct(F.nullif("category_path", F.lit(""))).alias("category_values"),
    ).withColumn("missing_category_pct", _pct(F.col("missing_category"), F.col("products"))).withColumn(
        "missing_brand_pct", _pct(F.col("missing_brand"), F.col("products"))
    )


def null_rate_by_store(listings: DataFrame, products: DataFrame) -> DataFrame:
    """Per store: distinct products and how many lack a category or a brand, and listings without image."""
    images = listings.groupBy("store_id").agg(F.count("*").alias("listings"), _gap("image_url").alias("missing_image"))
    held = listings.select("store_id", "product_id").distinct().join(products, "product_id")
    gaps = held.groupBy("store_id").agg(
        F.count("*").alias("products"), _gap("category_path").alias("missing_category"), _gap("brand").alias("missing_brand")
    )
    return gaps.join(images, "store_id")


def city_gaps(stores: DataFrame) -> DataFrame:
    return stores.agg(F.count("*").alias("stores"), _gap("city").alias("missing_city")).withColumn(
        "missing_city_pct", _pct(F.col("missing_city"), F.col("stores"))
    )


def staleness_audit(
    listings: DataFrame, as_of=None, by: list[str] | None = None, stale_days: int = 30, gate_days: float = 14.0
) -> DataFrame:
    """Median age in days since the last update and the share older than 30 days."""
    now = _as_of(listings, "updated_at", as_of)
    aged = listings.select(*(by or []), F.datediff(now, F.col("updated_at")).alias("age_days"))
    middle = exact_percentiles(aged, by or [], "age_days", {"median_age_days": 0.5}).drop("n")
    counts = aged.groupBy(*(by or [])).agg(
        F.count("*").alias("listings"), F.count_if(F.col("age_days") > stale_days).alias("stale")
    )
    if by:
        joined = counts.join(middle, by)
    else:
        joined = counts.withColumn("median_age_days", middle.select("median_age_days").scalar())
    return joined.withColumn("stale_pct", _pct(F.col("stale"), F.col("listings"))).withColumn(
        "passed", F.col("median_age_days") <= gate_days
    )


def quality_gate(listings: DataFrame, products: DataFrame, stores: DataFrame, duplicates: DataFrame | None = None,
                 as_of=None) -> DataFrame:
    """``check, value, target, passed`` over the audits; the duplicate share needs the groups of a dedup run."""
    price = price_quality_audit(listings).select(F.col("suspect_pct")).scalar()
    age = staleness_audit(listings, as_of).select("median_age_days").scalar()
    image = listings.agg(_pct(F.count(F.nullif("image_url", F.lit(""))), F.count("*"))).scalar()
    brand = products.agg(_pct(_gap("brand"), F.count("*")))
    table = brand.toDF("brand").withColumn("price", price).withColumn("age", age).withColumn("image", image)
    checks = [("suspect_price_pct", "price", 0.5, "<"), ("median_age_days", "age", 14.0, "<="),
              ("missing_brand_pct", "brand", 3.0, "<"), ("image_pct", "image", 60.0, ">")]
    if duplicates is not None:
        table = table.withColumn("dup", duplicates.select("duplicate_pct").scalar())
        checks.append(("duplicate_pct", "dup", 2.0, "<"))
    rows = []
    for name, column, target, sign in checks:
        value = F.col(column).cast("double")
        passed = {"<": value < target, "<=": value <= target, ">": value > target}[sign]
        rows.append(F.struct(F.lit(name).alias("check"), value.alias("value"), F.lit(target).alias("target"),
                             passed.alias("passed")))
    return table.select(F.inline(F.array(*rows)))
