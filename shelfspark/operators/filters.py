"""Row filters of the searches and the worklists of the clean-up jobs.

Every function takes a DataFrame and returns a DataFrame; predicates are plain
expressions, so they reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import rules
from shelfspark.functions.numbers import flat_earth_km
from shelfspark.functions.text import blank_to_null
from shelfspark.session import small_side


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def missing(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def unless_null(value: Column, test: Column) -> Column:
    return value.isNull() | F.coalesce(test, F.lit(False))


def in_city(city: Column) -> Column:
    """Whether a row's city holds the asked text; nothing asked holds everywhere."""
    return unless_null(F.nullif(city, F.lit("")), F.lower("city").contains(F.lower(city)))


def search_filters(
    df: DataFrame,
    *,
    online_only: bool | Column = False,
    city=None,
    brand=None,
    max_price=None,
    min_price=None,
    show_out_of_stock: bool | Column = True,
    lat=None,
    lng=None,
    radius_km=None,
    min_score=None,
) -> DataFrame:
    """Filters of the product search; an argument left out does not filter.

    Arguments may be constants or columns, so that one batch can hold a
    different filter per query; a NULL in such a column does not filter either.
    A missing price passes ``max_price`` and fails ``min_price``. A row without
    coordinates passes the radius with a NULL distance; the rounded distance is
    what is compared.
    """

    if online_only is not False:
        df = df.where(~F.coalesce(as_column(online_only), F.lit(False)) | F.col("is_online"))
    if city is not None:
        df = df.where(in_city(as_column(city)))
    if brand is not None:
        brand = as_column(brand)
        df = df.where(unless_null(F.nullif(brand, F.lit("")), F.lower("brand").contains(F.lower(brand))))
    if max_price is not None:
        bound = as_column(max_price)
        df = df.where(bound.isNull() | F.col("price").isNull() | (F.col("price") <= bound))
    if min_price is not None:
        bound = as_column(min_price)
        df = df.where(unless_null(bound, F.col("price") >= bound))
    if show_out_of_stock is not True:
        df = df.where(F.coalesce(as_column(show_out_of_stock), F.lit(False)) | F.col("availability"))
    if lat is not None:
        df = with_distance(df, as_column(lat), as_column(lng))
        radius = as_column(radius_km)
        df = df.where(F.col("distance_km").isNull() | radius.isNull() | (F.col("distance_km") <= radius))
    if min_score is not None:
        df = df.where(F.col("similarity") >= as_column(min_score))
    return df


def with_distance(df: DataFrame, lat: Column, lng: Column) -> DataFrame:
    return df.withColumn("distance_km", F.round(flat_earth_km(lat, lng, F.col("lat"), F.col("lng")), 2))


def list_filter(stores: DataFrame, city=None, category=None, online_only=False) -> DataFrame:
    """Filters of the plain store list: substring on city and category, any case."""
    if online_only:
        stores = stores.where("is_online")
    if city:
        stores = stores.where(F.col("city").ilike(f"%{city}%"))
    if category:
        stores = stores.where(F.col("store_category").ilike(f"%{category}%"))
    return stores


def store_filter(stores: DataFrame, *, query=None, store_type=None, city=None, hint=None, located=False) -> DataFrame:
    """Filters of the store search.

    ``store_type`` is matched without wildcards around it, ``query`` in both
    names; ``hint`` (either name or city) counts only where no city is given.
    ``located`` drops stores without coordinates.
    """
    if store_type is not None:
        stores = stores.where(F.col("store_category").ilike(store_type))
    if query:
        stores = stores.where(F.col("name_he").ilike(f"%{query}%") | F.col("name_en").ilike(f"%{query}%"))
    if city:
        stores = stores.where(F.col("city").ilike(f"%{city}%"))
    elif hint:
        stores = stores.where(
            F.col("name_he").ilike(f"%{hint}%") | F.col("name_en").ilike(f"%{hint}%") | F.col("city").ilike(f"%{hint}%")
        )
    if located:
        stores = stores.where("lat IS NOT NULL AND lng IS NOT NULL")
    return stores


def bogus_price_targets(listings: DataFrame) -> DataFrame:
    """Prices at the "on request" sentinel or not above zero."""
    return listings.where((F.col("price") == rules.PRICE_SENTINEL) | (F.col("price") <= 0))


def sibling_outliers(
    listings: DataFrame, floor: float = rules.OUTLIER_FLOOR, multiple: float = rules.OUTLIER_MULTIPLE
) -> DataFrame:
    """Prices below ``floor`` whose product is listed at ``multiple`` times as much or more elsewhere.

    The maximum is pre-aggregated map-side and only for products that have a
    cheap listing, so a product with very many listings stays cheap to judge.
    """
    cheap = listings.where((F.col("price") > 0) & (F.col("price") < floor))
    top = (
        listings.where("price > 0")
        .groupBy("product_id")
        .agg(F.max("price").alias("top_price"), F.min("price").alias("low_price"))
        .where(F.col("low_price") < floor)
        .drop("low_price")
    )
    return cheap.join(top, "product_id").where(F.col("top_price") >= F.col("price") * multiple)


def installment_targets(
    listings: DataFrame, stores: DataFrame, names: list[str], limit: float = rules.INSTALLMENT_LIMIT
) -> DataFrame:
    """Priced listings below ``limit`` in the named stores, with the store name."""
    named = stores.where(F.col("name_he").isin(names)).select("store_id", "name_he")
    return listings.where(F.col("price") < limit).join(small_side(named), "store_id")


def brand_candidates(products: DataFrame) -> DataFrame:
    return products.where(missing("brand") & F.col("canonical_name").isNotNull())


def category_candidates(products: DataFrame) -> DataFrame:
    return products.where(missing("category_path"))


def city_candidates(stores: DataFrame) -> DataFrame:
    return stores.where(missing("city") & ~missing("address"))


def geocode_worklist(
    stores: DataFrame, *, country: str, force: bool = False, store_id=None, order_by: str = "store_id", limit=None
) -> DataFrame:
    """Stores to geocode with the text to look up; one store, the missing ones, or all of them."""
    if store_id is not None:
        stores = stores.where(F.col("store_id") == store_id)
    else:
        stores = stores.where("address IS NOT NULL OR city IS NOT NULL")
        if not force:
            stores = stores.where("lat IS NULL")
    place = F.coalesce(blank_to_null(F.col("address")), blank_to_null(F.col("city")))
    stores = stores.withColumn("lookup_text", F.coalesce(F.concat(place, F.lit(f", {country}")), F.lit("")))
    return stores.orderBy(order_by).limit(limit) if limit is not None else stores


def eligible_stores(
    stores: DataFrame, statuses: list[str], *, url_column: str = "store_url", want_url: bool = True, store_id=None,
    limit=None,
) -> DataFrame:
    """Stores a scrape may take: by status and by presence (or absence) of a URL, or one store by id."""
    stores = stores.where(F.col(url_column).isNotNull() if want_url else F.col(url_column).isNull())
    if store_id is not None:
        return stores.where(F.col("store_id") == store_id)
    stores = stores.where(F.col("scrape_status").isin(statuses))
    return stores.orderBy("store_id").limit(limit) if limit is not None else stores


def user_profile_rows(users: DataFrame, cards: DataFrame, locations: DataFrame) -> DataFrame:
    """Per user the number of active cards and the default location (lowest id when there are several)."""
    active = cards.where("is_active").groupBy("user_id").agg(F.count("*").alias("active_cards"))
    default = (
        locations.where("is_default")
        .groupBy("user_id")
        .agg(F.min_by(F.struct("label", "lat", "lng"), "location_id").alias("home"))
        .select("user_id", "home.label", "home.lat", "home.lng")
    )
    return (
        users.join(active, "user_id", "left")
        .join(default, "user_id", "left")
        .withColumn("active_cards", F.coalesce("active_cards", F.lit(0)))
    )


def confident(df: DataFrame, minimum: float = 0.5, strict: bool = False) -> DataFrame:
    """Attributes sure enough: the strip asks for more than the minimum, the context for at least it."""
    gate = F.col("confidence") > minimum if strict else F.col("confidence") >= minimum
    return df.where(gate)
