"""The given tables seen as a catalogue, in SQL that Spark and DuckDB both accept."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.joins import listings_wide

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    "v_products": """
SELECT p_partkey AS product_id, p_name AS canonical_name,
       CASE WHEN p_partkey % 20 = 0 THEN NULL WHEN p_partkey % 20 = 1 THEN '' ELSE p_brand END AS brand,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS category_path,
       e.vec_id IS NOT NULL AS has_embedding
FROM part LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON e.vec_id = p_partkey""",
    "v_stores": """
SELECT s.s_suppkey AS store_id, s.s_name AS name_he,
       CASE WHEN s.s_suppkey % 2 = 0 THEN concat('Store ', n.n_name) ELSE NULL END AS name_en,
       concat('https://example.com/brands/', cast(s.s_suppkey AS varchar(20))) AS partner_url,
       CASE s.s_suppkey % 4 WHEN 0 THEN 'restaurant' WHEN 1 THEN 'retail' WHEN 2 THEN 'spa' ELSE 'other' END AS store_category,
       s.s_suppkey % 3 = 0 AS is_online,
       CASE WHEN s.s_suppkey % 6 = 0 THEN NULL ELSE n.n_name END AS city, r.r_name AS region,
       CASE WHEN s.s_suppkey % 6 = 0 THEN concat('Main St 7, ', r.r_name) ELSE NULL END AS address,
       CASE WHEN s.s_suppkey % 7 = 0 THEN NULL ELSE 29.5e0 + (s.s_suppkey % 40) * 0.1e0 END AS lat,
       CASE WHEN s.s_suppkey % 7 = 0 THEN NULL ELSE 34.3e0 + (s.s_suppkey % 15) * 0.1e0 END AS lng
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "v_listings": """
SELECT concat_ws('-', cast(l_orderkey AS varchar(20)), cast(l_linenumber AS varchar(20)),
                 cast(l_partkey AS varchar(20)), cast(l_suppkey AS varchar(20))) AS listing_id,
       l_partkey AS product_id, l_suppkey AS store_id,
       CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 101 = 0 THEN 999999e0
            WHEN l_orderkey % 103 = 0 THEN -1e0 WHEN l_orderkey % 107 = 0 THEN 1.3e0
            ELSE l_extendedprice END AS price,
       'ILS' AS currency, l_linestatus = 'O' AS availability,
       CASE WHEN l_orderkey % 50 = 0 THEN NULL
            ELSE concat('https://example.com/p/', cast(l_orderkey % 5 AS varchar(20))) END AS product_url,
       CASE WHEN l_orderkey % 100 = 3 THEN 'https://example.com/i.png' ELSE NULL END AS image_url,
       l_shipdate AS updated_at
FROM lineitem""",
    "v_listings_wide": """
SELECT sp.listing_id, sp.price, sp.currency, sp.availability, sp.product_url, p.product_id, p.canonical_name,
       p.brand AS product_brand, p.category_path, s.store_id, s.name_he, s.name_en, s.partner_url, s.is_online, s.city, s.lat, s.lng
FROM v_listings sp JOIN v_products p ON sp.product_id = p.product_id JOIN v_stores s ON sp.store_id = s.store_id""",
    "v_price_snapshots": """
SELECT product_id, store_id, listing_id, price, availability, updated_at AS scraped_at FROM v_listings""",
    "v_searches": """
SELECT e.event_id AS search_id, e.user_id,
       concat(e.event_type, ' ', cast(e.user_id % 10 AS varchar(20))) AS message, e.event_type AS intent,
       CASE WHEN e.event_id % 4 = 0 THEN NULL ELSE n.n_name END AS city_used,
       cast(floor(e.value) AS int) % 5 AS result_count, s.s_name AS top_result_name, e.ts AS searched_at
FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 25 LEFT JOIN supplier s ON s.s_suppkey = e.event_id % 150""",
    "v_users": """
SELECT user_id, CASE WHEN user_id % 3 = 0 THEN min(ts) - INTERVAL 2 MINUTE ELSE min(ts) - INTERVAL 1 DAY END AS created_at
FROM events GROUP BY user_id""",
    "v_traces": """
SELECT event_id AS trace_id, user_id, concat_ws(':', cast(user_id AS varchar(20)), cast(cast(ts AS date) AS varchar(20))) AS session_id,
       event_type AS intent,
       CASE event_type WHEN 'view' THEN 'search_products' WHEN 'click' THEN 'search_stores' WHEN 'purchase' THEN 'recall_history'
                       WHEN 'signup' THEN 'clarify' ELSE 'search_products' END AS tool_name,
       CASE WHEN event_type = 'error' THEN 'timeout' ELSE NULL END AS tool_error,
       cast(floor(value) AS int) % 5 AS result_count, value * 10 AS total_latency_ms,
       cast(round(value * 0.0001e0, 6) AS decimal(10,6)) AS total_cost_usd, ts AS created_at
FROM events""",
    "v_turns": "SELECT conv_id, turn, role, text AS content FROM conversations",
    "v_attrs": """
SELECT user_id, event_type AS attribute, max(user_id % 7) AS value,
       round(max(user_id % 11) * 0.1e0, 2) AS confidence, max(user_id % 5) = 0 AS is_confirmed
FROM events GROUP BY user_id, event_type""",
    "v_pages": "SELECT page_id, url, html FROM pages",
    # Names that may hold brands, chains and city words, one per product or store.
    "v_named_products": """
SELECT product_id,
       concat(CASE product_id % 12 WHEN 0 THEN 'Sony' WHEN 1 THEN 'my iPhone' WHEN 2 THEN 'LG' WHEN 3 THEN 'algae' WHEN 4 THEN 'fox home'
              WHEN 5 THEN 'Fisher & Paykel' WHEN 6 THEN 'Hewlett-Packard' WHEN 7 THEN 'GE dishwasher' WHEN 8 THEN 'bosch'
              WHEN 9 THEN 'KITCHENAID' WHEN 10 THEN 'mi band' ELSE 'plain' END, ' ', canonical_name) AS canonical_name,
       brand, category_path, has_embedding
FROM v_products""",
    "v_named_stores": """
SELECT store_id, concat(CASE store_id % 9 WHEN 0 THEN 'FOX ' WHEN 1 THEN 'fox home ' WHEN 2 THEN 'Castro' WHEN 3 THEN 'foxy '
              WHEN 4 THEN 'H&M ' WHEN 5 THEN 'pull & bear ' WHEN 6 THEN 'Zara ' ELSE 'Shop ' END, ' ', name_he) AS name_he,
       CASE WHEN store_id % 5 = 0 AND name_en IS NOT NULL THEN concat('cofix ', name_en) ELSE name_en END AS name_en,
       partner_url, store_category, is_online, city, region, address, lat, lng
FROM v_stores""",
    # Golden queries and their recorded responses, flat.
    "v_gold": """
SELECT event_id, concat('g', cast(event_id AS varchar(20))) AS id, event_type AS expected_intent, event_id % 5 = 0 AS expected_needs_location,
  event_id % 3 <> 0 AS expected_has_results, CASE WHEN event_id % 4 = 0 THEN concat('BRAND#', cast(event_id % 25 AS varchar(20))) END AS expected_brand,
  CASE WHEN event_id % 6 = 0 THEN concat('nation_', cast(event_id % 7 AS varchar(20))) END AS expected_city,
  CASE WHEN event_id % 5 = 1 THEN 100e0 + event_id % 50 END AS expected_max_price,
  CASE event_id % 8 WHEN 0 THEN 'F-01 x' WHEN 1 THEN 'see F-02/F-03' WHEN 2 THEN 'Sally' WHEN 3 THEN 'Edge' WHEN 4 THEN 'Help me' WHEN 5 THEN 'English'
    WHEN 6 THEN 'Clarify' ELSE '' END AS notes,
  event_id % 50 <> 7 AS answered, CASE WHEN event_id % 9 = 0 THEN 'other' ELSE event_type END AS intent, event_id % 10 = 0 AS needs_location,
  event_id % 3 AS products, event_id % 2 AS stores, concat('Brand#', cast(event_id % 24 AS varchar(20))) AS top_brand, 100e0 + event_id % 60 AS top_price,
  concat('NATION_', cast(event_id % 8 AS varchar(20))) AS top_city, CASE WHEN event_id % 11 = 0 THEN 'sorry, no results found' ELSE 'ok' END AS message,
  CASE WHEN event_id % 40 = 3 THEN 'timeout' END AS error, value * 100 AS latency_ms, event_id % 3 AS wanted_kind, event_id % 4 AS called_kind
FROM events""",
    # One query per (first word, brand) combination found in the catalogue.
    "v_queries": """
SELECT concat('q', cast(min(p_partkey) AS varchar(20))) AS query_id, p_name AS search_text,
       CASE WHEN min(p_partkey) % 4 = 1 THEN concat('NATION_', cast(min(p_partkey) % 25 AS varchar(20))) END AS city,
       CASE WHEN min(p_partkey) % 5 = 2 THEN 60000e0 END AS max_price,
       CASE WHEN min(p_partkey) % 7 = 3 THEN 5000e0 END AS min_price,
       min(p_partkey) % 3 = 0 AS online_only, min(p_partkey) % 2 = 0 AS show_out_of_stock,
       CASE WHEN min(p_partkey) % 6 = 4 THEN 31e0 END AS lat, CASE WHEN min(p_partkey) % 6 = 4 THEN 35e0 END AS lng,
       120e0 AS radius_km, min(p_partkey) AS vec_id,
       CASE WHEN min(p_partkey) % 3 = 1 THEN min(p_brand) END AS brand
FROM part GROUP BY p_name""",
}


def view_names(sql: str) -> list[str]:
    return re.findall(r"\bv_\w+", sql)


def _closure(names: list[str], views: dict[str, str]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in views and name not in ordered:
            for inner in view_names(views[name]):
                if inner != name:
                    visit(inner)
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """The statement with every view it mentions in front of it."""
    views = {**VIEWS, **(extra or {})}
    ctes = [f"{n} AS ({views[n].strip()})" for n in _closure(view_names(sql), views)]
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


class Tables:
    """Base tables and views of one test-data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if f"v_{name}" in VIEWS:
            return self.sql(f"SELECT * FROM v_{name}")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        statement = with_views(text)
        used = {n: getattr(self, n) for n in BASE if re.search(rf"\b{n}\b", statement)}
        for name, df in used.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(statement)

    @property
    def listings_wide(self) -> DataFrame:
        """The star join built by the operator; its SQL form serves the checks."""
        products = self.products.select("product_id", "canonical_name", F.col("brand").alias("product_brand"), "category_path")
        stores = self.stores.select("store_id", "name_he", "name_en", "partner_url", "is_online", "city", "lat", "lng")
        listings = self.listings.select("listing_id", "product_id", "store_id", "price", "currency", "availability", "product_url")
        return listings_wide(listings, products, stores)

    @property
    def traced(self) -> DataFrame:
        """Traces with their tool call as the stored array."""
        call = F.struct(
            F.col("tool_name").alias("name"),
            F.create_map(F.lit("city"), F.concat(F.lit("C"), F.col("user_id").cast("string"))).alias("args"),
            F.lit(5).cast("bigint").alias("duration_ms"), F.col("tool_error").alias("error"), "result_count",
        )
        return self.traces.withColumn("tool_calls", F.array(call)).drop("tool_name", "tool_error", "result_count")

    @property
    def product_vectors(self) -> DataFrame:
        """Products that have a vector: ``product_id, embedding``."""
        return self.embeddings.join(self.part.select(F.col("p_partkey").alias("vec_id")), "vec_id", "left_semi").select(
            F.col("vec_id").alias("product_id"), "embedding"
        )

    @property
    def vector_ids(self) -> Column:
        """One more than the largest vector id."""
        return self.embeddings.agg(F.max("vec_id") + 1).scalar()

    @property
    def planted_vectors(self) -> DataFrame:
        """Vectors with planted near-copies: every tenth gives two mixes with its successor, under ids above all real ones."""
        base = self.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        pairs = base.where("vec_id % 10 = 0").alias("v").join(
            base.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id"
        )
        mixed = [
            pairs.select(
                (F.col("vec_id") + copy * self.vector_ids).alias("product_id"),
                F.zip_with("embedding", "next", lambda x, y: x + F.lit(weight) * y).alias("embedding"),
            )
            for copy, weight in ((1, 0.3), (2, 0.6))
        ]
        return base.select(F.col("vec_id").alias("product_id"), "embedding").unionAll(mixed[0]).unionAll(mixed[1])
