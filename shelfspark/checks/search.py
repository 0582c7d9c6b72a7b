"""Product and store searches, their filters, ranks and joins."""

from pyspark.sql import functions as F

from shelfspark.checks.registry import check
from shelfspark.functions import text
from shelfspark.functions.text import blank_to_null
from shelfspark.operators import filters, joins, patterns, ranking, vectors
from shelfspark.plans import product_search as ps
from shelfspark.plans import store_search as ss

KM = "sqrt(pow(({qlat} - {lat}) * 111.0, 2) + pow(({qlng} - {lng}) * 111.0 * cos(radians({qlat})), 2))"


def wide(t):
    return t.listings_wide.withColumnRenamed("product_brand", "brand")


def queries(t):
    return t.sql("SELECT * FROM v_queries").join(t.embeddings.select("vec_id", "embedding"), "vec_id", "left")


def items(t):
    return t.product_vectors


# ---- filters -------------------------------------------------------------


@check("f01_filter_online", "SELECT listing_id FROM v_listings_wide WHERE is_online")
def _(t):
    return filters.search_filters(wide(t), online_only=True).select("listing_id")


@check("f02_filter_city", "SELECT listing_id, city FROM v_listings_wide WHERE contains(lower(city), 'nation_1')")
def _(t):
    return filters.search_filters(wide(t), city="Nation_1").select("listing_id", "city")


@check("f03_filter_brand", "SELECT listing_id, product_brand AS brand FROM v_listings_wide WHERE contains(lower(product_brand), 'brand#1')")
def _(t):
    return filters.search_filters(wide(t), brand="BRAND#1").select("listing_id", "brand")


@check("f04_filter_max_price", "SELECT listing_id, price FROM v_listings_wide WHERE price IS NULL OR price <= 9000.5")
def _(t):
    return filters.search_filters(wide(t), max_price=9000.5).select("listing_id", "price")


@check("f05_filter_min_price", "SELECT listing_id, price FROM v_listings_wide WHERE price >= 90000")
def _(t):
    return filters.search_filters(wide(t), min_price=90000.0).select("listing_id", "price")


@check("f06_filter_in_stock", "SELECT listing_id FROM v_listings_wide WHERE availability")
def _(t):
    return filters.search_filters(wide(t), show_out_of_stock=False).select("listing_id")


DIST = KM.format(qlat="31.0", qlng="35.0", lat="lat", lng="lng")


@check("f07_filter_radius", f"""
SELECT listing_id, round({DIST}, 2) AS distance_km FROM v_listings_wide WHERE lat IS NULL OR round({DIST}, 2) <= 60""")
def _(t):
    return filters.search_filters(wide(t), lat=31.0, lng=35.0, radius_km=60.0).select("listing_id", "distance_km")


SCORE = """
least(0.9::DOUBLE, 0.4::DOUBLE + (len(list_intersect(['small', 'brand#1', 'ring'], list_concat(string_split(lower(canonical_name), ' '),
  [lower(coalesce({brand}, ''))])))::DOUBLE / 3) * 0.5::DOUBLE)"""


@check("f08_filter_min_score", f"""
SELECT listing_id, round({SCORE.format(brand='product_brand')}, 6) AS similarity FROM v_listings_wide WHERE {SCORE.format(brand='product_brand')} >= 0.7""")
def _(t):
    scored = wide(t).withColumn("similarity", text.word_overlap(F.lit(" Small ring  BRAND#1 "), F.col("canonical_name"), F.col("brand")))
    return filters.search_filters(scored, min_score=0.7).select("listing_id", F.round("similarity", 6).alias("similarity"))


@check("f09_store_list_filter", """
SELECT store_id FROM v_stores WHERE is_online AND city ILIKE '%ation_1%' AND store_category ILIKE '%RE%'""")
def _(t):
    return filters.list_filter(t.stores, city="ation_1", category="RE", online_only=True).select("store_id")


@check("f10_store_search_filter", """
SELECT store_id FROM v_stores WHERE (name_he ILIKE '%nation_2%' OR name_en ILIKE '%nation_2%') AND store_category ILIKE 'SPA' AND lat IS NOT NULL AND lng IS NOT NULL""")
def _(t):
    return filters.store_filter(t.stores, query="nation_2", store_type="SPA", located=True).select("store_id")


@check("f11_location_hint_filter", """
SELECT store_id FROM v_stores WHERE name_he ILIKE '%_3%' OR name_en ILIKE '%_3%' OR city ILIKE '%_3%'""")
def _(t):
    return filters.store_filter(t.stores, hint="_3").select("store_id")


@check("f20_active_cards_default_location", """
SELECT u.user_id, count(*) FILTER (WHERE e.event_id % 3 = 0) AS active_cards,
  arg_min(e.event_type, e.event_id) FILTER (WHERE e.event_id % 10 = 0) AS label
FROM v_users u LEFT JOIN events e ON e.user_id = u.user_id GROUP BY u.user_id""")
def _(t):
    cards = t.events.select("user_id", (F.col("event_id") % 3 == 0).alias("is_active"))
    places = t.events.select(
        "user_id", F.col("event_id").alias("location_id"), F.col("event_type").alias("label"), F.lit(32.0).alias("lat"),
        F.lit(34.0).alias("lng"), (F.col("event_id") % 10 == 0).alias("is_default"),
    )
    return filters.user_profile_rows(t.users, cards, places).select("user_id", "active_cards", "label")


@check("f21_confidence_gate", """
SELECT user_id, attribute, confidence > 0.5 AS on_strip FROM v_attrs WHERE confidence >= 0.5""")
def _(t):
    kept = filters.confident(t.attrs, 0.5)
    strict = filters.confident(t.attrs, 0.5, strict=True).select("user_id", "attribute", F.lit(True).alias("s"))
    return kept.join(strict, ["user_id", "attribute"], "left").select(
        "user_id", "attribute", F.coalesce("s", F.lit(False)).alias("on_strip")
    )


# ---- joins and ranks -------------------------------------------------------


@check("j01_listing_star_join", """
SELECT store_category, is_online, count(*) AS n, round(sum(CASE WHEN price < 999999 THEN price END), 2) AS total
FROM v_listings l JOIN v_products p ON l.product_id = p.product_id JOIN v_stores s ON l.store_id = s.store_id GROUP BY 1, 2""")
def _(t):
    rows = joins.listings_wide(t.listings, t.products, t.stores)
    return rows.groupBy("store_category", "is_online").agg(
        F.count("*").alias("n"), F.round(F.sum(F.when(F.col("price") < 999999, F.col("price"))), 2).alias("total")
    )


@check("j02_store_counts_left_join", """
SELECT s.store_id, count(l.listing_id) AS product_count FROM v_stores s LEFT JOIN v_listings l ON l.store_id = s.store_id GROUP BY s.store_id""")
def _(t):
    return joins.stores_with_counts(t.stores, t.listings).select("store_id", "product_count")


@check("j09_favorites_join", """
SELECT e.user_id, s.store_id, s.name_he, s.city FROM (SELECT DISTINCT user_id, event_id % 150 AS store_id FROM events WHERE event_type = 'purchase') e
JOIN v_stores s ON s.store_id = e.store_id""")
def _(t):
    favorites = t.events.where("event_type = 'purchase'").select("user_id", (F.col("event_id") % 150).alias("store_id")).distinct()
    return joins.favorites_wide(favorites, t.stores).select("user_id", "store_id", "name_he", "city")


@check("w01_one_per_product_store", """
SELECT product_id, store_id, min(listing_id) AS listing_id FROM v_listings GROUP BY 1, 2""")
def _(t):
    return ranking.one_per_product_store(t.listings).select("product_id", "store_id", "listing_id")


@check("w07_keep_first_dedup", """
SELECT city, store_id FROM (SELECT city, store_id, row_number() OVER (PARTITION BY city ORDER BY store_id) AS rn FROM v_stores) WHERE rn = 1""")
def _(t):
    return ranking.keep_first(t.stores.select("city", "store_id"), ["city"], "store_id")


@check("u03_capped_accumulate", """
WITH f AS (SELECT user_id, top_result_name AS item, min(search_id) AS pos FROM v_searches WHERE top_result_name IS NOT NULL GROUP BY 1, 2)
SELECT user_id, item, pos FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rn FROM f) WHERE rn <= 20""")
def _(t):
    rows = t.searches.where("top_result_name IS NOT NULL").select("user_id", F.col("top_result_name").alias("item"), F.col("search_id").alias("pos"))
    return ranking.keep_first(rows, ["item"], "pos", cap=20, group=["user_id"])


@check("u04_recent_items_merge", """
WITH a AS (SELECT user_id AS owner, 'store' AS item_type, top_result_name AS item_id, search_id AS p, search_id % 1000 AS added,
             CASE WHEN search_id % 2 = 0 THEN 0 ELSE 1 END AS new FROM v_searches WHERE top_result_name IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY owner, item_type, item_id ORDER BY new, p) AS first FROM a)
SELECT owner, item_id, added_at, rank FROM (SELECT owner, item_id, added AS added_at, row_number() OVER (PARTITION BY owner ORDER BY added DESC, new, p) AS rank
FROM k WHERE first = 1) WHERE rank <= 20""")
def _(t):
    rows = t.searches.where("top_result_name IS NOT NULL").select(
        F.col("user_id").alias("owner"), F.lit("store").alias("item_type"), F.col("top_result_name").alias("item_id"),
        (F.col("search_id") % 1000).alias("added_at"), F.col("search_id").alias("position"),
    )
    merged = ranking.merge_recent(rows.where("position % 2 = 0"), rows.where("position % 2 = 1"))
    return merged.select("owner", "item_id", "added_at", "rank")


@check("t01_paginate", """
SELECT listing_id, price FROM v_listings WHERE price < 999999 ORDER BY price DESC, listing_id LIMIT 20 OFFSET 40""")
def _(t):
    rows = t.listings.where("price < 999999").select("listing_id", "price")
    return ranking.paginate(rows, [F.desc("price"), F.col("listing_id")], page=3, page_size=20)


@check("t03_instock_first", """
SELECT query_id, listing_id, row_number() OVER (PARTITION BY query_id ORDER BY availability DESC, price DESC, product_id, store_id, listing_id) AS rank
FROM (SELECT canonical_name AS query_id, *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY listing_id) AS rn FROM v_listings_wide WHERE price < 999999) WHERE rn = 1""")
def _(t):
    # Only what is ranked and shown is moved.
    needed = wide(t).where("price < 999999").select("product_id", "store_id", "listing_id", "availability", "price", F.col("canonical_name").alias("query_id"))
    return ss.instock_first(ranking.one_per_product_store(needed), score="price").select("query_id", "listing_id", "rank")


RANKED = """
SELECT 'q' || cast(product_id % 17 AS varchar) AS query_id, product_id, {brand} AS brand, product_id % 4 = 0 AS is_online,
  row_number() OVER (PARTITION BY product_id % 17 ORDER BY product_id) AS rank FROM v_products"""


def ranked_products(t):
    rows = t.products.select(
        F.concat(F.lit("q"), (F.col("product_id") % 17).cast("string")).alias("query_id"), "product_id", "brand",
        (F.col("product_id") % 4 == 0).alias("is_online"),
    )
    return ranking.rank_within(rows, ["query_id"], [F.col("product_id")])


@check("t04_brand_tier_rerank", f"""
WITH r AS ({RANKED.format(brand='brand')}), s AS (SELECT *, CASE WHEN coalesce(brand, '') = '' THEN 2 WHEN contains(lower(brand), 'brand#1') THEN 0 ELSE 1 END AS tier FROM r)
SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank) AS rank FROM s""")
def _(t):
    return ranking.rerank_by_brand(ranked_products(t), F.lit(" BRAND#1 ")).select("query_id", "product_id", "rank")


@check("t05_distance_or_count_sort", f"""
WITH c AS (SELECT s.*, (SELECT count(*) FROM v_listings l WHERE l.store_id = s.store_id) AS n FROM v_stores s)
SELECT 'near' AS kind, store_id, rank FROM (SELECT store_id, row_number() OVER (ORDER BY round({DIST}, 2), store_id) AS rank FROM c
  WHERE lat IS NOT NULL AND {DIST} <= 200) WHERE rank <= 10
UNION ALL SELECT 'count', store_id, rank FROM (SELECT store_id, row_number() OVER (ORDER BY n DESC, store_id) AS rank FROM c) WHERE rank <= 10""")
def _(t):
    near = ss.store_search(t.stores, t.listings, lat=31.0, lng=35.0, radius_km=200.0, page_size=10)
    most = ss.store_search(t.stores, t.listings, page_size=10)
    a = ranking.rank_within(near.withColumn("kind", F.lit("near")), ["kind"], [F.col("distance_km"), F.col("store_id")])
    b = ranking.rank_within(most.withColumn("kind", F.lit("count")), ["kind"], [F.desc("product_count"), F.col("store_id")])
    return a.select("kind", "store_id", "rank").unionByName(b.select("kind", "store_id", "rank"))


@check("t06_candidate_cap", """
SELECT query_id, listing_id, rank FROM (SELECT canonical_name AS query_id, listing_id, row_number() OVER (PARTITION BY canonical_name ORDER BY listing_id) AS rank
FROM v_listings_wide WHERE availability) WHERE rank <= 200""")
def _(t):
    rows = filters.search_filters(wide(t), show_out_of_stock=False).select(F.col("canonical_name").alias("query_id"), "listing_id")
    return ranking.top_n(rows, ["query_id"], [F.col("listing_id")], ps.RESULT_CAP)


@check("t08_online_then_limit", f"""
WITH r AS ({RANKED.format(brand='brand')})
SELECT query_id, product_id, rank FROM (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r WHERE is_online) WHERE rank <= 5""")
def _(t):
    return ranking.online_then_limit(ranked_products(t), F.lit(True), F.lit(5)).select("query_id", "product_id", "rank")


@check("t02_vector_topk", """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.query_id, v.product_id, round(list_cosine_similarity(q.e, v.e), 9) AS sim FROM q, v_vectors v)
SELECT query_id, product_id, round(sim, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, product_id) AS rank
FROM s WHERE sim >= 0.1) WHERE rank <= 10""")
def _(t):
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.top_k_similar(asked, items(t).select(F.col("product_id").alias("item_id"), "embedding"), 10, 0.1)
    return found.select("query_id", F.col("item_id").alias("product_id"), F.round("similarity", 6).alias("similarity"), "rank")


# ---- the searches ------------------------------------------------------------

CORE = """
q AS (SELECT *, {text} AS txt FROM v_queries {where}),
qw AS (SELECT *, list_distinct(string_split(lower(txt), ' ')) AS words, string_split(txt, ' ')[1] AS w1, string_split(txt, ' ')[2] AS w2 FROM q),
pairs AS (SELECT product_id, store_id, min(listing_id) AS listing_id FROM v_listings GROUP BY 1, 2),
prod AS (SELECT qw.query_id, p.product_id, least(0.9::DOUBLE, 0.4::DOUBLE + (len(list_intersect(words,
     list_concat(string_split(lower(p.canonical_name), ' '), [lower(coalesce(p.brand, ''))])))::DOUBLE / len(words)) * 0.5::DOUBLE) AS sim
  FROM qw JOIN v_products p ON p.canonical_name ILIKE '%' || txt || '%' OR p.brand ILIKE '%' || txt || '%'
     OR p.canonical_name ILIKE '%' || w1 || '%' OR p.canonical_name ILIKE '%' || w2 || '%'),
kw AS (SELECT * FROM (SELECT prod.query_id, pairs.*, sim, row_number() OVER (PARTITION BY query_id ORDER BY product_id, store_id) AS rn
  FROM prod JOIN pairs USING (product_id)) WHERE {cap}),
vq AS (SELECT query_id, e.embedding::DOUBLE[] AS e FROM q JOIN embeddings e ON e.vec_id = q.vec_id),
vec AS (SELECT * FROM (SELECT vq.query_id, pairs.*, round(list_cosine_similarity(vq.e, v.e), 9) AS sim,
   row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(vq.e, v.e), 9) DESC, product_id, store_id) AS rn
  FROM vq, v_vectors v JOIN pairs USING (product_id)) WHERE {near}),
tiers AS (SELECT query_id, product_id, store_id, listing_id, sim, CASE WHEN sim > 0.4 THEN 1 ELSE 3 END AS tier FROM kw
  {vector_union}),
merged AS (SELECT query_id, tier, sim, w.* FROM (SELECT *, row_number() OVER (PARTITION BY query_id, product_id, store_id ORDER BY tier) AS first FROM tiers) t
  JOIN v_listings_wide w ON w.listing_id = t.listing_id WHERE first = 1)"""
VECTOR_UNION = "UNION ALL SELECT query_id, product_id, store_id, listing_id, sim, CASE WHEN sim > 0.5 THEN 2 ELSE 4 END FROM vec"
QDIST = "round(" + KM.format(qlat="q.lat", qlng="q.lng", lat="m.lat", lng="m.lng") + ", 2)"
FILTERED = f"""
fin AS (SELECT m.*, {QDIST} AS distance_km, row_number() OVER (PARTITION BY m.query_id ORDER BY sim DESC, tier, product_id, store_id) AS rank
  FROM merged m JOIN q ON q.query_id = m.query_id
  WHERE (NOT q.online_only OR m.is_online) AND (q.city IS NULL OR contains(lower(m.city), lower(q.city)))
    AND (q.brand IS NULL OR contains(lower(m.product_brand), lower(q.brand)))
    AND (q.max_price IS NULL OR m.price IS NULL OR m.price <= q.max_price) AND (q.min_price IS NULL OR m.price >= q.min_price)
    AND (q.show_out_of_stock OR m.availability) AND (q.lat IS NULL OR m.lat IS NULL OR {QDIST} <= q.radius_km) AND sim >= 0.3)"""


def core(text="search_text", cap=None, vector=True, where=""):
    rows = {"cap": "true", "near": "sim >= 0.3"} if cap is None else {"cap": f"rn <= {cap}", "near": f"rn <= {cap}"}
    return "WITH " + CORE.format(text=text, where=where, vector_union=VECTOR_UNION if vector else "", **rows)


SHOWN = ["query_id", "rank", "product_id", "store_id", "price", "distance_km", "match_score"]
SHOWN_SQL = "query_id, rank, product_id, store_id, price, distance_km, round(sim, 3) AS match_score"


@check("c01_hybrid_product_search", f"{core()}, {FILTERED} SELECT {SHOWN_SQL} FROM fin WHERE rank <= 20")
def _(t):
    return ps.hybrid_product_search(queries(t), t.listings, t.products, t.stores, items(t)).select(*SHOWN)


@check("c01_search_uncapped_candidates", f"{core()}, {FILTERED} SELECT {SHOWN_SQL} FROM fin WHERE rank <= 20")
def _(t):
    return ps.hybrid_product_search(queries(t), t.listings, t.products, t.stores, items(t), candidate_cap=None).select(*SHOWN)


@check("c01_search_capped", f"{core(cap=400)}, {FILTERED} SELECT {SHOWN_SQL} FROM fin WHERE rank <= 20")
def _(t):
    found = ps.hybrid_product_search(queries(t), t.listings, t.products, t.stores, items(t), ps.CANDIDATE_CAP, ps.RESULT_CAP)
    return found.select(*SHOWN)


# One listing for each product, so a cap counts products in both branches.
@check("c01_search_capped_1000", f"""{core(cap=1000).replace("FROM v_listings GROUP BY 1, 2", "FROM (SELECT * FROM v_listings WHERE listing_id IN (SELECT min(listing_id) FROM v_listings GROUP BY product_id)) GROUP BY 1, 2")}, {FILTERED}
SELECT {SHOWN_SQL} FROM fin WHERE rank <= 20""")
def _(t):
    single = t.listings.groupBy("product_id").agg(F.min("listing_id").alias("listing_id")).select("listing_id")
    listings = t.listings.join(single, "listing_id", "left_semi")
    return ps.hybrid_product_search(queries(t), listings, t.products, t.stores, items(t), 1000).select(*SHOWN)


@check("c01_keyword_search", f"{core(vector=False)}, {FILTERED} SELECT {SHOWN_SQL} FROM fin WHERE rank > 20 AND rank <= 40")
def _(t):
    asked = queries(t).withColumn("page", F.lit(2))
    return ps.hybrid_product_search(asked, t.listings, t.products, t.stores).select(*SHOWN)


@check("c01_search_totals", f"""{core()}, {FILTERED}
SELECT q.query_id, count(rank) FILTER (WHERE rank <= 20) AS total, count(rank) AS total_available,
  count(rank) FILTER (WHERE rank <= 20 AND round(sim, 3) >= 0.9) AS exact_matches, count(rank) FILTER (WHERE rank <= 20 AND round(sim, 3) < 0.9) AS similar_matches
FROM q LEFT JOIN fin f ON f.query_id = q.query_id GROUP BY q.query_id""")
def _(t):
    asked = queries(t)
    return ps.search_totals(asked, ps.filtered_results(asked, t.listings, t.products, t.stores, items(t)))


@check("u01_tiered_merge", f"{core()} SELECT query_id, product_id, store_id, tier, round(sim, 6) AS similarity FROM merged")
def _(t):
    asked = queries(t)
    merged = ps.search_rows(asked, t.listings, t.products, items(t))
    return merged.select("query_id", "product_id", "store_id", "tier", F.round("similarity", 6).alias("similarity"))


@check("u01_tiered_merge_capped", f"{core(cap=400)} SELECT query_id, product_id, store_id, tier, round(sim, 6) AS similarity FROM merged")
def _(t):
    merged = ps.search_rows(queries(t), t.listings, t.products, items(t), ps.CANDIDATE_CAP)
    return merged.select("query_id", "product_id", "store_id", "tier", F.round("similarity", 6).alias("similarity"))


CHAT = f"""
ok AS (SELECT m.*, {QDIST} AS distance_km, coalesce(q.city IS NULL OR contains(lower(m.city), lower(q.city)), false) AS in_city FROM merged m JOIN q ON q.query_id = m.query_id
  WHERE (q.max_price IS NULL OR m.price IS NULL OR m.price <= q.max_price) AND (q.lat IS NULL OR m.lat IS NULL OR {QDIST} <= 10)),
kept AS (SELECT * FROM ok o WHERE in_city OR ({{retry}} AND NOT EXISTS (SELECT 1 FROM ok i WHERE i.query_id = o.query_id AND i.in_city))),
fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY availability DESC, sim DESC, tier, product_id, store_id) AS rank FROM kept)"""


@check("c02_chat_product_search", f"{core()}, {CHAT.format(retry='true')} SELECT {SHOWN_SQL} FROM fin WHERE rank <= 10")
def _(t):
    return ps.chat_product_search(queries(t), t.listings, t.products, t.stores, items(t)).select(*SHOWN)


@check("c02_chat_capped", f"{core(cap=400)}, {CHAT.format(retry='true')} SELECT {SHOWN_SQL} FROM fin WHERE rank <= 10")
def _(t):
    return ps.chat_product_search(queries(t), t.listings, t.products, t.stores, items(t), ps.CANDIDATE_CAP).select(*SHOWN)


@check("c05_brand_aware_search", f"""
{core(text="CASE WHEN brand IS NULL THEN search_text ELSE brand || ' ' || search_text END")}, {CHAT.format(retry='false').replace('WHERE (q.max_price', 'WHERE (NOT q.online_only OR m.is_online) AND (q.max_price')},
tiered AS (SELECT f.*, q.online_only AS qo, CASE WHEN q.brand IS NULL THEN 0 WHEN coalesce(f.product_brand, '') = '' THEN 2
    WHEN contains(lower(f.product_brand), lower(q.brand)) THEN 0 ELSE 1 END AS bt FROM fin f JOIN q ON q.query_id = f.query_id WHERE rank <= 10)
SELECT query_id, product_id, store_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bt, rank) AS r FROM tiered
  WHERE NOT qo OR is_online) WHERE r <= 6""")
def _(t):
    asked = queries(t).withColumnRenamed("search_text", "query").withColumn("limit", F.lit(6))
    return ps.brand_aware_search(asked, t.listings, t.products, t.stores, items(t)).select("query_id", "product_id", "store_id", "rank")


@check("c19_query_time_dedup", f"""{core()}, {FILTERED},
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, canonical_name, price ORDER BY rank) AS first FROM fin)
SELECT query_id, product_id, store_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM d WHERE first = 1""")
def _(t):
    kept = ps.filtered_results(queries(t), t.listings, t.products, t.stores, items(t))
    return ps.distinct_results(kept, ["query_id", "product_id", "store_id", "rank"])


# ---- stores ------------------------------------------------------------------


@check("c21_list_stores", """
SELECT store_id, name_he, (SELECT count(*) FROM v_stores WHERE city ILIKE '%nation%') AS total FROM v_stores WHERE city ILIKE '%nation%'
ORDER BY name_he, store_id LIMIT 10 OFFSET 10""")
def _(t):
    return ss.list_stores(t.stores, city="nation", page=2, page_size=10).select("store_id", "name_he", "total")


@check("c03_store_search", f"""
SELECT store_id, round({DIST}, 2) AS distance_km, (SELECT count(*) FROM v_listings l WHERE l.store_id = s.store_id) AS product_count,
  count(*) OVER () AS total_available FROM v_stores s WHERE store_category ILIKE 'retail' AND (name_he ILIKE '%supplier%' OR name_en ILIKE '%supplier%')
  AND lat IS NOT NULL AND lng IS NOT NULL AND {DIST} <= 250 ORDER BY distance_km, store_id LIMIT 5""")
def _(t):
    found = ss.store_search(t.stores, t.listings, query="supplier", store_type="retail", lat=31.0, lng=35.0, radius_km=250.0, page_size=5)
    return found.select("store_id", "distance_km", "product_count", "total_available")


PAIR_DIST = KM.format(qlat="a.lat", qlng="a.lng", lat="b.lat", lng="b.lng")


@check("c03_store_search_near_batch", f"""
WITH d AS (SELECT a.store_id AS query_id, b.store_id, {PAIR_DIST} AS km FROM v_stores a JOIN v_stores b ON b.lat IS NOT NULL
  WHERE a.lat IS NOT NULL AND {PAIR_DIST} <= 0.5 + a.store_id % 60)
SELECT query_id, store_id, round(km, 2) AS distance_km, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(km, 2), store_id) AS rank FROM d) WHERE rank <= 10""")
def _(t):
    asked = t.stores.where("lat IS NOT NULL").select(
        F.col("store_id").alias("query_id"), F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng"),
        (F.lit(0.5) + F.col("store_id") % 60).alias("radius_km"),
    )
    return ss.store_search_near(asked, t.stores, t.listings, 10).select("query_id", "store_id", "distance_km", "rank")


TEST_BUCKETS = [(["NATION_1", "NATION_3", "NATION_4"], ["alpha", "nation_7"])]
EXPANDED = """
asked AS (SELECT query_id, CASE vec_id % 4 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'NATION_7' WHEN 2 THEN 'NATION_2' END AS city,
   CASE WHEN vec_id % 3 = 0 THEN 'spa' END AS store_type, online_only, 3 + vec_id % 4 AS lim FROM v_queries),
b AS (SELECT *, unnest(bs) AS bucket_text, generate_subscripts(bs, 1) - 1 AS bucket FROM (SELECT *, CASE WHEN city IS NULL THEN [''] WHEN lower(city) IN ('alpha', 'nation_7')
   THEN list_concat([city], ['NATION_1', 'NATION_3', 'NATION_4']) ELSE [city] END AS bs FROM asked)),
c AS (SELECT s.*, (SELECT count(*) FROM v_listings l WHERE l.store_id = s.store_id) AS n FROM v_stores s),
per AS (SELECT * FROM (SELECT b.query_id, bucket, lim, online_only, c.store_id, c.is_online, row_number() OVER (PARTITION BY b.query_id, bucket ORDER BY n DESC, c.store_id) AS rk
   FROM b JOIN c ON coalesce(c.city, '') ILIKE '%' || bucket_text || '%' WHERE (store_type IS NULL OR c.store_category ILIKE store_type) AND (NOT online_only OR c.is_online)) WHERE {rows}),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, store_id ORDER BY bucket, rk) AS f FROM per) WHERE f = 1),
used AS (SELECT * FROM (SELECT *, (SELECT count(*) FROM firsts g WHERE g.query_id = firsts.query_id AND g.bucket < firsts.bucket) AS before FROM firsts) WHERE {stop})"""
ALL_STORES = EXPANDED.format(rows="true", stop="true")
CAPPED_STORES = EXPANDED.format(rows="rk <= 10", stop="before < lim * 3")


C04 = """SELECT query_id, store_id, rank FROM (SELECT query_id, store_id, lim, row_number() OVER (PARTITION BY query_id ORDER BY bucket, rk) AS rank FROM used) WHERE rank <= lim"""


def expanded_queries(t, online="online_only"):
    return t.sql("SELECT * FROM v_queries").selectExpr(
        "query_id", "CASE vec_id % 4 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'NATION_7' WHEN 2 THEN 'NATION_2' END AS city",
        "CASE WHEN vec_id % 3 = 0 THEN 'spa' END AS store_type", f"{online} AS online_only", "3 + vec_id % 4 AS limit",
    )


@check("c04_city_expanded_store_search", f"WITH {ALL_STORES} {C04}")
def _(t):
    return ss.city_expanded_search(expanded_queries(t), t.stores, t.listings, TEST_BUCKETS).select("query_id", "store_id", "rank")


@check("c04_city_expanded_capped", f"WITH {CAPPED_STORES} {C04}")
def _(t):
    found = ss.city_expanded_search(expanded_queries(t), t.stores, t.listings, TEST_BUCKETS, ss.BUCKET_ROWS, ss.STOP_FACTOR)
    return found.select("query_id", "store_id", "rank")


@check("u02_bucket_union_search", f"""
WITH {ALL_STORES.replace("online_only, 3 + vec_id", "false AS online_only, 3 + vec_id")}
SELECT query_id, store_id, bucket, row_number() OVER (PARTITION BY query_id ORDER BY bucket, rk) AS rank FROM used QUALIFY rank <= lim""")
def _(t):
    asked = expanded_queries(t, "false")
    return ss.city_expanded_search(asked, t.stores, t.listings, TEST_BUCKETS).select("query_id", "store_id", "bucket", "rank")


@check("c22_collapse_chains", """
WITH c AS (SELECT s.store_id, s.store_category AS query_id, row_number() OVER (PARTITION BY s.store_category ORDER BY s.store_id) AS rank,
  CASE WHEN s.store_id % 3 = 0 THEN 'chain:' || cast(s.store_id % 5 AS varchar) ELSE cast(s.store_id AS varchar) END AS card FROM v_stores s),
g AS (SELECT query_id, card, min(rank) AS r, arg_min(store_id, rank) AS store_id, count(*) AS locations FROM c GROUP BY 1, 2)
SELECT query_id, store_id, locations, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM g""")
def _(t):
    rows = ranking.rank_within(t.stores.select("store_id", F.col("store_category").alias("query_id")), ["query_id"], [F.col("store_id")])
    links = t.stores.where("store_id % 3 = 0").select("store_id", (F.col("store_id") % 5).alias("chain_id"))
    return ss.collapse_chains(rows, links)


@check("c16_fill_search_gaps", """
WITH u AS (SELECT user_id, cast(min(event_id) % 7 AS varchar) AS tag FROM events GROUP BY user_id)
SELECT e.event_id AS query_id, coalesce(CASE WHEN e.event_id % 3 = 0 THEN 77e0 END, CASE WHEN u.user_id % 4 <> 0 THEN u.tag::DOUBLE * 100 END) AS max_price,
  coalesce(CASE WHEN e.event_id % 5 = 0 THEN 'asked' END, CASE WHEN e.event_id % 2 = 0 AND u.user_id % 5 <> 0 THEN 'City' || u.tag END) AS city
FROM events e JOIN u ON u.user_id = e.user_id""")
def _(t):
    asked = t.events.selectExpr(
        "event_id AS query_id", "user_id", "CASE WHEN event_id % 3 = 0 THEN 77D END AS max_price",
        "CASE WHEN event_id % 5 = 0 THEN 'asked' END AS city", "event_id % 2 = 1 AS needs_user_location",
    )
    tag = t.events.groupBy("user_id").agg((F.min("event_id") % 7).cast("string").alias("tag"))
    prefs = tag.where("user_id % 4 <> 0").selectExpr("user_id", "'default_max_price' AS key", "concat(tag, '00.0') AS value").unionByName(
        tag.selectExpr("user_id", "'preferred_cities' AS key", "CASE WHEN user_id % 5 = 0 THEN 'not json' ELSE concat('[\"City', tag, '\", \"x\"]') END AS value")
    )
    return ps.fill_search_gaps(asked, prefs).select("query_id", "max_price", "city")


@check("x01_word_overlap", """
SELECT a.query_id, p.product_id, round(least(0.9::DOUBLE, 0.4::DOUBLE + (len(list_intersect(string_split(lower(a.search_text), ' '),
  list_concat(string_split(lower(p.canonical_name), ' '), [lower(coalesce(p.brand, ''))])))::DOUBLE / 2) * 0.5::DOUBLE), 6) AS similarity
FROM v_queries a JOIN v_products p ON p.product_id % 40 = a.vec_id % 40""")
def _(t):
    pairs = t.sql("SELECT * FROM v_queries").select("query_id", "search_text", (F.col("vec_id") % 40).alias("m")).join(
        t.products.withColumn("m", F.col("product_id") % 40), "m"
    )
    score = text.word_overlap(F.col("search_text"), F.col("canonical_name"), F.col("brand"))
    return pairs.select("query_id", "product_id", F.round(score, 6).alias("similarity"))


@check("x02_keyword_terms", """
SELECT conv_id, turn, '%' || content || '%' AS term FROM v_turns WHERE content <> ''""")
def _(t):
    k = text.keyword_patterns(F.col("content"))
    return t.turns.where("content <> ''").select("conv_id", "turn", k.term.alias("term"))


@check("x02_keyword_words", """
SELECT product_id, '%' || string_split(canonical_name, ' ')[1] || '%' AS word1, '%' || string_split(canonical_name, ' ')[2] || '%' AS word2 FROM v_products""")
def _(t):
    k = text.keyword_patterns(F.concat(F.lit(" x "), F.col("canonical_name")))
    return t.products.select("product_id", k.word1.alias("word1"), k.word2.alias("word2"))


@check("x02_pattern_join", """
SELECT p.name AS pattern_of, s.name_he FROM (SELECT DISTINCT right(name_he, 2) AS name FROM v_stores) p JOIN (SELECT DISTINCT name_he FROM v_stores) s
ON s.name_he ILIKE '%_' || p.name || '%'""")
def _(t):
    asked = t.stores.select(F.right("name_he", F.lit(2)).alias("pattern_of")).distinct().withColumn(
        "pattern", F.concat(F.lit("%_"), F.col("pattern_of"), F.lit("%"))
    )
    return patterns.pattern_join(asked, t.stores.select("name_he").distinct(), "name_he").select("pattern_of", "name_he")


# Patterns of one letter and of wildcards only, which no piece of three characters serves.
@check("x02_pattern_join_short", """
WITH p AS (SELECT DISTINCT '%' || left(name_he, 1) || '%' AS pattern FROM v_stores UNION SELECT '%' UNION SELECT '_%e_' UNION SELECT '%zzz%' UNION SELECT ''),
s AS (SELECT DISTINCT name_he FROM v_stores)
SELECT pattern, name_he FROM p JOIN s ON name_he ILIKE pattern""")
def _(t):
    asked = t.stores.select(F.concat(F.lit("%"), F.left("name_he", F.lit(1)), F.lit("%")).alias("pattern"))
    asked = asked.unionAll(t.spark.createDataFrame([("%",), ("_%e_",), ("%zzz%",), ("",)], "pattern string")).distinct()
    return patterns.pattern_join(asked, t.stores.select("name_he").distinct(), "name_he", list_rows=50).select("pattern", "name_he")


@check("x10_embed_text", """
SELECT product_id, CASE WHEN coalesce(brand, '') = '' THEN canonical_name ELSE brand || ' ' || canonical_name END AS text FROM v_products""")
def _(t):
    return t.products.select("product_id", text.embed_text(F.col("canonical_name"), F.col("brand")).alias("text"))


@check("c02_chat_text", """
SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN event_type || ' B' WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 2 = 0 THEN 'B'
 ELSE props END AS search_text FROM events""")
def _(t):
    query = F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
    brand = F.when(F.col("event_id") % 2 == 0, "B").otherwise("")
    return t.events.select("event_id", ps.chat_text(query, blank_to_null(brand), F.col("props")).alias("search_text"))
