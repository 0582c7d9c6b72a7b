"""Clean-up jobs: prices, brands, categories, cities, chains."""

from pyspark.sql import functions as F

from shelfspark.checks.registry import check
from shelfspark.functions import embedding, rules, text
from shelfspark.operators import filters, joins, quarantine
from shelfspark.plans import cleaning, quality


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def regex_case(column: str, pattern_rules) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({column}, {quoted('|'.join(patterns))}, 'i') THEN {quoted(label)}" for label, patterns in pattern_rules
    )
    return f"CASE {whens} END"


def literal_case(column: str, brands) -> str:
    whens = " ".join(
        f"WHEN contains(lower({column}), {quoted(b.lower())}) THEN {quoted(b)}" for b in sorted(brands, key=len, reverse=True)
    )
    return f"CASE {whens} END"


def category_case(name: str, store: str) -> str:
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains(lower({name}), {quoted(k)})' for k in words)} THEN {quoted(path)}"
        for path, words in rules.CATEGORY_KEYWORDS
    )
    stores = " ".join(f"WHEN {store} = {quoted(c)} THEN {quoted(p)}" for c, p in rules.STORE_CATEGORY_FALLBACK)
    return f"CASE {whens} {stores} END"


BRAND = regex_case("canonical_name", rules.BRAND_PATTERNS)
LITERAL = literal_case("canonical_name", rules.LITERAL_BRANDS)
CHAIN = f"coalesce({regex_case('name_he', rules.CHAIN_PATTERNS)}, {regex_case('name_en', rules.CHAIN_PATTERNS)})"
FIRST_STORE = """first AS (SELECT l.product_id, s.store_category FROM (SELECT product_id, arg_min(store_id, listing_id) AS store_id FROM v_listings GROUP BY 1) l
  JOIN v_stores s ON s.store_id = l.store_id)"""


@check("f12_bogus_price", "SELECT listing_id, price FROM v_listings WHERE price IS NOT NULL AND (price = 999999 OR price <= 0)")
def _(t):
    return filters.bogus_price_targets(t.listings).select("listing_id", "price")


SIBLINGS = """
SELECT l.listing_id, l.price FROM {source} l JOIN (SELECT product_id, max(price) AS maxp FROM {source} WHERE price > 0 GROUP BY 1) m ON m.product_id = l.product_id
WHERE l.price > 0 AND l.price < 10 AND m.maxp >= l.price * 20"""


@check("f13_sibling_outlier", SIBLINGS.format(source="v_listings"))
def _(t):
    return filters.sibling_outliers(t.listings).select("listing_id", "price")


@check("j04_aggregate_self_join", """
SELECT l.listing_id, m.top_price FROM v_listings l JOIN (SELECT product_id, max(price) AS top_price FROM v_listings WHERE price > 0 GROUP BY 1) m
  ON m.product_id = l.product_id WHERE l.price > 0 AND l.price < 10 AND m.top_price >= l.price * 20""")
def _(t):
    return filters.sibling_outliers(t.listings).select("listing_id", "top_price")


NAMED = ["Supplier#000000001", "Supplier#000000002", "Supplier#000000003"]
NAMED_SQL = ", ".join(quoted(n) for n in NAMED)


@check("f14_installment_price", f"""
SELECT l.listing_id, CASE WHEN s.name_he IN ({NAMED_SQL}) AND l.price < 40 THEN NULL ELSE l.price END AS price
FROM v_listings l LEFT JOIN v_stores s ON s.store_id = l.store_id WHERE l.price < 40""")
def _(t):
    targets = filters.installment_targets(t.listings, t.stores, NAMED)
    clean, _saved = quarantine.null_store_prices(t.listings, targets)
    cheap = t.listings.where("price < 40").select("listing_id")
    return clean.join(cheap, "listing_id", "left_semi").select("listing_id", "price")


@check("a23_price_impact_by_store", f"""
SELECT s.name_he, count(*) AS will_be_nulled, min(l.price) AS min_price, max(l.price) AS max_price FROM v_listings l JOIN v_stores s ON s.store_id = l.store_id
WHERE s.name_he IN ({NAMED_SQL}) AND l.price < 40 GROUP BY 1""")
def _(t):
    return quarantine.price_impact(filters.installment_targets(t.listings, t.stores, NAMED))


@check("f15_missing_brand", "SELECT product_id FROM v_products WHERE (brand IS NULL OR brand = '') AND canonical_name IS NOT NULL")
def _(t):
    return filters.brand_candidates(t.products).select("product_id")


@check("f16_missing_category", "SELECT product_id FROM v_products WHERE category_path IS NULL OR category_path = ''")
def _(t):
    return filters.category_candidates(t.products).select("product_id")


@check("f17_missing_city", "SELECT store_id FROM v_stores WHERE (city IS NULL OR city = '') AND address <> ''")
def _(t):
    return filters.city_candidates(t.stores).select("store_id")


@check("f18_ungeocoded_stores", """
SELECT store_id, coalesce(nullif(address, ''), nullif(city, '')) || ', Atlantis' AS lookup_text FROM v_stores WHERE lat IS NULL AND (address IS NOT NULL OR city IS NOT NULL)""")
def _(t):
    return filters.geocode_worklist(t.stores, country="Atlantis").select("store_id", "lookup_text")


STATUS = """
SELECT store_id, CASE store_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'success' WHEN 2 THEN 'pending' ELSE 'skipped' END AS scrape_status,
  CASE WHEN store_id % 5 <> 0 THEN concat('https://shop', cast(store_id AS varchar(20)), '.example.com') END AS store_url, name_he, partner_url, store_category, is_online, city FROM v_stores"""


@check("f19_scrape_eligible", f"SELECT store_id FROM ({STATUS}) WHERE scrape_status IN ('done', 'success') AND store_url IS NOT NULL ORDER BY store_id LIMIT 40")
def _(t):
    return filters.eligible_stores(t.sql(STATUS), ["done", "success"], limit=40).select("store_id")


@check("f19_website_pending", f"SELECT store_id FROM ({STATUS}) WHERE scrape_status = 'pending' AND store_url IS NULL")
def _(t):
    return filters.eligible_stores(t.sql(STATUS), ["pending"], want_url=False).select("store_id")


@check("j03_first_related_value", f"WITH {FIRST_STORE} SELECT p.product_id, f.store_category AS first_store_category FROM v_products p LEFT JOIN first f ON f.product_id = p.product_id")
def _(t):
    return joins.first_store_category(t.products, t.listings, t.stores).select("product_id", "first_store_category")


@check("j05_popularity_left_join", """
SELECT p.product_id, count(l.listing_id) AS listing_count FROM v_products p LEFT JOIN v_listings l ON l.product_id = p.product_id WHERE NOT p.has_embedding
GROUP BY 1 ORDER BY listing_count DESC, p.product_id LIMIT 100""")
def _(t):
    return joins.embedding_worklist(t.products, t.listings, 100).select("product_id", "listing_count")


@check("j05_worklist_by_id", "SELECT product_id FROM v_products WHERE NOT has_embedding ORDER BY product_id LIMIT 5000")
def _(t):
    return joins.embedding_worklist(t.products, t.listings, 5000, by_id=True).select("product_id")


@check("j06_distinct_by_store", """
SELECT DISTINCT p.product_id FROM v_products p JOIN v_listings l ON l.product_id = p.product_id JOIN v_stores s ON s.store_id = l.store_id
WHERE NOT p.has_embedding AND s.name_en ILIKE '%nation_1'""")
def _(t):
    return joins.products_of_store(t.products.where("NOT has_embedding"), t.listings, t.stores.where("name_en ILIKE '%nation_1'")).select("product_id")


@check("x03_detect_brand", f"SELECT product_id, {BRAND} AS found FROM v_named_products")
def _(t):
    return t.named_products.select("product_id", text.detect_brand(F.col("canonical_name")).alias("found"))


@check("x04_detect_brand_longest", f"SELECT product_id, {LITERAL} AS found FROM v_named_products")
def _(t):
    return t.named_products.select("product_id", text.detect_brand_longest(F.col("canonical_name")).alias("found"))


@check("x05_detect_chain", f"SELECT store_id, {CHAIN} AS chain FROM v_named_stores")
def _(t):
    return t.named_stores.select("store_id", text.detect_chain(F.col("name_he"), F.col("name_en")).alias("chain"))


@check("x06_classify_category", f"WITH {FIRST_STORE} SELECT p.product_id, {category_case('p.canonical_name', 'f.store_category')} AS path FROM v_products p LEFT JOIN first f ON f.product_id = p.product_id")
def _(t):
    rows = joins.first_store_category(t.products, t.listings, t.stores)
    return rows.select("product_id", text.classify_category(F.col("canonical_name"), F.col("first_store_category")).alias("path"))


@check("x07_map_store_category", """
SELECT store_id, CASE WHEN store_id % 5 = 0 THEN 'other' WHEN store_id % 3 = 0 THEN 'retail' WHEN store_id % 2 = 0 THEN 'restaurant' ELSE 'retail' END AS by_voucher,
  CASE store_id % 4 WHEN 0 THEN 'leisure' WHEN 1 THEN 'hotel' WHEN 2 THEN 'other' ELSE 'other' END AS by_name FROM v_stores""")
def _(t):
    types = F.expr("filter(array(CASE WHEN store_id % 5 <> 0 THEN 'ALL' END, CASE WHEN store_id % 5 <> 0 AND store_id % 3 = 0 THEN 'STYLE' END, "
                   "CASE WHEN store_id % 5 <> 0 AND store_id % 2 = 0 THEN 'DINE' END), x -> x IS NOT NULL)")
    names = F.when(F.col("store_id") % 4 == 0, F.array(F.lit(" חוויות "), F.lit("לבית"))).when(
        F.col("store_id") % 4 == 1, F.array(F.lit("מלונות ונופש"))
    ).when(F.col("store_id") % 4 == 2, F.array(F.lit("unknown")))
    return t.stores.select(
        "store_id", text.store_category_by_voucher(types, "STYLE", "DINE").alias("by_voucher"), text.store_category_by_name(names).alias("by_name")
    )


@check("x08_expand_city", """
SELECT store_id, CASE WHEN store_id % 6 = 0 THEN '' WHEN store_id % 6 = 1 THEN ' Tel Aviv |ת"א והסביבה|תל אביב-יפו' WHEN store_id % 6 = 2 THEN 'בחיפה|חיפה והסביבה'
  WHEN store_id % 6 = 3 THEN 'ירושלים והסביבה' WHEN store_id % 6 = 4 THEN 'רמת השרון|השרון והסביבה' ELSE city END AS cities
FROM v_stores WHERE store_id % 6 <> 5 OR city IS NOT NULL""")
def _(t):
    k = F.col("store_id") % 6
    typed = (F.when(k == 0, "   ").when(k == 1, " Tel Aviv ").when(k == 2, "בחיפה").when(k == 3, "ירושלים והסביבה")
             .when(k == 4, "רמת השרון").otherwise(F.col("city")))
    rows = t.stores.where("store_id % 6 <> 5 OR city IS NOT NULL")
    return rows.select("store_id", F.array_join(text.expand_city(typed), "|").alias("cities"))


@check("x09_city_from_address", """
SELECT store_id, CASE WHEN store_id % 6 = 0 THEN region END AS city FROM v_stores""")
def _(t):
    return t.stores.select("store_id", text.city_from_address(F.coalesce("address", F.concat(F.lit("Main St, "), "city"), F.lit("x"))).alias("city"))


@check("x33_taxonomy_check", """
WITH tax AS (SELECT DISTINCT r_name || ' > ' || n_name AS path FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 <> 0)
SELECT store_id, CASE WHEN x.path IS NULL THEN 'Other > Uncategorized > General Products' ELSE x.path END AS category_path,
  CASE WHEN x.path IS NULL THEN 'Other' ELSE s.region END AS top_level_category FROM v_stores s LEFT JOIN tax x ON x.path = s.region || ' > ' || s.city""")
def _(t):
    taxonomy = t.sql("SELECT r_name || ' > ' || n_name AS category_path FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 <> 0")
    rows = t.stores.select("store_id", F.concat(F.col("region"), F.lit(" > "), F.col("city")).alias("category_path"))
    return cleaning.taxonomy_check(rows, taxonomy)


@check("s16_quarantine_and_restore", """
SELECT 'clean' AS state, listing_id, CASE WHEN price = 999999 OR price <= 0 THEN NULL ELSE price END AS price FROM v_listings UNION ALL SELECT 'restored', listing_id, price FROM v_listings""")
def _(t):
    clean, saved = quarantine.quarantine(t.listings, filters.bogus_price_targets(t.listings), "listing_id", "price")
    back = quarantine.restore(clean, saved, "listing_id", "price")
    shown = lambda df, state: df.select(F.lit(state).alias("state"), "listing_id", "price")
    return shown(clean, "clean").unionByName(shown(back, "restored"))


@check("c07_price_cleanup", f"""
WITH a AS (SELECT listing_id, product_id, store_id, CASE WHEN price = 999999 OR price <= 0 THEN NULL ELSE price END AS price, price AS original FROM v_listings),
o AS ({SIBLINGS.format(source='a')}),
b AS (SELECT a.*, o.listing_id IS NOT NULL AS outlier FROM a LEFT JOIN o ON o.listing_id = a.listing_id)
SELECT listing_id, original, CASE WHEN original = 999999 OR original <= 0 THEN 'bogus' WHEN outlier THEN 'outlier' ELSE 'installment' END AS reason FROM b
WHERE (original = 999999 OR original <= 0) OR outlier OR (price < 40 AND store_id IN (SELECT store_id FROM v_stores WHERE name_he IN ({NAMED_SQL})))""")
def _(t):
    return cleaning.price_cleanup(t.listings, t.stores, NAMED)[1]


@check("c07_clean_prices", f"""
WITH a AS (SELECT listing_id, product_id, CASE WHEN price = 999999 OR price <= 0 THEN NULL ELSE price END AS price FROM v_listings), o AS ({SIBLINGS.format(source='a')})
SELECT count(*) AS rows, count(price) AS priced, round(sum(price), 2) AS total, min(price) AS lowest, max(price) AS highest FROM a WHERE listing_id NOT IN (SELECT listing_id FROM o)
  OR price IS NULL""")
def _(t):
    clean = cleaning.price_cleanup(t.listings)[0]
    gone = filters.sibling_outliers(cleaning.quarantine(t.listings, filters.bogus_price_targets(t.listings), "listing_id", "price")[0])
    kept = clean.join(gone.select("listing_id"), "listing_id", "left_anti")
    return kept.agg(F.count("*").alias("rows"), F.count("price").alias("priced"), F.round(F.sum("price"), 2).alias("total"),
                    F.min("price").alias("lowest"), F.max("price").alias("highest"))


@check("c08_category_backfill", f"""
WITH {FIRST_STORE} SELECT p.product_id, CASE WHEN coalesce(p.category_path, '') <> '' THEN p.category_path ELSE {category_case('p.canonical_name', 'f.store_category')} END AS category_path
FROM v_products p LEFT JOIN first f ON f.product_id = p.product_id""")
def _(t):
    return cleaning.category_backfill(t.products, t.listings, t.stores)[0].select("product_id", "category_path")


@check("c08_undo_backfill", "SELECT product_id, category_path FROM v_products")
def _(t):
    filled, assigned = cleaning.category_backfill(t.products, t.listings, t.stores)
    return quarantine.undo_backfill(filled, assigned, "product_id", "category_path").select("product_id", "category_path")


@check("c09_brand_backfill", f"SELECT product_id, CASE WHEN coalesce(brand, '') <> '' THEN brand ELSE coalesce({BRAND}, brand) END AS brand FROM v_named_products")
def _(t):
    return cleaning.brand_backfill(t.named_products)[0].select("product_id", "brand")


@check("c09_store_brand_backfill", f"""
SELECT p.product_id, {LITERAL} AS value FROM v_named_products p WHERE p.brand IS NULL AND {LITERAL} IS NOT NULL AND p.product_id IN
 (SELECT l.product_id FROM v_listings l JOIN v_stores s ON s.store_id = l.store_id WHERE s.name_he ILIKE '%#0000000_1%' OR s.name_en ILIKE '%nation_2%')""")
def _(t):
    return cleaning.store_brand_assignments(t.named_products, t.listings, t.stores, ["%#0000000_1%", "%nation_2%"])


@check("c10_city_backfill", "SELECT store_id, CASE WHEN store_id % 6 = 0 THEN region ELSE city END AS city FROM v_stores")
def _(t):
    return cleaning.city_backfill(t.stores)[0].select("store_id", "city")


CHAINS = f"WITH c AS (SELECT store_id, {CHAIN} AS chain FROM v_named_stores), p AS (SELECT chain, min(store_id) AS parent FROM c WHERE chain IS NOT NULL GROUP BY chain)"


@check("w06_chain_canonical", f"{CHAINS} SELECT c.store_id, c.chain, CASE WHEN c.store_id <> p.parent THEN p.parent END AS parent_id FROM c JOIN p ON p.chain = c.chain")
def _(t):
    return cleaning.chain_links(t.named_stores)


@check("c11_chain_linking", f"""{CHAINS}
SELECT s.store_id, CASE WHEN c.store_id <> p.parent THEN p.parent WHEN s.store_id % 2 = 0 THEN s.store_id - 2 END AS parent_chain_id
FROM v_named_stores s LEFT JOIN c ON c.store_id = s.store_id LEFT JOIN p ON p.chain = c.chain""")
def _(t):
    stores = t.named_stores.withColumn("parent_chain_id", F.expr("CASE WHEN store_id % 2 = 0 THEN store_id - 2 END"))
    return cleaning.chain_linking(stores)[0].select("store_id", "parent_chain_id")


@check("c11_changed_links", f"""{CHAINS}
SELECT c.store_id, c.chain, p.parent AS parent_id FROM c JOIN p ON p.chain = c.chain WHERE c.store_id <> p.parent AND
 coalesce(CASE WHEN c.store_id % 2 = 0 THEN p.parent END, -1) <> p.parent""")
def _(t):
    links = cleaning.chain_links(t.named_stores).select("store_id", "parent_id")
    stores = t.named_stores.join(links, "store_id", "left").withColumn(
        "parent_chain_id", F.expr("CASE WHEN store_id % 2 = 0 THEN parent_id END")
    ).drop("parent_id")
    return cleaning.chain_linking(stores)[1]


@check("j15_chain_parent_join", """
WITH e AS (SELECT store_id, CASE store_id % 4 WHEN 0 THEN 'Supplier#000000003' WHEN 1 THEN 'New chain' WHEN 2 THEN '' END AS chain FROM v_stores)
SELECT e.store_id, e.chain AS chain_name, coalesce((SELECT cast(min(s.store_id) AS varchar) FROM v_stores s WHERE s.name_he = e.chain), 'chain:' || e.chain) AS parent_key
FROM e WHERE e.chain <> ''""")
def _(t):
    enriched = t.stores.select("store_id", F.expr("CASE store_id % 4 WHEN 0 THEN 'Supplier#000000003' WHEN 1 THEN 'New chain' WHEN 2 THEN '' END").alias("chain_name"))
    return joins.link_chains(t.stores, enriched)[0]


@check("j15_new_chain_parents", """
SELECT 'chain:New chain' AS parent_key, 'New chain' AS name_he, arg_min(store_category, store_id) AS store_category, false AS is_online FROM v_stores WHERE store_id % 4 = 1""")
def _(t):
    enriched = t.stores.select("store_id", F.expr("CASE store_id % 4 WHEN 0 THEN 'Supplier#000000003' WHEN 1 THEN 'New chain' END").alias("chain_name"))
    return joins.link_chains(t.stores, enriched)[1]


@check("a22_label_distribution", f"SELECT {BRAND} AS label, count(*) AS n FROM v_named_products WHERE coalesce(brand, '') = '' AND {BRAND} IS NOT NULL GROUP BY 1")
def _(t):
    return cleaning.label_distribution(cleaning.brand_assignments(t.named_products))


@check("d03_normaliser_hook", f"""
SELECT product_id, coalesce({BRAND}, {LITERAL}) AS brand, {category_case('canonical_name', "''")} AS category_path FROM v_named_products""")
def _(t):
    return cleaning.normalize_products(t.named_products, cleaning.rule_extractor).select("product_id", "brand", "category_path")


@check("x32_merge_normalized", f"SELECT product_id, coalesce({BRAND}, nullif(brand, '')) AS brand FROM v_named_products")
def _(t):
    from shelfspark.functions.records import merged_name

    return t.named_products.select("product_id", merged_name(text.detect_brand(F.col("canonical_name")), F.col("brand")).alias("brand"))


@check("d02_embedder_hook", "SELECT product_id, 64 AS dims, true AS filled FROM v_products")
def _(t):
    vectors = embedding.embed_products(t.products)
    return vectors.select("product_id", F.size("embedding").alias("dims"), F.exists("embedding", lambda x: x != 0).alias("filled"))


@check("c18_quality_after_cleanup", f"""
WITH a AS (SELECT listing_id, product_id, CASE WHEN price = 999999 OR price <= 0 THEN NULL ELSE price END AS price FROM v_listings), o AS ({SIBLINGS.format(source='a')}),
c AS (SELECT CASE WHEN listing_id IN (SELECT listing_id FROM o) THEN NULL ELSE price END AS price FROM a)
SELECT count(*) AS rows, count(*) FILTER (WHERE price < 10 OR price >= 100000) AS suspect FROM c""")
def _(t):
    return quality.price_quality_audit(cleaning.price_cleanup(t.listings)[0]).select("rows", "suspect")
