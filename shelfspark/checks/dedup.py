"""Near-duplicate pairs, groups and merges."""

from pyspark.sql import functions as F

from shelfspark.checks.registry import check
from shelfspark.operators import joins, vectors
from shelfspark.checks.traffic import PRICE_AUDIT
from shelfspark.plans import dedup, quality

PAIRS = """
pairs AS (SELECT a.product_id AS id, b.product_id AS neighbour, round(list_cosine_similarity(a.e, b.e), 9) AS sim
  FROM v_emb_dup a JOIN v_emb_dup b ON a.product_id <> b.product_id WHERE round(list_cosine_similarity(a.e, b.e), 9) >= 0.95)"""
# The sequential walk over ids: a product that no earlier group holds takes its free neighbours.
# Leaders are settled in id order, so each step looks at the leaders found before it.
WALK = f"""
{PAIRS},
nodes AS (SELECT DISTINCT id FROM pairs),
ordered AS (SELECT id, row_number() OVER (ORDER BY id) AS step FROM nodes),
walk AS (SELECT 0::BIGINT AS step, []::BIGINT[] AS leaders
  UNION ALL
  SELECT walk.step + 1, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.id = o.id AND list_contains(walk.leaders, p.neighbour)) THEN walk.leaders
    ELSE list_append(walk.leaders, o.id) END FROM walk JOIN ordered o ON o.step = walk.step + 1),
leaders AS (SELECT unnest(leaders) AS leader FROM walk WHERE step = (SELECT max(step) FROM walk)),
groups AS (SELECT id, min(neighbour) AS leader FROM pairs WHERE neighbour IN (SELECT leader FROM leaders) AND id NOT IN (SELECT leader FROM leaders) GROUP BY id),
members AS (SELECT id, leader FROM groups UNION ALL SELECT DISTINCT leader, leader FROM groups)"""
COUNTS = """
ids AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
listings AS (SELECT listing_id, CASE WHEN hash % 7 = 0 THEN 2 WHEN hash % 3 = 0 THEN 1 ELSE 0 END * (SELECT n FROM ids) + product_id % (SELECT n FROM ids) AS product_id, store_id, product_url
  FROM (SELECT *, product_id + store_id AS hash FROM v_listings))"""
CHOSEN = f"""
{COUNTS},
n AS (SELECT product_id AS id, count(*) AS n FROM listings GROUP BY 1),
canon AS (SELECT leader, id AS canonical_id FROM (SELECT m.leader, m.id, row_number() OVER (PARTITION BY m.leader ORDER BY coalesce(n, 0) DESC, m.id <> m.leader, m.id) AS rn
  FROM members m LEFT JOIN n ON n.id = m.id) WHERE rn = 1),
mapping AS (SELECT m.id AS product_id, c.canonical_id FROM members m JOIN canon c ON c.leader = m.leader WHERE m.id <> c.canonical_id)"""


def vec(t):
    return t.planted_vectors.withColumnRenamed("product_id", "id")


def listings(t):
    h = F.col("product_id") + F.col("store_id")
    copy = F.when(h % 7 == 0, 2).when(h % 3 == 0, 1).otherwise(0)
    shifted = copy * t.vector_ids + F.col("product_id") % t.vector_ids
    return t.listings.select("listing_id", shifted.alias("product_id"), "store_id", "product_url")


def groups(t):
    return dedup.duplicate_groups(vec(t), 0.95)


@check("j12_similarity_self_join", f"WITH {PAIRS} SELECT id, neighbour, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) AS rank FROM pairs")
def _(t):
    return vectors.near_duplicate_pairs(vec(t), 0.95).withColumn("similarity", F.round("similarity", 6))


@check("c06_duplicate_groups", f"WITH RECURSIVE {WALK} SELECT id, leader FROM members")
def _(t):
    return groups(t)


@check("w09_dup_group_canonical", f"WITH RECURSIVE {WALK}, {CHOSEN} SELECT m.id, m.leader, c.canonical_id FROM members m JOIN canon c ON c.leader = m.leader")
def _(t):
    return dedup.group_canonical(groups(t), listings(t))


MOVED = """
tgt AS (SELECT l.*, m.canonical_id, coalesce(m.canonical_id, l.product_id) AS target FROM listings l LEFT JOIN mapping m ON m.product_id = l.product_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY target, store_id, product_url ORDER BY canonical_id IS NOT NULL, product_id, listing_id) AS place FROM tgt)"""
MOVES = "canonical_id IS NOT NULL AND (product_url IS NULL OR place = 1)"


@check("j11_repoint_listings", f"""WITH RECURSIVE {WALK}, {CHOSEN}, {MOVED}
SELECT listing_id, CASE WHEN {MOVES} THEN target ELSE product_id END AS product_id, {MOVES} AS moved FROM placed""")
def _(t):
    mapping = dedup.group_canonical(groups(t), listings(t)).where("id <> canonical_id").select(F.col("id").alias("product_id"), "canonical_id")
    return joins.repoint_listings(listings(t), mapping).select("listing_id", "product_id", "moved")


@check("j11_insert_if_absent", "SELECT partner_url FROM v_stores WHERE store_id % 3 <> 0")
def _(t):
    return joins.insert_if_absent(t.stores.where("store_id % 3 = 0"), t.stores, "partner_url").select("partner_url")


@check("c06_deduplicate_catalog", f"""WITH RECURSIVE {WALK}, {CHOSEN}
SELECT e.product_id, m.product_id IS NOT NULL AS is_duplicate, m.canonical_id AS canonical_product_id FROM v_emb_dup e LEFT JOIN mapping m ON m.product_id = e.product_id""")
def _(t):
    return dedup.deduplicate_catalog(t.planted_vectors.select("product_id"), t.planted_vectors, listings(t))[0]


# Every fiftieth product was marked by an earlier run: it keeps its mark and no group takes it.
WALK_AGAIN = WALK.replace("v_emb_dup", "undecided")


@check("c06_second_run", f"""WITH RECURSIVE undecided AS (SELECT * FROM v_emb_dup WHERE product_id % 50 <> 0), {WALK_AGAIN}, {CHOSEN}
SELECT e.product_id, e.product_id % 50 = 0 OR m.product_id IS NOT NULL AS is_duplicate, CASE WHEN e.product_id % 50 = 0 THEN 7 ELSE m.canonical_id END AS canonical_product_id
FROM v_emb_dup e LEFT JOIN mapping m ON m.product_id = e.product_id""")
def _(t):
    earlier = F.col("product_id") % 50 == 0
    products = t.planted_vectors.select(
        "product_id", earlier.alias("is_duplicate"), F.when(earlier, F.lit(7).cast("bigint")).alias("canonical_product_id"))
    return dedup.deduplicate_catalog(products, t.planted_vectors, listings(t))[0]


@check("c06_stats", f"""WITH RECURSIVE {WALK}
SELECT count(DISTINCT leader) AS groups_found, count(*) - count(DISTINCT leader) AS products_merged FROM members""")
def _(t):
    return dedup.deduplicate_catalog(t.planted_vectors.select("product_id"), t.planted_vectors, listings(t))[2]


@check("a21_duplicate_rate", f"""WITH RECURSIVE {WALK}, s AS (SELECT (SELECT count(*) FROM v_emb_dup) AS products, (SELECT count(*) - count(DISTINCT leader) FROM members) AS duplicates)
SELECT products, duplicates, round(100.0::DOUBLE * duplicates / products, 2) AS duplicate_pct, round(100.0::DOUBLE * duplicates / products, 2) < 2 AS passed FROM s""")
def _(t):
    found = dedup.group_canonical(groups(t), listings(t))
    return dedup.duplicate_rate(found, t.planted_vectors)


@check("c18_gate_with_duplicates", f"""WITH RECURSIVE {WALK}, p AS ({PRICE_AUDIT}), vals AS (
 SELECT 'suspect_price_pct' AS "check", suspect_pct AS value, 0.5::DOUBLE AS target FROM p
 UNION ALL SELECT 'median_age_days', quantile_cont(date_diff('day', updated_at, (SELECT max(updated_at) FROM v_listings)), 0.5)::DOUBLE, 14.0 FROM v_listings
 UNION ALL SELECT 'missing_brand_pct', round(100.0::DOUBLE * count(*) FILTER (WHERE coalesce(brand, '') = '') / count(*), 2), 3.0 FROM v_products
 UNION ALL SELECT 'image_pct', round(100.0::DOUBLE * count(nullif(image_url, '')) / count(*), 2), 60.0 FROM v_listings
 UNION ALL SELECT 'duplicate_pct', round(100.0::DOUBLE * (SELECT count(*) - count(DISTINCT leader) FROM members) / (SELECT count(*) FROM v_emb_dup), 2), 2.0)
SELECT "check", value, target, CASE "check" WHEN 'median_age_days' THEN value <= target WHEN 'image_pct' THEN value > target ELSE value < target END AS passed FROM vals""")
def _(t):
    rate = dedup.duplicate_rate(dedup.group_canonical(groups(t), listings(t)), t.planted_vectors)
    return quality.quality_gate(t.listings, t.products, t.stores, rate)


# Every vector stands three times in the table: copies must stay one group with their original.
@check("c06_groups_of_copies", f"""WITH RECURSIVE {WALK}, base AS (SELECT e.product_id, coalesce(m.leader, e.product_id) AS leader FROM v_emb_dup e LEFT JOIN members m ON m.id = e.product_id)
SELECT product_id + k * 3 * (SELECT max(vec_id) + 1 FROM embeddings) AS id, leader FROM base, (SELECT unnest([0, 1, 2]) AS k)""")
def _(t):
    copies = vec(t).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return dedup.duplicate_groups(copies.select((F.col("id") + F.col("k") * 3 * t.vector_ids).alias("id"), "embedding"), 0.95)


@check("j13_best_master_match", """
WITH c AS (SELECT product_id, e FROM v_emb_dup WHERE product_id > (SELECT max(vec_id) FROM embeddings)), m AS (SELECT product_id, e FROM v_emb_dup WHERE product_id <= (SELECT max(vec_id) FROM embeddings)),
s AS (SELECT c.product_id AS candidate_id, m.product_id AS master, round(list_cosine_similarity(c.e, m.e), 9) AS sim FROM c, m),
b AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY sim DESC, master) AS rn FROM s)
SELECT candidate_id, sim >= 0.92 AS is_duplicate, round(sim, 6) AS similarity, CASE WHEN sim >= 0.92 THEN master END AS master_id FROM b WHERE rn = 1
UNION ALL SELECT -1, false, 0, NULL""")
def _(t):
    rows = t.planted_vectors
    candidates = rows.where(F.col("product_id") >= t.vector_ids).select(F.col("product_id").alias("candidate_id"), F.lit("x").alias("text"), "embedding")
    failed = candidates.limit(1).select(F.lit(-1).cast("bigint").alias("candidate_id"), "text", F.array().cast("array<double>").alias("embedding"))
    masters = rows.where(F.col("product_id") < t.vector_ids).select(F.col("product_id").alias("master_id"), F.col("product_id").cast("string").alias("name"), "embedding")
    found = vectors.match_to_masters(candidates.unionByName(failed), masters)
    return found.select("candidate_id", "is_duplicate", F.round("similarity", 6).alias("similarity"), "master_id")


@check("d04_scoring_udf", """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0)
SELECT q.query_id, m.product_id, round(list_cosine_similarity(q.e, m.e), 6) AS similarity FROM q, v_emb_dup m WHERE round(list_cosine_similarity(q.e, m.e), 9) >= 0.3""")
def _(t):
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    found = vectors.top_k_similar(asked, t.planted_vectors.withColumnRenamed("product_id", "item_id"), None, 0.3)
    return found.select("query_id", F.col("item_id").alias("product_id"), F.round("similarity", 6).alias("similarity"))
