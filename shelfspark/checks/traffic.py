"""Traffic, trace and audit reports."""

from pyspark.sql import functions as F

from shelfspark.checks.registry import ORACLES, check
from shelfspark.operators import joins, ranking
from shelfspark.plans import quality, traffic
from shelfspark.session import cut_lineage
from shelfspark.sources import tables

NOW = "(SELECT max(searched_at) FROM v_searches)"
WEEK = f"searched_at > {NOW} - INTERVAL 7 DAY"
TNOW = "(SELECT max(created_at) FROM v_traces)"
TWEEK = f"created_at >= {TNOW} - INTERVAL 7 DAY"


@check("a01_searches_recent", f"""
SELECT count(*) FILTER (WHERE searched_at > {NOW} - INTERVAL 24 HOUR) AS last_24h,
       count(*) FILTER (WHERE {WEEK}) AS last_7d, count(*) AS all_time FROM v_searches""")
def _(t):
    return traffic.searches_recent(t.searches)


@check("a02_active_users", f"""
SELECT count(DISTINCT user_id) FILTER (WHERE searched_at > {NOW} - INTERVAL 24 HOUR) AS dau,
       count(DISTINCT user_id) FILTER (WHERE {WEEK}) AS wau FROM v_searches""")
def _(t):
    return traffic.active_users(t.searches)


@check("a03_top_messages", f"""
SELECT message, count(*) AS times_asked, cast(round(avg(result_count)) AS int) AS avg_results,
       count(*) FILTER (WHERE result_count = 0) AS zero_result_count
FROM v_searches WHERE {WEEK} GROUP BY message ORDER BY times_asked DESC, message LIMIT 30""")
def _(t):
    return traffic.top_messages(t.searches)


@check("a04_intent_breakdown", f"""
SELECT intent, count(*) AS hits, round(avg(result_count), 1) AS avg_results,
       count(*) FILTER (WHERE result_count = 0) AS zero_result_hits
FROM v_searches WHERE {WEEK} GROUP BY intent""")
def _(t):
    return traffic.intent_breakdown(t.searches)


@check("a05_zero_result_queries", f"""
SELECT message, intent, count(*) AS times FROM v_searches WHERE result_count = 0 AND {WEEK}
GROUP BY message, intent ORDER BY times DESC, message, intent LIMIT 20""")
def _(t):
    return traffic.zero_result_queries(t.searches)


@check("a06_returning_users", f"""
SELECT count(*) AS returning_users FROM (SELECT user_id FROM v_searches WHERE {WEEK} GROUP BY user_id
HAVING count(DISTINCT cast(searched_at AS date)) >= 2)""")
def _(t):
    return traffic.returning_users(t.searches)


@check("a07_user_activity_bands", f"""
SELECT count(*) FILTER (WHERE n = 1) AS one_search_users, count(*) FILTER (WHERE n BETWEEN 2 AND 5) AS light_users,
       count(*) FILTER (WHERE n BETWEEN 6 AND 20) AS regular_users, count(*) FILTER (WHERE n > 20) AS heavy_users
FROM (SELECT user_id, count(*) AS n FROM v_searches WHERE {WEEK} GROUP BY user_id)""")
def _(t):
    return traffic.user_activity_bands(t.searches)


@check("a08_registration_conversion", """
SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM v_searches h WHERE h.user_id = u.user_id
         AND h.searched_at < u.created_at + INTERVAL 5 MINUTE)) AS imported_their_session, count(*) AS new_users_7d
FROM v_users u WHERE created_at > (SELECT max(created_at) FROM v_users) - INTERVAL 7 DAY""")
def _(t):
    return traffic.registration_conversion(t.users, t.searches)


@check("a09_category_pull", f"""
SELECT s.store_category, count(DISTINCT h.user_id) AS unique_searchers, count(*) AS appearances_in_results
FROM v_searches h JOIN v_stores s ON s.name_he = h.top_result_name OR s.name_en = h.top_result_name
WHERE {WEEK} GROUP BY s.store_category""")
def _(t):
    return traffic.category_pull(t.searches, t.stores)


@check("a10_city_demand", f"""
SELECT city_used, count(*) AS searches, count(DISTINCT user_id) AS users FROM v_searches
WHERE city_used IS NOT NULL AND {WEEK} GROUP BY city_used ORDER BY searches DESC, city_used LIMIT 15""")
def _(t):
    return traffic.city_demand(t.searches)


@check("a11_intent_share", f"""
SELECT intent, count(*) AS turns, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct
FROM v_traces WHERE {TWEEK} GROUP BY intent""")
def _(t):
    return traffic.intent_share(t.traced)


@check("a12_tool_success_rate", f"""
SELECT tool_name, count(*) AS calls, count(*) FILTER (WHERE tool_error IS NULL) AS successes,
       round(100.0::DOUBLE * count(*) FILTER (WHERE tool_error IS NULL) / count(*), 1) AS success_pct
FROM v_traces WHERE {TWEEK} GROUP BY tool_name""")
def _(t):
    return traffic.tool_success_rate(t.traced)


@check("a13_latency_percentiles", f"""
SELECT round(quantile_cont(total_latency_ms, 0.5), 6) AS p50_latency_ms,
       round(quantile_cont(total_latency_ms, 0.95), 6) AS p95_latency_ms, count(*) AS n
FROM v_traces WHERE {TWEEK}""")
def _(t):
    df = traffic.latency_percentiles(t.traced)
    return df.select("n", *[F.round(c, 6).alias(c) for c in ("p50_latency_ms", "p95_latency_ms")])


@check("a13_latency_by_intent", f"""
SELECT intent, round(quantile_cont(total_latency_ms, 0.5), 6) AS p50_latency_ms,
       round(quantile_cont(total_latency_ms, 0.95), 6) AS p95_latency_ms, count(*) AS n
FROM v_traces WHERE {TWEEK} GROUP BY intent""")
def _(t):
    df = traffic.latency_percentiles(t.traced, ["intent"])
    return df.select("intent", "n", *[F.round(c, 6).alias(c) for c in ("p50_latency_ms", "p95_latency_ms")])


@check("a14_sessions_with_results", f"""
WITH last AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, trace_id DESC) AS rn
              FROM v_traces WHERE {TWEEK})
SELECT count(*) AS sessions, count(*) FILTER (WHERE tool_name IN ('search_products', 'search_stores') AND result_count > 0)
       AS sessions_with_results FROM last WHERE rn = 1""")
def _(t):
    return traffic.sessions_with_results(t.traced)


@check("a15_decision_signals", f"""
WITH w AS (SELECT * FROM v_searches WHERE {WEEK}),
u AS (SELECT * FROM v_users WHERE created_at > (SELECT max(created_at) FROM v_users) - INTERVAL 7 DAY),
per AS (SELECT user_id, count(*) AS n, count(DISTINCT cast(searched_at AS date)) AS d FROM w GROUP BY user_id),
vals AS (
 SELECT 'few_searches' AS signal, (SELECT count(*) FROM w)::DOUBLE AS value, 20.0::DOUBLE AS threshold
 UNION ALL SELECT 'clarify_share', (SELECT 100.0::DOUBLE * count(*) FILTER (WHERE intent = 'signup') / count(*) FROM w), 20.0
 UNION ALL SELECT 'zero_result_share', (SELECT 100.0::DOUBLE * count(*) FILTER (WHERE result_count = 0) / count(*) FROM w), 30.0
 UNION ALL SELECT 'returning_users', (SELECT count(*) FROM per WHERE d >= 2)::DOUBLE, 5.0
 UNION ALL SELECT 'imported_session_share', (SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM v_searches h
     WHERE h.user_id = u.user_id AND h.searched_at < u.created_at + INTERVAL 5 MINUTE))::DOUBLE / greatest(count(*), 1) FROM u), 0.3
 UNION ALL SELECT 'heavy_users', (SELECT count(*) FROM per WHERE n > 20)::DOUBLE, 1.0)
SELECT signal, round(value, 4) AS value, threshold, CASE WHEN signal IN ('few_searches', 'imported_session_share')
       THEN value < threshold WHEN signal = 'heavy_users' THEN value >= threshold ELSE value > threshold END AS fired FROM vals""")
def _(t):
    return traffic.decision_signals(t.searches, t.users, clarify_intent="signup")


@check("a16_catalog_health", """
SELECT count(*) AS products_total, count(*) FILTER (WHERE has_embedding) AS products_embedded,
       (SELECT count(*) FROM v_stores) AS stores_total, (SELECT count(lat) FROM v_stores) AS stores_geocoded,
       round(100.0::DOUBLE * count(*) FILTER (WHERE has_embedding) / count(*), 1) AS embedding_coverage_pct FROM v_products""")
def _(t):
    return quality.catalog_health(t.products, t.stores)


@check("a17_store_product_counts", """
SELECT store_id, count(*) AS listing_count FROM v_listings GROUP BY store_id""")
def _(t):
    return quality.listing_counts(t.listings, "store_id")


@check("a17_product_listing_counts", """
SELECT product_id, count(*) AS listing_count FROM v_listings GROUP BY product_id""")
def _(t):
    return quality.listing_counts(t.listings, "product_id")


PRICE_AUDIT = """
SELECT count(*) AS rows, count(*) FILTER (WHERE price IS NULL) AS null_price, count(*) FILTER (WHERE price <= 0) AS non_positive,
  count(*) FILTER (WHERE price = 999999) AS sentinel, count(*) FILTER (WHERE price >= 100000 AND price <> 999999) AS very_high,
  count(*) FILTER (WHERE price > 0 AND price < 10) AS below_ten, min(price) FILTER (WHERE price > 0) AS min_positive,
  max(price) AS max_price, round(avg(price) FILTER (WHERE price > 0), 2) AS avg_positive,
  count(*) FILTER (WHERE price < 10 OR price >= 100000) AS suspect,
  round(100.0::DOUBLE * count(*) FILTER (WHERE price < 10 OR price >= 100000) / count(*), 2) AS suspect_pct FROM v_listings"""


@check("a18_price_quality_audit", f"WITH a AS ({PRICE_AUDIT}) SELECT *, suspect_pct < 0.5 AS passed FROM a")
def _(t):
    return quality.price_quality_audit(t.listings)


@check("a19_null_rate_audit", """
SELECT count(*) AS products, count(*) FILTER (WHERE coalesce(category_path, '') = '') AS missing_category,
  count(*) FILTER (WHERE coalesce(brand, '') = '') AS missing_brand, count(DISTINCT nullif(category_path, '')) AS category_values,
  round(100.0::DOUBLE * count(*) FILTER (WHERE coalesce(category_path, '') = '') / count(*), 2) AS missing_category_pct,
  round(100.0::DOUBLE * count(*) FILTER (WHERE coalesce(brand, '') = '') / count(*), 2) AS missing_brand_pct FROM v_products""")
def _(t):
    return quality.null_rate_audit(t.products)


@check("a19_null_rate_by_store", """
WITH held AS (SELECT DISTINCT store_id, product_id FROM v_listings)
SELECT h.store_id, count(*) AS products, count(*) FILTER (WHERE coalesce(category_path, '') = '') AS missing_category,
  count(*) FILTER (WHERE coalesce(brand, '') = '') AS missing_brand, any_value(i.listings) AS listings, any_value(i.missing_image) AS missing_image
FROM held h JOIN v_products p ON h.product_id = p.product_id
JOIN (SELECT store_id, count(*) AS listings, count(*) FILTER (WHERE coalesce(image_url, '') = '') AS missing_image
      FROM v_listings GROUP BY store_id) i ON i.store_id = h.store_id GROUP BY h.store_id""")
def _(t):
    return quality.null_rate_by_store(t.listings, t.products)


@check("a19_city_gaps", """
SELECT count(*) AS stores, count(*) FILTER (WHERE coalesce(city, '') = '') AS missing_city,
  round(100.0::DOUBLE * count(*) FILTER (WHERE coalesce(city, '') = '') / count(*), 2) AS missing_city_pct FROM v_stores""")
def _(t):
    return quality.city_gaps(t.stores)


STALE = """
WITH a AS (SELECT {key} date_diff('day', updated_at, (SELECT max(updated_at) FROM v_listings)) AS age FROM v_listings)
SELECT {key} count(*) AS listings, count(*) FILTER (WHERE age > 30) AS stale, quantile_cont(age, 0.5)::DOUBLE AS median_age_days,
  round(100.0::DOUBLE * count(*) FILTER (WHERE age > 30) / count(*), 2) AS stale_pct, quantile_cont(age, 0.5) <= 14 AS passed
FROM a {group}"""


@check("a20_staleness_audit", STALE.format(key="", group=""))
def _(t):
    return quality.staleness_audit(t.listings)


@check("a20_staleness_by_store", STALE.format(key="store_id,", group="GROUP BY store_id"))
def _(t):
    return quality.staleness_audit(t.listings, by=["store_id"])


@check("a26_cost_summary", """
SELECT cast(cast(created_at AS date) AS varchar) AS day, round(sum(total_cost_usd)::DOUBLE, 6) AS cost_usd,
  round(sum(total_cost_usd)::DOUBLE / 0.2 * 100, 2) AS pct_used, sum(total_cost_usd)::DOUBLE >= 0.2 AS over_budget
FROM v_traces WHERE total_cost_usd > 0 GROUP BY 1""")
def _(t):
    df = traffic.cost_by_day(t.traces, 0.2)
    return df.withColumn("day", F.col("day").cast("string")).withColumn("cost_usd", F.round("cost_usd", 6))


@check("a27_session_cost", """
WITH k AS (SELECT CASE WHEN trace_id % 4 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'ip:unknown' ELSE concat('ip:h', cast(user_id AS varchar)) END
  ELSE session_id END AS cap_key, total_cost_usd AS c FROM v_traces)
SELECT cap_key, round(sum(c)::DOUBLE, 6) AS cost_usd, sum(c)::DOUBLE >= 0.01 AS over_budget FROM k WHERE c > 0 GROUP BY cap_key""")
def _(t):
    rows = t.traces.select(
        F.when(F.col("trace_id") % 4 != 0, F.col("session_id")).alias("session_id"),
        F.when(F.col("user_id") % 2 == 1, F.concat(F.lit("h"), F.col("user_id").cast("string"))).alias("client_host"),
        "total_cost_usd",
    )
    return traffic.session_cost(rows, 0.01).withColumn("cost_usd", F.round("cost_usd", 6))


@check("a30_zero_result_pairs", f"""
SELECT s.store_category, city_used, count(*) AS times FROM v_searches h JOIN v_stores s ON s.name_he = h.top_result_name OR s.name_en = h.top_result_name
WHERE result_count = 0 AND city_used IS NOT NULL AND {WEEK} GROUP BY 1, 2 ORDER BY times DESC, store_category, city_used LIMIT 20""")
def _(t):
    return traffic.zero_result_pairs(t.searches, t.stores)


@check("a32_stratified_sample", """
WITH s AS (SELECT product_id, category_path, row_number() OVER (PARTITION BY category_path ORDER BY md5(cast(product_id AS varchar)), product_id) AS rank,
  (SELECT ceil(200.0 / count(DISTINCT coalesce(category_path, ''))) FROM v_products) AS share FROM v_products)
SELECT product_id, category_path, rank FROM s WHERE rank <= share""")
def _(t):
    return ranking.stratified_sample(t.products, "category_path", "product_id", 200).select("product_id", "category_path", "rank")


@check("w02_last_turn_per_session", """
SELECT session_id, trace_id, intent FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, trace_id DESC) AS rn
FROM v_traces) WHERE rn = 1""")
def _(t):
    return ranking.last_turn_per_session(t.traces).select("session_id", "trace_id", "intent")


@check("w03_share_of_total", """
SELECT tool_name, count(*) AS turns, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS pct FROM v_traces GROUP BY tool_name""")
def _(t):
    return traffic.share_of_total(t.traces.groupBy("tool_name").agg(F.count("*").alias("turns")))


@check("w04_latest_n_per_user", """
SELECT user_id, search_id, message, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY searched_at DESC, search_id DESC) AS rank
FROM v_searches) WHERE rank <= 3""")
def _(t):
    df = ranking.top_n(t.searches, ["user_id"], [F.desc("searched_at"), F.desc("search_id")], 3)
    return df.select("user_id", "search_id", "message", "rank")


@check("j07_imported_session_users", """
SELECT user_id FROM v_users u WHERE EXISTS (SELECT 1 FROM v_searches h WHERE h.user_id = u.user_id AND h.searched_at < u.created_at + INTERVAL 5 MINUTE)""")
def _(t):
    return joins.imported_session_users(t.users, t.searches).select("user_id")


@check("j08_searches_to_stores", """
SELECT h.search_id, s.store_id FROM v_searches h JOIN v_stores s ON s.name_he = h.top_result_name OR s.name_en = h.top_result_name""")
def _(t):
    return joins.searches_to_stores(t.searches, t.stores).select("search_id", "store_id")


@check("j10_explode_tool_calls", """
SELECT trace_id, tool_name AS name, tool_error AS error, result_count FROM v_traces""")
def _(t):
    return joins.explode_tool_calls(t.traced).select("trace_id", "name", "error", "result_count")


@check("t07_topn_reports", """
SELECT city_used, result_count, count(*) AS n FROM v_searches GROUP BY 1, 2 ORDER BY n DESC, city_used NULLS FIRST, result_count LIMIT 10""")
def _(t):
    return traffic.top_counts(t.searches, ["city_used", "result_count"], 10)


# Every table of the report: its name, the query whose SQL it must equal, labels and numbers.
REPORTS = {
    "searches_recent": ("a01_searches_recent", [], ["last_24h", "last_7d", "all_time"]),
    "active_users": ("a02_active_users", [], ["dau", "wau"]),
    "top_messages": ("a03_top_messages", ["message"], ["times_asked", "avg_results", "zero_result_count"]),
    "intent_breakdown": ("a04_intent_breakdown", ["intent"], ["hits", "avg_results", "zero_result_hits"]),
    "zero_result_queries": ("a05_zero_result_queries", ["message", "intent"], ["times"]),
    "returning_users": ("a06_returning_users", [], ["returning_users"]),
    "user_activity_bands": ("a07_user_activity_bands", [], ["one_search_users", "light_users", "regular_users", "heavy_users"]),
    "registration_conversion": ("a08_registration_conversion", [], ["imported_their_session", "new_users_7d"]),
    "category_pull": ("a09_category_pull", ["store_category"], ["unique_searchers", "appearances_in_results"]),
    "city_demand": ("a10_city_demand", ["city_used"], ["searches", "users"]),
    "intent_share": ("a11_intent_share", ["intent"], ["turns", "pct"]),
    "tool_success_rate": ("a12_tool_success_rate", ["tool_name"], ["calls", "successes", "success_pct"]),
    "latency_percentiles": ("a13_latency_percentiles", [], ["p50_latency_ms", "p95_latency_ms"]),
    "latency_by_intent": ("a13_latency_by_intent", ["intent"], ["p50_latency_ms", "p95_latency_ms"]),
    "sessions_with_results": ("a14_sessions_with_results", [], ["sessions", "sessions_with_results"]),
    "decision_signals": ("a15_decision_signals", ["signal"], ["value", "threshold"]),
}


def _report_sql():
    parts = []
    for name, (query, labels, numbers) in REPORTS.items():
        label = "concat_ws('|', " + ", ".join(f"coalesce(cast({c} AS varchar), '')" for c in labels) + ")" if labels else "''"
        for number in numbers:
            parts.append(f"SELECT '{name}' AS report, {label} AS label, '{number}' AS measure, round(cast({number} AS DOUBLE), 6) AS value FROM ({ORACLES[query]})")
    return " UNION ALL ".join(parts)


@check("c17_traffic_report", _report_sql())
def _(t):
    report = traffic.traffic_report(cut_lineage(t.searches), t.users, t.stores, cut_lineage(t.traced), clarify_intent="signup")
    out = None
    for name, (_, labels, numbers) in REPORTS.items():
        label = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in labels])
        values = F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in numbers]))
        rows = report[name].select(F.lit(name).alias("report"), label.alias("label"), values)
        out = rows if out is None else out.unionByName(rows)
    return out


@check("a16_last_runs", """
WITH c AS (SELECT store_id, count(*) AS n FROM v_listings GROUP BY store_id)
SELECT md5('store_products|' || store_id || '|2030-01-01 00:00:00') AS run_id, store_id, n AS items_scraped, store_id % 7 AS day FROM c ORDER BY day DESC, run_id DESC LIMIT 5""")
def _(t):
    from shelfspark.checks import ingest

    day = F.col("store_id") % 7
    runs = tables.scrape_run_rows(ingest.run_counts(t), ingest.as_of()).withColumn("started_at", F.dateadd(F.to_date(F.lit("2030-01-01")), day.cast("int")))
    return quality.last_runs(runs).select("run_id", "store_id", "items_scraped", day.alias("day"))


@check("c18_data_quality_gate", f"""
WITH p AS ({PRICE_AUDIT}), vals AS (
 SELECT 'suspect_price_pct' AS "check", suspect_pct AS value, 0.5::DOUBLE AS target FROM p
 UNION ALL SELECT 'median_age_days', quantile_cont(date_diff('day', updated_at, (SELECT max(updated_at) FROM v_listings)), 0.5)::DOUBLE, 14.0 FROM v_listings
 UNION ALL SELECT 'missing_brand_pct', round(100.0::DOUBLE * count(*) FILTER (WHERE coalesce(brand, '') = '') / count(*), 2), 3.0 FROM v_products
 UNION ALL SELECT 'image_pct', round(100.0::DOUBLE * count(nullif(image_url, '')) / count(*), 2), 60.0 FROM v_listings)
SELECT "check", value, target, CASE "check" WHEN 'median_age_days' THEN value <= target WHEN 'image_pct' THEN value > target ELSE value < target END AS passed FROM vals""")
def _(t):
    return quality.quality_gate(t.listings, t.products, t.stores)
