"""Evaluation of golden queries, user profiles and record expressions."""

from pyspark.sql import functions as F

from shelfspark.checks.registry import check
from shelfspark.functions import numbers, records, rules, text
from shelfspark.operators import joins
from shelfspark.plans import evaluation as ev
from shelfspark.plans import profiles
from shelfspark.streaming import jobs

# ---- evaluation -------------------------------------------------------------------


def golden(t):
    g = t.gold
    args = F.create_map(F.lit("brand"), F.lit('"x"'), F.lit("max_price"), F.lit("100"), F.lit("online"), F.lit("true"), F.lit("city"), F.lit('"N"'))
    call = F.struct(F.lit("search_products").alias("name"), records.typed_args(args).alias("args"))
    wanted = F.when(F.col("wanted_kind") == 2, F.array(call)).when(F.col("wanted_kind") == 1, F.filter(F.array(call), lambda c: F.lit(False)))
    return g.select(
        "id", "expected_intent", "expected_needs_location", "expected_has_results", "expected_brand", "expected_city", "expected_max_price", "notes",
        wanted.alias("expected_tool_calls"),
    )


def responses(t):
    g = t.gold.where("answered")
    call = lambda name, brand, price: F.struct(
        F.lit(name).alias("name"),
        records.typed_args(F.create_map(F.lit("brand"), F.lit(brand), F.lit("max_price"), F.lit(price), F.lit("online"), F.lit("true"), F.lit("city"), F.lit('"any"'))).alias("args"),
    )
    good, far, other = call("search_products", '"Xylo"', "103"), call("search_products", '"Xylo"', "120"), call("clarify", '"q"', "1")
    k = F.col("called_kind")
    calls = F.when(k == 0, F.filter(F.array(good), lambda c: F.lit(False))).when(k == 1, F.array(good)).when(k == 2, F.array(other, far)).otherwise(F.array(other, other, good))
    product = F.struct(F.lit("n").alias("canonical_name"), F.col("top_brand").alias("brand"), F.col("top_price").alias("price"), F.lit("c").alias("city"))
    second = F.struct(F.lit("n").alias("canonical_name"), F.lit("b").alias("brand"), F.lit(None).cast("double").alias("price"), F.lit("c").alias("city"))
    shown = F.slice(F.array(product, second), F.lit(1), F.col("products").cast("int"))
    stores = F.slice(F.array(F.struct(F.lit("s").alias("name"), F.col("top_city").alias("city"))), F.lit(1), F.col("stores").cast("int"))
    return g.select("id", "intent", "needs_location", "message", shown.alias("product_results"), stores.alias("store_results"), calls.alias("tool_calls"), "latency_ms", "error")


DIMS = """
g AS (SELECT *, CASE WHEN error IS NOT NULL THEN error WHEN NOT answered THEN 'no response' END AS failure, products + stores > 0 AS has FROM v_gold),
ok AS (SELECT * FROM g WHERE failure IS NULL),
dims AS (
 SELECT id, 'intent' AS dimension, intent = expected_intent AS passed FROM ok
 UNION ALL SELECT id, 'needs_location', needs_location = expected_needs_location FROM ok
 UNION ALL SELECT id, 'has_results', has = expected_has_results FROM ok
 UNION ALL SELECT id, 'brand_top_result', products > 0 AND contains(lower(top_brand), lower(expected_brand)) FROM ok WHERE expected_brand IS NOT NULL AND has
 UNION ALL SELECT id, 'city_top_result', stores > 0 AND contains(lower(top_city), lower(expected_city)) FROM ok WHERE expected_city IS NOT NULL AND has
 UNION ALL SELECT id, 'price_filter_respected', top_price <= expected_max_price * 1.05 FROM ok WHERE expected_max_price IS NOT NULL AND products > 0
 UNION ALL SELECT id, 'no_contradiction', NOT (has AND contains(message, 'no results found')) FROM ok
 UNION ALL SELECT id, 'empty_tool_calls', called_kind = 0 FROM ok WHERE wanted_kind = 1
 UNION ALL SELECT id, 'tool_call_match', called_kind IN (1, 3) FROM ok WHERE wanted_kind = 2
 UNION ALL SELECT id, 'no_extra_tool_calls', called_kind <> 3 FROM ok WHERE wanted_kind = 2),
scored AS (SELECT g.id, g.latency_ms, g.answered, g.failure, CASE event_id % 8 WHEN 0 THEN 'F-01' WHEN 1 THEN 'F-02/F-03' WHEN 2 THEN 'Sally' WHEN 3 THEN 'Edge' WHEN 4 THEN 'Help'
  WHEN 5 THEN 'English' WHEN 6 THEN 'Clarify' ELSE 'Other' END AS section, failure IS NULL AND NOT EXISTS (SELECT 1 FROM dims d WHERE d.id = g.id AND NOT d.passed) AS passed FROM g)"""


def scored(t):
    return ev.score(golden(t), responses(t))


@check("c13_search_quality_eval", f"WITH {DIMS} SELECT id, section, passed, failure AS error FROM scored")
def _(t):
    return scored(t).select("id", "section", "passed", "error")


@check("c13_dimensions", f"WITH {DIMS} SELECT id, dimension, passed FROM dims")
def _(t):
    return scored(t).select("id", F.inline("dimensions")).select("id", "dimension", "passed")


@check("c13_overall_rate", f"""WITH {DIMS} SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(failure) AS errors,
 round(100.0::DOUBLE * count(*) FILTER (WHERE passed) / count(*), 1) AS pass_pct FROM scored""")
def _(t):
    return ev.overall_rate(scored(t))


@check("a28_eval_pass_rates", f"""WITH {DIMS} SELECT dimension, count(*) AS total, count(*) FILTER (WHERE passed) AS passed, round(100.0::DOUBLE * count(*) FILTER (WHERE passed) / count(*), 1) AS pass_pct
FROM dims GROUP BY 1""")
def _(t):
    return ev.dimension_rates(scored(t))


@check("a28_section_rates", f"""WITH {DIMS} SELECT section, count(*) AS total, count(*) FILTER (WHERE passed) AS passed, round(100.0::DOUBLE * count(*) FILTER (WHERE passed) / count(*), 1) AS pass_pct
FROM scored GROUP BY 1""")
def _(t):
    return ev.section_rates(scored(t))


@check("a29_eval_latency", f"""WITH {DIMS}, r AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n FROM scored WHERE answered)
SELECT any_value(n) AS n, min(latency_ms) FILTER (WHERE i = n // 2) AS p50_ms, min(latency_ms) FILTER (WHERE i = cast(floor(n * 0.95::DOUBLE) AS BIGINT)) AS p95_ms, max(latency_ms) AS max_ms FROM r""")
def _(t):
    return ev.latency_report(scored(t))


@check("j16_golden_response_join", "SELECT id, CASE WHEN NOT answered THEN 'no response' ELSE error END AS error FROM v_gold")
def _(t):
    return joins.eval_join(golden(t), responses(t)).select("id", "error")


@check("x13_section_tag", f"WITH {DIMS} SELECT id, section FROM scored")
def _(t):
    return golden(t).select("id", text.section_tag(F.col("notes"), F.col("expected_intent")).alias("section"))


@check("x14_contains_any", "SELECT id, contains(message, 'no results found') AS contradicts FROM v_gold")
def _(t):
    return t.gold.select("id", text.contains_any(F.col("message"), rules.CONTRADICTION_PHRASES).alias("contradicts"))


@check("x14_asks_for_location", "SELECT trace_id, tool_name = 'clarify' AND trace_id % 2 = 0 AS asks FROM v_traces")
def _(t):
    question = F.when(F.col("trace_id") % 2 == 0, "share your location?").otherwise("which size?")
    call = F.struct(F.col("tool_name").alias("name"), F.create_map(F.lit("question"), question).alias("args"), F.lit(1).cast("bigint").alias("duration_ms"),
                    F.col("tool_error").alias("error"), F.col("result_count").alias("result_count"))
    return t.traces.select("trace_id", records.asks_for_location(F.array(call)).alias("asks"))


@check("x31_args_superset", """
SELECT event_id, (event_id % 3 = 0 OR event_id % 3 = 1) AND (event_id % 100 BETWEEN 38 AND 42) AND event_id % 2 = 0 AS met FROM events""")
def _(t):
    e = F.col("event_id")
    actual = F.create_map(
        F.lit("brand"), F.when(e % 3 == 0, '"Sony WH"').when(e % 3 == 1, '"my SONY"').otherwise('"Bose"'), F.lit("max_price"), (e % 100).cast("string"),
        F.lit("online"), F.when(e % 2 == 0, "true").otherwise("false"), F.lit("extra"), F.lit("1"))
    expected = F.create_map(F.lit("brand"), F.lit('"sony"'), F.lit("max_price"), F.lit("40"), F.lit("online"), F.lit("true"))
    return t.events.select("event_id", records.args_superset(records.typed_args(actual), records.typed_args(expected)).alias("met"))


@check("a31_precision_at_k", """
WITH r AS (SELECT product_id % 40 AS query_id, product_id AS item_id, row_number() OVER (PARTITION BY product_id % 40 ORDER BY product_id) AS rank FROM v_products),
q AS (SELECT query_id, count(*) FILTER (WHERE rank <= 10 AND item_id % 3 <> 0) / 10.0::DOUBLE AS p FROM r GROUP BY query_id)
SELECT count(*) AS queries, round(avg(p), 4) AS precision_at_k, round(avg(p), 4) >= 0.7 AS passed FROM q""")
def _(t):
    from shelfspark.operators.ranking import rank_within

    rows = rank_within(t.products.select((F.col("product_id") % 40).alias("query_id"), F.col("product_id").alias("item_id")), ["query_id"], [F.col("item_id")])
    return ev.precision_at_k(rows, rows.where("item_id % 3 <> 0").select("query_id", "item_id"))


# ---- profiles ---------------------------------------------------------------------------

PREFS = """
SELECT user_id, 'default_max_price' AS key, concat(cast(min(event_id) % 500 AS varchar(20)), '.5') AS value FROM events WHERE user_id % 3 <> 0 GROUP BY user_id
UNION ALL SELECT DISTINCT user_id, 'preferred_cities', CASE WHEN user_id % 4 = 0 THEN 'oops' WHEN user_id % 4 = 1 THEN '[]' ELSE concat('["", "City', cast(user_id AS varchar(20)), '", "Other"]') END
FROM events WHERE user_id % 2 = 0"""
ATTRS = """
SELECT user_id, CASE attribute WHEN 'view' THEN 'has_children' WHEN 'click' THEN 'child_age_range' WHEN 'purchase' THEN 'gender' WHEN 'signup' THEN 'price_sensitivity' ELSE 'lifestyle' END AS attribute,
 CASE attribute WHEN 'view' THEN CASE WHEN user_id % 2 = 0 THEN 'True' ELSE 'no' END WHEN 'click' THEN '6-9' WHEN 'purchase' THEN CASE WHEN user_id % 3 = 0 THEN 'female' ELSE 'male' END
   WHEN 'signup' THEN CASE WHEN user_id % 5 = 0 THEN 'premium' ELSE 'budget' END ELSE 'x' END AS value,
 round(((user_id + length(attribute)) % 11) * 0.1e0, 2) AS confidence, (user_id + length(attribute)) % 4 = 0 AS is_confirmed FROM v_attrs"""
STRIP = f"""
p AS ({PREFS}), a AS (SELECT * FROM ({ATTRS}) WHERE confidence > 0.5),
kept AS (SELECT * FROM a WHERE NOT (attribute = 'has_children' AND user_id IN (SELECT user_id FROM a WHERE attribute = 'child_age_range'))),
rows AS (
 SELECT user_id, 0 AS section, 0.0::DOUBLE AS w, '' AS tie, '💰' AS icon, '₪' || cast(cast(round_even(value::DOUBLE, 0) AS BIGINT) AS varchar) AS label FROM p WHERE key = 'default_max_price'
 UNION ALL SELECT user_id, 1, 0.0, '', '📍', 'City' || cast(user_id AS varchar) FROM p WHERE key = 'preferred_cities' AND contains(value, 'City')
 UNION ALL SELECT user_id, CASE WHEN is_confirmed THEN 2 ELSE 3 END, -confidence, attribute,
   CASE WHEN attribute IN ('has_children', 'child_age_range') THEN '👦' WHEN value = 'female' THEN '👗' WHEN value = 'male' THEN '👔' WHEN value = 'budget' THEN '💰' ELSE '💎' END,
   CASE attribute WHEN 'has_children' THEN 'ילדים' WHEN 'child_age_range' THEN 'ילד ' || value ELSE CASE value WHEN 'female' THEN 'קניות נשים' WHEN 'male' THEN 'קניות גברים' WHEN 'budget' THEN 'חסכוני' ELSE 'פרימיום' END END
  FROM kept WHERE attribute <> 'lifestyle' AND NOT (attribute = 'has_children' AND value = 'no'))"""


@check("c14_user_profile_strip", f"""WITH {STRIP}
SELECT user_id, rank, icon, label FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY section, w, tie) AS rank FROM rows) WHERE rank <= 6""")
def _(t):
    return profiles.profile_strip(t.sql(PREFS), t.sql(ATTRS)).select("user_id", "rank", "icon", "label")


CALLS = """
SELECT session_id, trace_id AS position, tool_name AS name, concat('C', cast(user_id AS varchar(20))) AS city, CASE WHEN trace_id % 3 = 0 THEN '' ELSE concat(cast(trace_id % 90 AS varchar(20)), '.7') END AS price FROM v_traces"""
FACTS = f"""
c AS ({CALLS}),
f AS (SELECT session_id, 'city' AS fact, position, city AS value FROM c WHERE name IN ('search_products', 'search_stores')
  UNION ALL SELECT session_id, 'max_price', position, price FROM c WHERE name = 'search_products' AND price <> ''),
facts AS (SELECT session_id, fact, arg_max(value, position) AS value FROM f GROUP BY 1, 2)"""


def facts(t):
    calls = t.sql(CALLS).withColumn("args", F.create_map(F.lit("city"), F.col("city"), F.lit("max_price"), F.col("price")))
    return profiles.derived_facts(calls)


@check("x30_derived_facts", f"WITH {FACTS} SELECT session_id, fact, value FROM facts")
def _(t):
    return facts(t)


@check("c14_session_strip", f"""WITH {FACTS}, r AS (SELECT session_id, 1 AS o, value AS label FROM facts WHERE fact = 'city'
 UNION ALL SELECT session_id, 2, '₪' || cast(cast(round_even(value::DOUBLE, 0) AS BIGINT) AS varchar) FROM facts WHERE fact = 'max_price')
SELECT session_id, label, row_number() OVER (PARTITION BY session_id ORDER BY o) AS rank FROM r""")
def _(t):
    return profiles.session_strip(facts(t)).select("session_id", "label", "rank")


# 'oops' is no list and gives no line, nor does a missing value.
@check("c15_context_text", f"""
WITH k AS (SELECT user_id, max(value) FILTER (WHERE key = 'default_max_price') AS price, max(value) FILTER (WHERE key = 'preferred_cities') AS cities FROM ({PREFS}) GROUP BY 1),
g AS (SELECT user_id, event_type AS city, count(*) AS n FROM events GROUP BY 1, 2),
c AS (SELECT user_id, string_agg(city, ', ' ORDER BY n DESC, city) AS cities FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, city) AS rn FROM g) WHERE rn <= 3 GROUP BY 1),
s AS (SELECT user_id, string_agg('  - ' || message || ' (' || strftime(searched_at, '%Y-%m-%d') || ')', chr(10) ORDER BY rn) AS recent
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY searched_at DESC, search_id DESC) AS rn FROM v_searches) WHERE rn <= 3 GROUP BY 1)
SELECT u.user_id, concat_ws(chr(10), '{rules.CONTEXT_HEAD}', '{rules.CONTEXT_BUDGET}' || k.price,
  CASE WHEN k.cities = '[]' THEN '{rules.CONTEXT_CITIES}' WHEN k.cities <> 'oops' THEN '{rules.CONTEXT_CITIES}' || ', City' || u.user_id || ', Other' END,
  '{rules.CONTEXT_SEARCHED_CITIES}' || c.cities, '{rules.CONTEXT_SEARCHES}' || chr(10) || s.recent, '{rules.CONTEXT_END}') AS context
FROM v_users u LEFT JOIN k ON k.user_id = u.user_id LEFT JOIN c ON c.user_id = u.user_id LEFT JOIN s ON s.user_id = u.user_id""")
def _(t):
    seen = t.events.select("user_id", F.lit("city_search").alias("signal_type"), F.col("event_type").alias("signal_value"), "ts")
    return profiles.context_text(t.users.select("user_id"), t.sql(PREFS), jobs.signals(seen), t.searches)


@check("c15_user_context", f"""
WITH p AS (SELECT user_id, max(value) FILTER (WHERE key = 'default_max_price') AS price FROM ({PREFS}) GROUP BY 1),
a AS (SELECT user_id, string_agg(attribute, ',' ORDER BY rn) AS attrs FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, attribute) AS rn FROM ({ATTRS}) WHERE confidence >= 0.5) WHERE rn <= 5 GROUP BY 1),
s AS (SELECT user_id, string_agg(message, ',' ORDER BY rn) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY searched_at DESC, search_id DESC) AS rn FROM v_searches) WHERE rn <= 3 GROUP BY 1),
v AS (SELECT user_id, count(*) AS cards FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT u.user_id, p.price, a.attrs, s.recent, coalesce(v.cards, 0) AS cards FROM v_users u LEFT JOIN p ON p.user_id = u.user_id LEFT JOIN a ON a.user_id = u.user_id LEFT JOIN s ON s.user_id = u.user_id
LEFT JOIN v ON v.user_id = u.user_id""")
def _(t):
    cards = t.events.select("user_id", F.col("event_id").alias("card_id"), F.lit("net").alias("voucher_network"), F.lit("n").alias("nickname"),
                            F.col("value").cast("decimal(10,2)").alias("balance"), F.to_date("ts").alias("expiry_date"), (F.col("event_id") % 3 == 0).alias("is_active"))
    context = profiles.user_context(t.users.select("user_id"), t.sql(PREFS), t.sql(ATTRS), cards, t.searches)
    shape = ("preferences map<string,string>, inferred_attributes array<struct<attribute:string>>, voucher_cards array<struct<network:string>>, recent_searches array<struct<message:string>>")
    c = F.from_json("context", shape)
    joined = lambda x: F.when(x.isNotNull(), F.array_join(x, ","))
    return context.select(
        "user_id", F.try_element_at(c.getField("preferences"), F.lit("default_max_price")).alias("price"), joined(c.getField("inferred_attributes").getField("attribute")).alias("attrs"),
        joined(c.getField("recent_searches").getField("message")).alias("recent"), F.greatest(F.coalesce(F.size(c.getField("voucher_cards")), F.lit(0)), F.lit(0)).cast("bigint").alias("cards"))


@check("c20_recall_previous", """
WITH r AS (SELECT session_id, CASE WHEN tool_name = 'search_stores' THEN 'store' ELSE 'product' END AS kind, trace_id, intent, row_number() OVER (PARTITION BY session_id, tool_name = 'search_stores' ORDER BY trace_id) AS rn FROM v_traces)
SELECT session_id, count(*) FILTER (WHERE kind = 'product') AS previous_product_count, count(*) FILTER (WHERE kind = 'store') AS previous_store_count,
 coalesce(string_agg(cast(trace_id AS varchar), ',' ORDER BY trace_id) FILTER (WHERE kind = 'product' AND rn <= 5), '') AS previous_products,
 coalesce(string_agg(cast(trace_id AS varchar), ',' ORDER BY trace_id) FILTER (WHERE kind = 'store' AND rn <= 5), '') AS previous_stores FROM r GROUP BY session_id""")
def _(t):
    rows = t.traces.select("session_id", F.when(F.col("tool_name") == "search_stores", "store").otherwise("product").alias("kind"), F.col("trace_id").alias("position"),
                           F.col("trace_id").cast("string").alias("name"))
    messages = t.traces.select("session_id").distinct().withColumn("last_user_message", F.lit("m"))
    out = profiles.recall_previous(rows, messages).drop("last_user_message")
    return out.withColumn("previous_products", F.array_join("previous_products", ",")).withColumn("previous_stores", F.array_join("previous_stores", ","))


# ---- record expressions --------------------------------------------------------------------


@check("x24_token_cost", """
SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN event_id * 0.075::DOUBLE / 1000000 + (event_id % 100) * 0.3::DOUBLE / 1000000
 ELSE greatest(1, event_id // 4) * 0.075::DOUBLE / 1000000 + greatest(1, (event_id % 9) // 4) * 0.3::DOUBLE / 1000000 END, 12) AS usd FROM events""")
def _(t):
    e = F.col("event_id")
    even = lambda c: F.when(e % 2 == 0, c)
    return t.events.select("event_id", F.round(numbers.token_cost(even(e), even(e % 100), e, e % 9), 12).alias("usd"))


@check("x25_clean_int_label", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'about ' || cast(event_id AS varchar) ELSE cast(cast(round_even(event_id + 0.5::DOUBLE, 0) AS BIGINT) AS varchar) END AS label FROM events""")
def _(t):
    e = F.col("event_id")
    typed = F.when(e % 5 == 0, F.concat(F.lit("about "), e.cast("string"))).otherwise(F.concat(e.cast("string"), F.lit(".5")))
    return t.events.select("event_id", numbers.clean_int_label(typed).alias("label"))


@check("x26_day_key", "SELECT cast(cast(ts AS date) AS varchar) AS day, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(records.day_key(F.col("ts")).cast("string").alias("day")).agg(F.count("*").alias("n"))


@check("x27_json_list_safe", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a' || cast(event_id AS varchar) || '|b' ELSE '' END AS items FROM events""")
def _(t):
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, F.concat(F.lit('["a'), e.cast("string"), F.lit('", "", null, "b"]'))).when(e % 4 == 1, "[").when(e % 4 == 2, "[]")
    return t.events.select("event_id", F.array_join(records.json_list(raw), "|").alias("items"))


@check("x29_infer_intent", """
SELECT trace_id, CASE WHEN trace_id % 10 = 0 THEN 'error' WHEN tool_name = 'clarify' THEN 'clarify' WHEN tool_name = 'search_products' AND tool_error IS NULL THEN 'product_search'
 WHEN tool_name = 'search_stores' THEN 'store_search' WHEN trace_id % 3 = 0 THEN 'clarify' ELSE 'help' END AS inferred FROM v_traces""")
def _(t):
    ended = F.when(F.col("trace_id") % 10 == 0, "safety_blocked").otherwise("content")
    message = F.when(F.col("trace_id") % 3 == 0, " hi ").otherwise("hello there")
    return t.traced.select("trace_id", records.infer_intent(ended, F.col("tool_calls"), message).alias("inferred"))


@check("st05_signals_batch_twin", """
SELECT user_id, event_type AS signal_value, count(*) AS count, round(1.0::DOUBLE + 0.1::DOUBLE * (count(*) - 1), 6) AS weight FROM events GROUP BY 1, 2""")
def _(t):
    events = t.events.select("user_id", F.lit("city_search").alias("signal_type"), F.col("event_type").alias("signal_value"), "ts")
    return profiles.signal_upsert(events).select("user_id", "signal_value", "count", "weight")


@check("st06_confirmed_attributes", """
SELECT user_id, attribute, user_id % 2 = 0 OR is_confirmed AS is_confirmed, CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE confidence END::DOUBLE AS confidence FROM v_attrs""")
def _(t):
    confirmed = t.attrs.where("user_id % 2 = 0").select("user_id", "attribute")
    return profiles.confirm_attributes(t.attrs, confirmed).select("user_id", "attribute", "is_confirmed", "confidence")
