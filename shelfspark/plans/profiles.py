"""User profiles, session facts and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import rules
from shelfspark.functions.numbers import clean_int_label
from shelfspark.functions.records import json_list
from shelfspark.operators.filters import confident
from shelfspark.operators.ranking import rank_within, top_n

STRIP_ROWS = 6


def derived_facts(tool_calls: DataFrame) -> DataFrame:
    """Facts of each session from tool arguments; the latest turn and call wins, blanks are skipped.

    ``tool_calls`` has one row per call: ``session_id, position, name, args`` (``position``
    orders turns and calls; rule order settles one call that sets a fact twice).
    """
    rules_in_order = []
    for order, (tool, argument, fact) in enumerate(rules.FACT_RULES):
        value = F.when(F.col("name") == tool, F.try_element_at("args", F.lit(argument)))
        rules_in_order.append(F.struct(F.lit(order).alias("rule"), F.lit(fact).alias("fact"), value.alias("value")))
    rows = tool_calls.select("session_id", "position", F.inline(F.array(*rules_in_order))).where("value <> ''")
    return rows.groupBy("session_id", "fact").agg(F.max_by("value", F.struct("position", "rule")).alias("value"))


def preference_strip(preferences: DataFrame) -> DataFrame:
    """Strip rows of stored preferences: budget first, then the first preferred city."""
    price = (F.col("key") == "default_max_price") & (F.col("value") != "")
    city = F.get(json_list(F.when(F.col("key") == "preferred_cities", F.col("value"))), F.lit(0))
    budget = preferences.where(price).select(
        "user_id", F.lit(0).alias("section"), F.lit(0.0).alias("weight"), F.lit("").alias("tie"),
        F.lit(rules.PROFILE_PRICE_ICON).alias("icon"),
        F.concat(F.lit(rules.PROFILE_PRICE_PREFIX), clean_int_label(F.col("value"))).alias("label"),
        F.lit("preference").alias("kind"), F.lit(False).alias("confirmed"),
    )
    place = preferences.where(F.col("key") == "preferred_cities").withColumn("_city", city).where("_city IS NOT NULL")
    place = place.select(
        "user_id", F.lit(1).alias("section"), F.lit(0.0).alias("weight"), F.lit("").alias("tie"),
        F.lit(rules.PROFILE_CITY_ICON).alias("icon"), F.col("_city").alias("label"),
        F.lit("preference").alias("kind"), F.lit(False).alias("confirmed"),
    )
    return budget.unionByName(place)


def attribute_strip(attributes: DataFrame) -> DataFrame:
    """Strip rows of inferred attributes: confirmed first, then by confidence; attributes without a label are left out.

    Where the child's age is known, the general child row is dropped.
    """
    sure = confident(attributes, 0.5, strict=True)
    aged = sure.where("attribute = 'child_age_range'").select("user_id", F.lit(True).alias("_aged")).distinct()
    sure = sure.join(aged, "user_id", "left").where("NOT (attribute = 'has_children' AND coalesce(_aged, false))")
    icon, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    value = F.col("value").cast("string")
    for name, wanted, icon_text, label_text in rules.PROFILE_LABELS:
        compared = F.lower(value) if name == "has_children" else value
        hit = (F.col("attribute") == name) & (compared == wanted)
        icon, label = F.when(hit, icon_text).otherwise(icon), F.when(hit, label_text).otherwise(label)
    child = F.col("attribute") == "child_age_range"
    icon = F.when(child, rules.PROFILE_CHILD_ICON).otherwise(icon)
    label = F.when(child, F.concat(F.lit(rules.PROFILE_CHILD_PREFIX), value)).otherwise(label)
    return sure.select(
        "user_id",
        F.when(F.col("is_confirmed"), 2).otherwise(3).alias("section"),
        (-F.col("confidence")).alias("weight"),
        F.col("attribute").alias("tie"),
        icon.alias("icon"), label.alias("label"), F.lit("inferred").alias("kind"),
        F.col("is_confirmed").alias("confirmed"),
    ).where("label IS NOT NULL")


def profile_strip(preferences: DataFrame, attributes: DataFrame, rows: int = STRIP_ROWS) -> DataFrame:
    """At most six rows per user: preferences, confirmed attributes, then by confidence."""
    both = preference_strip(preferences).unionByName(attribute_strip(attributes))
    order = [F.col("section"), F.col("weight"), F.col("tie")]
    return top_n(both, ["user_id"], order, rows).select("user_id", "rank", "icon", "label", "kind", "confirmed")


def session_strip(facts: DataFrame) -> DataFrame:
    """Strip rows of a session without a user: city, then budget."""
    city = facts.where("fact = 'city'").select(
        "session_id", F.lit(1).alias("rank"), F.lit(rules.PROFILE_CITY_ICON).alias("icon"), F.col("value").alias("label")
    )
    price = facts.where("fact = 'max_price'").select(
        "session_id", F.lit(2).alias("rank"), F.lit(rules.PROFILE_PRICE_ICON).alias("icon"),
        F.concat(F.lit(rules.PROFILE_PRICE_PREFIX), clean_int_label(F.col("value"))).alias("label"),
    )
    both = city.unionByName(price).withColumnRenamed("rank", "_order")
    return rank_within(both, ["session_id"], [F.col("_order")]).drop("_order")


def _listed(df: DataFrame, order: list[Column], n: int, fields: list, name: str) -> DataFrame:
    """The first n rows per user as one array (n is small and fixed)."""
    rows = top_n(df, ["user_id"], order, n)
    packed = F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("v"))))
    return rows.groupBy("user_id").agg(F.transform(packed, lambda r: r.getField("v")).alias(name))


def latest_n_per_user(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return top_n(df, ["user_id"], order, n)


def user_context(
    users: DataFrame, preferences: DataFrame, attributes: DataFrame, cards: DataFrame, searches: DataFrame
) -> DataFrame:
    """One JSON per user: preferences, five surest attributes, active cards, three latest searches.

    Preference keys are a small fixed set; cards are listed by id.
    """
    wanted = preferences.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", "value")))).alias("preferences"))
    sure = confident(attributes, 0.5).withColumn("confidence", F.round("confidence", 2))
    surest = _listed(sure, [F.desc("confidence"), F.col("attribute")], 5, ["attribute", "value", "confidence"],
                     "inferred_attributes")
    card = F.struct(
        F.col("voucher_network").alias("network"), "nickname", F.col("balance").cast("double").alias("balance"),
        F.col("expiry_date").cast("string").alias("expiry"),
    )
    packed = F.array_sort(F.collect_list(F.struct("card_id", card.alias("v"))))
    held = cards.where("is_active").groupBy("user_id").agg(
        F.transform(packed, lambda c: c.getField("v")).alias("voucher_cards")
    )
    recent = _listed(
        searches, [F.desc("searched_at"), F.desc("search_id")], 3,
        ["message", "intent", F.col("top_result_name").alias("top_result")], "recent_searches",
    )
    wide = users
    for part in (wanted, surest, held, recent):
        wide = wide.join(part, "user_id", "left")
    body = F.to_json(F.struct("preferences", "inferred_attributes", "voucher_cards", "recent_searches"))
    return wide.select("user_id", body.alias("context"))


def context_text(users: DataFrame, preferences: DataFrame, signals: DataFrame, searches: DataFrame) -> DataFrame:
    """``user_id, context``: a user's context as text lines.

    Budget, preferred cities and categories come from ``preferences`` (``user_id, key,
    value``, lists as JSON; what is no list is left out), the three strongest city searches
    from ``signals`` (``user_id, signal_type, signal_value, weight``), and the last three
    searches with their day from ``searches``. Lines without content are left out.
    """
    pick = lambda key: F.max(F.when(F.col("key") == key, F.nullif("value", F.lit("")))).alias(key)
    keys = ("default_max_price", "preferred_cities", "preferred_categories")
    wide = preferences.where(F.col("key").isin(*keys)).groupBy("user_id").agg(*[pick(k) for k in keys])
    cities = top_n(signals.where("signal_type = 'city_search'"), ["user_id"], [F.desc("weight"), F.col("signal_value")], 3)
    recent = latest_n_per_user(searches, [F.desc("searched_at"), F.desc("search_id")], 3)
    line = F.concat(F.lit("  - "), F.coalesce("message", F.lit("")), F.lit(" ("), F.coalesce(F.date_format("searched_at", "yyyy-MM-dd"), F.lit("")), F.lit(")"))
    packed = lambda rows, value, name: rows.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", value.alias("v")))), lambda r: r["v"]).alias(name)
    )
    for part in (wide, packed(cities, F.col("signal_value"), "_cities"), packed(recent, line, "_recent")):
        users = users.join(part, "user_id", "left")
    listed = lambda head, key: F.concat(F.lit(head), F.array_join(F.from_json(key, "array<string>"), ", "))
    lines = F.array(
        F.lit(rules.CONTEXT_HEAD), F.concat(F.lit(rules.CONTEXT_BUDGET), F.col("default_max_price")),
        listed(rules.CONTEXT_CITIES, "preferred_cities"), listed(rules.CONTEXT_CATEGORIES, "preferred_categories"),
        F.concat(F.lit(rules.CONTEXT_SEARCHED_CITIES), F.array_join("_cities", ", ")),
        F.concat(F.lit(rules.CONTEXT_SEARCHES + "\n"), F.array_join("_recent", "\n")), F.lit(rules.CONTEXT_END),
    )
    return users.select("user_id", F.array_join(F.array_compact(lines), "\n").alias("context"))


def recall_previous(results: DataFrame, messages: DataFrame, shown: int = 5) -> DataFrame:
    """Per session the counts of the previous result list and its first five names.

    ``results``: ``session_id, kind ('product'|'store'), position, name``; ``messages``:
    ``session_id, last_user_message``. Sessions without results give no row.
    """
    counts = results.groupBy("session_id").agg(
        F.count_if(F.expr("kind = 'product'")).alias("previous_product_count"),
        F.count_if(F.expr("kind = 'store'")).alias("previous_store_count"),
    )
    top = top_n(results, ["session_id", "kind"], [F.col("position")], shown)
    names = lambda kind: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "name")))), lambda r: r.getField("name")
    )
    listed = top.groupBy("session_id").agg(
        names("product").alias("previous_products"), names("store").alias("previous_stores")
    )
    return counts.join(listed, "session_id").join(messages, "session_id", "left").withColumn(
        "last_user_message", F.coalesce("last_user_message", F.lit(""))
    )


def signal_upsert(events: DataFrame) -> DataFrame:
    """Implicit signals: weight 1.0 at first, 0.1 more per repeat; count and last time."""
    grouped = events.groupBy("user_id", "signal_type", "signal_value").agg(
        F.count("*").alias("count"), F.max("ts").alias("last_seen")
    )
    return grouped.withColumn("weight", F.round(F.lit(1.0) + F.lit(0.1) * (F.col("count") - 1), 6))


SCALAR_CONFIDENCE, LIST_CONFIDENCE = 0.7, 0.65
_LISTS = ["lifestyle", "occasions", "interests"]


def attribute_rows(events: DataFrame) -> DataFrame:
    """Attribute statements fit to be stored: NULLs and empty lists dropped, source cut at 200 characters."""
    listed = F.col("attribute").isin(_LISTS)
    usable = F.coalesce(F.col("value"), F.lit("")) != ""
    return events.where(usable & ~(listed & (F.col("value") == "[]"))).select(
        "user_id", "attribute", "value", "ts",
        F.when(listed, F.lit(LIST_CONFIDENCE)).otherwise(F.lit(SCALAR_CONFIDENCE)).alias("confidence"),
        F.substring("source", 1, 200).alias("source"),
    )


def attribute_upsert(events: DataFrame) -> DataFrame:
    """Latest statement per (user, attribute)."""
    latest = F.max_by(F.struct("value", "confidence", "source"), F.struct("ts", "value")).alias("v")
    return attribute_rows(events).groupBy("user_id", "attribute").agg(latest, F.max("ts").alias("last_updated")).select(
        "user_id", "attribute", "v.*", "last_updated"
    )


def confirm_attributes(attributes: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Confirmed (user, attribute) pairs become certain."""
    hit = confirmed.select("user_id", "attribute", F.lit(True).alias("_hit"))
    return (
        attributes.join(hit, ["user_id", "attribute"], "left")
        .withColumn("is_confirmed", F.coalesce("_hit", "is_confirmed"))
        .withColumn("confidence", F.when(F.col("_hit"), F.lit(1.0)).otherwise(F.col("confidence")))
        .drop("_hit")
    )
