"""Reports on searches, users and agent traces.

``as_of`` stands for "now" and is the newest timestamp of the input by default. It is
an uncorrelated scalar subquery, so no value travels through the driver program.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.filters import as_column
from shelfspark.operators.joins import explode_tool_calls, imported_session_users, searches_to_stores
from shelfspark.operators.percentiles import exact_percentiles
from shelfspark.operators.ranking import last_turn_per_session


def newest(df: DataFrame, ts: str) -> Column:
    return df.agg(F.max(ts)).scalar()


def _as_of(df: DataFrame, ts: str, as_of) -> Column:
    return newest(df, ts) if as_of is None else as_column(as_of)


def within(df: DataFrame, ts: str, span: str, as_of=None, inclusive: bool = False) -> DataFrame:
    """Rows younger than the span before ``as_of``."""
    start = _as_of(df, ts, as_of) - F.expr(f"INTERVAL {span}")
    return df.where(F.col(ts) >= start if inclusive else F.col(ts) > start)


def searches_recent(searches: DataFrame, as_of=None) -> DataFrame:
    now = _as_of(searches, "searched_at", as_of)
    return searches.withColumn("_now", now).agg(
        F.count_if(F.col("searched_at") > F.col("_now") - F.expr("INTERVAL 24 HOURS")).alias("last_24h"),
        F.count_if(F.col("searched_at") > F.col("_now") - F.expr("INTERVAL 7 DAYS")).alias("last_7d"),
        F.count("*").alias("all_time"),
    )


def active_users(searches: DataFrame, as_of=None) -> DataFrame:
    """Distinct users of the last day and week.

    One row per user with the last visit first; the two counts read that.
    """
    last = searches.groupBy("user_id").agg(F.max("searched_at").alias("seen"))
    now = _as_of(searches, "searched_at", as_of)
    return last.withColumn("_now", now).agg(
        F.count_if(F.col("seen") > F.col("_now") - F.expr("INTERVAL 24 HOURS")).alias("dau"),
        F.count_if(F.col("seen") > F.col("_now") - F.expr("INTERVAL 7 DAYS")).alias("wau"),
    )


def _zero() -> Column:
    return F.count_if(F.col("result_count") == 0)


def top_messages(searches: DataFrame, as_of=None, n: int = 30) -> DataFrame:
    return (
        within(searches, "searched_at", "7 DAYS", as_of)
        .groupBy("message")
        .agg(
            F.count("*").alias("times_asked"),
            F.round(F.avg("result_count")).cast("int").alias("avg_results"),
            _zero().alias("zero_result_count"),
        )
        .orderBy(F.desc("times_asked"), "message")
        .limit(n)
    )


def intent_breakdown(searches: DataFrame, as_of=None) -> DataFrame:
    return (
        within(searches, "searched_at", "7 DAYS", as_of)
        .groupBy("intent")
        .agg(F.count("*").alias("hits"), F.round(F.avg("result_count"), 1).alias("avg_results"),
             _zero().alias("zero_result_hits"))
    )


def top_counts(rows: DataFrame, by: list[str], n: int, name: str = "n", *more: Column) -> DataFrame:
    """The ``n`` most frequent groups with their counts, ties in the order of ``by`` (NULL first); ``more`` are further aggregates."""
    counted = rows.groupBy(*by).agg(F.count("*").alias(name), *more)
    return counted.orderBy(F.desc(name), *[F.asc_nulls_first(c) for c in by]).limit(n)


def zero_result_queries(searches: DataFrame, as_of=None, n: int = 20) -> DataFrame:
    return top_counts(within(searches, "searched_at", "7 DAYS", as_of).where("result_count = 0"), ["message", "intent"], n, "times")


def returning_users(searches: DataFrame, as_of=None) -> DataFrame:
    """Users seen on two days or more: first and last day differ."""
    days = within(searches, "searched_at", "7 DAYS", as_of).groupBy("user_id").agg(
        F.min(F.to_date("searched_at")).alias("first_day"), F.max(F.to_date("searched_at")).alias("last_day")
    )
    return days.agg(F.count_if(F.col("first_day") < F.col("last_day")).alias("returning_users"))


def user_activity_bands(searches: DataFrame, as_of=None) -> DataFrame:
    per_user = within(searches, "searched_at", "7 DAYS", as_of).groupBy("user_id").agg(F.count("*").alias("n"))
    return per_user.agg(
        F.count_if(F.expr("n = 1")).alias("one_search_users"),
        F.count_if(F.expr("n BETWEEN 2 AND 5")).alias("light_users"),
        F.count_if(F.expr("n BETWEEN 6 AND 20")).alias("regular_users"),
        F.count_if(F.expr("n > 20")).alias("heavy_users"),
    )


def registration_conversion(users: DataFrame, searches: DataFrame, as_of=None) -> DataFrame:
    recent = within(users, "created_at", "7 DAYS", as_of)
    brought = imported_session_users(recent, searches).select("user_id", F.lit(1).alias("_hit"))
    return recent.join(brought, "user_id", "left").agg(
        F.count("_hit").alias("imported_their_session"), F.count("*").alias("new_users_7d")
    )


def category_pull(searches: DataFrame, stores: DataFrame, as_of=None) -> DataFrame:
    seen = searches_to_stores(within(searches, "searched_at", "7 DAYS", as_of), stores)
    return seen.groupBy("store_category").agg(
        F.count_distinct("user_id").alias("unique_searchers"), F.count("*").alias("appearances_in_results")
    )


def city_demand(searches: DataFrame, as_of=None, n: int = 15) -> DataFrame:
    known = within(searches, "searched_at", "7 DAYS", as_of).where("city_used IS NOT NULL")
    return top_counts(known, ["city_used"], n, "searches", F.count_distinct("user_id").alias("users"))


def zero_result_pairs(searches: DataFrame, stores: DataFrame, as_of=None, n: int = 20) -> DataFrame:
    """(category, city) pairs of searches without results, most frequent first."""
    seen = searches_to_stores(within(searches, "searched_at", "7 DAYS", as_of).where("result_count = 0"), stores)
    return top_counts(seen.where("city_used IS NOT NULL"), ["store_category", "city_used"], n, "times")


def share_of_total(counts: DataFrame, count: str = "turns", name: str = "pct", digits: int = 2) -> DataFrame:
    """Percent of the grand total per row; the total is a scalar subquery, not a window over everything."""
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(name, F.round(F.col(count) * 100.0 / total, digits))


def intent_share(traces: DataFrame, as_of=None) -> DataFrame:
    recent = within(traces, "created_at", "7 DAYS", as_of, inclusive=True)
    return share_of_total(recent.groupBy("intent").agg(F.count("*").alias("turns")))


def tool_success_rate(traces: DataFrame, as_of=None) -> DataFrame:
    calls = explode_tool_calls(within(traces, "created_at", "7 DAYS", as_of, inclusive=True).select("tool_calls"))
    return (
        calls.groupBy(F.col("name").alias("tool_name"))
        .agg(F.count("*").alias("calls"), F.count_if(F.col("error").isNull()).alias("successes"))
        .withColumn("success_pct", F.round(100.0 * F.col("successes") / F.col("calls"), 1))
    )


def latency_percentiles(traces: DataFrame, by: list[str] | None = None, as_of=None) -> DataFrame:
    recent = within(traces, "created_at", "7 DAYS", as_of, inclusive=True)
    return exact_percentiles(
        recent, by or [], "total_latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}
    )


def sessions_with_results(traces: DataFrame, as_of=None) -> DataFrame:
    """Sessions whose last turn had a search tool with results."""
    recent = within(traces, "created_at", "7 DAYS", as_of, inclusive=True)
    last = last_turn_per_session(recent.select("session_id", "created_at", "trace_id", "tool_calls"))
    found = F.exists(
        "tool_calls",
        lambda c: c.getField("name").isin("search_products", "search_stores")
        & (F.coalesce(c.getField("result_count"), F.lit(0)) > 0),
    )
    return last.agg(F.count("*").alias("sessions"), F.count_if(found).alias("sessions_with_results"))


def decision_signals(searches: DataFrame, users: DataFrame, as_of=None, clarify_intent: str = "clarify") -> DataFrame:
    """The weekly rule table: ``signal, value, threshold, fired`` from one pass per source."""
    week = within(searches, "searched_at", "7 DAYS", as_of)
    base = week.agg(
        F.count("*").cast("double").alias("searches"),
        (100.0 * F.count_if(F.col("intent") == clarify_intent) / F.greatest(F.count("*"), F.lit(1))).alias("clarify"),
        (100.0 * _zero() / F.greatest(F.count("*"), F.lit(1))).alias("zero"),
    )
    returning = returning_users(searches, as_of).select(F.col("returning_users").cast("double"))
    bands = user_activity_bands(searches, as_of).select(F.col("heavy_users").cast("double"))
    share = registration_conversion(users, searches, as_of).select(
        F.col("imported_their_session") / F.greatest("new_users_7d", F.lit(1))
    )
    table = base.withColumn("returning", returning.scalar()).withColumn("heavy", bands.scalar()).withColumn(
        "share", share.scalar()
    )
    rules = [
        ("few_searches", "searches", "<", 20.0), ("clarify_share", "clarify", ">", 20.0),
        ("zero_result_share", "zero", ">", 30.0), ("returning_users", "returning", ">", 5.0),
        ("imported_session_share", "share", "<", 0.3), ("heavy_users", "heavy", ">=", 1.0),
    ]
    rows = []
    for name, column, sign, limit in rules:
        value = F.col(column)
        fired = {"<": value < limit, ">": value > limit, ">=": value >= limit}[sign]
        rows.append(F.struct(F.lit(name).alias("signal"), F.round(value, 4).alias("value"),
                             F.lit(limit).alias("threshold"), fired.alias("fired")))
    return table.select(F.inline(F.array(*rows)))


def cost_by_day(traces: DataFrame, budget_usd: float = 20.0) -> DataFrame:
    """Cost per UTC day (only positive costs), percent of the budget, over budget at the limit."""
    pct = F.round(F.col("cost_usd") / budget_usd * 100, 2) if budget_usd > 0 else F.lit(0.0)
    return (
        traces.where("total_cost_usd > 0")
        .groupBy(F.to_date("created_at").alias("day"))
        .agg(F.sum("total_cost_usd").cast("double").alias("cost_usd"))
        .withColumn("pct_used", pct)
        .withColumn("over_budget", F.col("cost_usd") >= budget_usd)
    )


def cost_cap_key(session_id: Column, client_host: Column) -> Column:
    """The session, else the client's address, else one shared key."""
    host = F.coalesce(F.nullif(client_host, F.lit("")), F.lit("unknown"))
    return F.coalesce(F.nullif(session_id, F.lit("")), F.concat(F.lit("ip:"), host))


def session_cost(traces: DataFrame, budget_usd: float = 0.5) -> DataFrame:
    """Cost per cap key; ``traces`` has ``session_id, client_host, total_cost_usd``."""
    return (
        traces.where("total_cost_usd > 0")
        .groupBy(cost_cap_key(F.col("session_id"), F.col("client_host")).alias("cap_key"))
        .agg(F.sum("total_cost_usd").cast("double").alias("cost_usd"))
        .withColumn("over_budget", F.col("cost_usd") >= budget_usd)
    )


def price_changes_recent(changes: DataFrame, as_of=None, span: str = "24 HOURS") -> DataFrame:
    return within(changes, "detected_at", span, as_of).agg(F.count("*").alias("changes"))


def run_totals(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of the scrape runs."""
    return runs.groupBy(*(by or [])).agg(
        F.count_if(F.col("status") != "failed").alias("stores_scraped"),
        F.count_if(F.col("status") == "failed").alias("stores_failed"),
        F.sum("items_scraped").alias("total_products"),
        F.sum("items_new").alias("items_new"),
        F.sum("items_updated").alias("items_updated"),
    )


def traffic_report(
    searches: DataFrame, users: DataFrame, stores: DataFrame, traces: DataFrame, as_of=None, clarify_intent: str = "clarify"
) -> dict:
    """All report tables by name."""
    return {
        "searches_recent": searches_recent(searches, as_of),
        "active_users": active_users(searches, as_of),
        "top_messages": top_messages(searches, as_of),
        "intent_breakdown": intent_breakdown(searches, as_of),
        "zero_result_queries": zero_result_queries(searches, as_of),
        "returning_users": returning_users(searches, as_of),
        "user_activity_bands": user_activity_bands(searches, as_of),
        "registration_conversion": registration_conversion(users, searches, as_of),
        "category_pull": category_pull(searches, stores, as_of),
        "city_demand": city_demand(searches, as_of),
        "intent_share": intent_share(traces, as_of),
        "tool_success_rate": tool_success_rate(traces, as_of),
        "latency_percentiles": latency_percentiles(traces, as_of=as_of),
        "latency_by_intent": latency_percentiles(traces, ["intent"], as_of),
        "sessions_with_results": sessions_with_results(traces, as_of),
        "decision_signals": decision_signals(searches, users, as_of, clarify_intent),
    }
