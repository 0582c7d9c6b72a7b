"""Scoring of golden queries against recorded responses.

Golden rows: ``id, query, expected_intent, expected_needs_location,
expected_has_results, expected_brand, expected_city, expected_max_price,
expected_tool_calls array<struct<name,args>>, notes``. Response rows: ``id, intent,
needs_location, message, product_results, store_results, tool_calls, latency_ms,
error``. Argument maps are in the typed form of ``functions.records.typed_args``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import rules
from shelfspark.functions.records import args_superset
from shelfspark.functions.text import contains_any, section_tag
from shelfspark.operators.joins import eval_join
from shelfspark.operators.percentiles import exact_percentiles

PRICE_TOLERANCE = 1.05


def _holds(text: Column, part: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).contains(F.lower(part))


def _dimension(name: str, applied: Column, passed: Column) -> Column:
    return F.struct(
        F.lit(name).alias("dimension"),
        F.coalesce(applied, F.lit(False)).alias("applied"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def _dimensions(with_tools: bool) -> list[Column]:
    products, stores = F.col("product_results"), F.col("store_results")
    count = F.greatest(F.coalesce(F.size(products), F.lit(0)), F.lit(0)) + F.greatest(
        F.coalesce(F.size(stores), F.lit(0)), F.lit(0)
    )
    has = count > 0
    top_product, top_store = F.get(products, F.lit(0)), F.get(stores, F.lit(0))
    brand, city = F.col("expected_brand"), F.col("expected_city")
    too_dear = F.exists(
        products,
        lambda p: F.coalesce(p.getField("price") > F.col("expected_max_price") * PRICE_TOLERANCE, F.lit(False)),
    )
    rows = [
        _dimension("intent", F.lit(True), F.col("intent") == F.col("expected_intent")),
        _dimension("needs_location", F.lit(True), F.coalesce("needs_location", F.lit(False)) == F.col("expected_needs_location")),
        _dimension("has_results", F.lit(True), has == F.col("expected_has_results")),
        _dimension("brand_top_result", (brand != "") & has,
                   top_product.isNotNull() & _holds(top_product.getField("brand"), brand)),
        _dimension("city_top_result", (city != "") & has,
                   top_store.isNotNull() & _holds(top_store.getField("city"), city)),
        _dimension("price_filter_respected",
                   F.col("expected_max_price").isNotNull() & (F.coalesce(F.size(products), F.lit(0)) > 0), ~too_dear),
        _dimension("no_contradiction", F.lit(True), ~(has & contains_any(F.col("message"), rules.CONTRADICTION_PHRASES))),
    ]
    if with_tools:
        expected, actual = F.col("expected_tool_calls"), F.col("tool_calls")
        traced = expected.isNotNull() & actual.isNotNull()
        calls = F.size(actual)
        some = traced & (F.size(expected) > 0)
        matched = F.forall(
            expected,
            lambda e: F.exists(
                actual,
                lambda a: (a.getField("name") == e.getField("name")) & args_superset(a.getField("args"), e.getField("args")),
            ),
        )
        rows += [
            _dimension("empty_tool_calls", traced & (F.size(expected) == 0), calls == 0),
            _dimension("tool_call_match", some, matched),
            _dimension("no_extra_tool_calls", some, calls - F.size(expected) <= 1),
        ]
    return rows


def score(golden: DataFrame, responses: DataFrame, with_tools: bool = True) -> DataFrame:
    """One row per golden query: dimensions, overall pass, section, latency, error.

    A query passes when it has no error and every dimension that applies passes.
    """
    joined = eval_join(golden, responses)
    failed = F.col("error").isNotNull()
    dims = F.filter(F.array(*_dimensions(with_tools)), lambda d: d.getField("applied"))
    scored = joined.withColumn("dimensions", F.when(~failed, dims))
    passed = ~failed & (F.size("dimensions") > 0) & F.forall("dimensions", lambda d: d.getField("passed"))
    return scored.select(
        "id",
        section_tag(F.col("notes"), F.col("expected_intent")).alias("section"),
        "dimensions",
        F.coalesce(passed, F.lit(False)).alias("passed"),
        "latency_ms",
        "error",
    )


def _rate(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed")
    ).withColumn("pass_pct", F.round(100.0 * F.col("passed") / F.col("total"), 1))


def overall_rate(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count("error").alias("errors")
    ).withColumn("pass_pct", F.when(F.col("total") > 0, F.round(100.0 * F.col("passed") / F.col("total"), 1)).otherwise(0.0))


def dimension_rates(scored: DataFrame) -> DataFrame:
    """Pass rate per dimension over the queries it applies to."""
    return _rate(scored.select(F.inline("dimensions")), ["dimension"])


def section_rates(scored: DataFrame) -> DataFrame:
    return _rate(scored, ["section"])


def latency_report(scored: DataFrame) -> DataFrame:
    """p50 and p95 as picks of the sorted list, and the maximum."""
    picks = exact_percentiles(scored, [], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}, method="pick")
    return picks.withColumn("max_ms", scored.agg(F.max("latency_ms")).scalar())


def duplicate_ids(golden: DataFrame) -> DataFrame:
    """Golden ids used more than once: an error of the set."""
    return golden.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def precision_at_k(results: DataFrame, relevant: DataFrame, k: int = 10, gate: float = 0.7) -> DataFrame:
    """Mean share of relevant results among the first k; a query with no result scores 0.

    ``results``: ``query_id, rank, item_id``; ``relevant``: ``query_id, item_id``.
    """
    top = results.where(F.col("rank") <= k)
    hits = top.join(relevant.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_semi")
    per_query = hits.groupBy("query_id").agg((F.count("*") / k).alias("precision"))
    asked = relevant.select("query_id").union(results.select("query_id")).distinct()
    return (
        asked.join(per_query, "query_id", "left")
        .agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce("precision", F.lit(0.0))), 4).alias("precision_at_k"))
        .withColumn("passed", F.col("precision_at_k") >= gate)
    )
