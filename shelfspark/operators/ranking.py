"""First-row, top-k and paging operators.

All of them rank with ``row_number`` under a total order. Spark limits such
ranks before the shuffle (window group limit), so a hot key sends at most k rows
per task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage


def rank_within(df: DataFrame, keys: list, order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_n(df: DataFrame, keys: list, order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows per key, with their rank."""
    return rank_within(df, keys, order, name).where(F.col(name) <= n)


def rank_all(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Every row's rank within its key, without bringing a key's rows to one task.

    Rows are dealt by ranges of (key, order), so that a hot key fills many partitions, and
    written; what is ranked then is one row per key and partition, whose counts give the
    number of rows before it. ``order`` must be total for the result to be repeatable.
    """
    by = [F.col(k) for k in keys]
    dealt = cut_lineage(df).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = cut_lineage(dealt.withColumn("_rank_at", F.monotonically_increasing_id()))  # partition * 2^33 + row
    part = F.shiftright("_rank_at", 33)
    parts = placed.groupBy(*keys, part.alias("_rank_part")).agg(F.min("_rank_at").alias("_rank_first"), F.count("*").alias("_rank_n"))
    before = Window.partitionBy(*keys).orderBy("_rank_part").rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that its size is known: with few keys it is broadcast, and the rows are not shuffled again.
    parts = cut_lineage(parts.withColumn("_rank_before", F.coalesce(F.sum("_rank_n").over(before), F.lit(0))).drop("_rank_n"))
    same = F.col("d._rank_part") == F.col("p._rank_part")
    for key in keys:
        same &= F.col(f"d.{key}").eqNullSafe(F.col(f"p.{key}"))
    ranked = placed.withColumn("_rank_part", part).alias("d").join(parts.alias("p"), same)
    return ranked.select(*[F.col(f"d.{c}") for c in df.columns], (F.col("_rank_at") - F.col("_rank_first") + F.col("_rank_before") + 1).cast("int").alias(name))


def first_per_key(df: DataFrame, keys: list[str], order: list[str], descending: bool = False) -> DataFrame:
    """One row per key: the lowest (or highest) by ``order``, then by its other values that Spark can order.

    An aggregate of structs, so every task sends one row per key.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = [f.name for f in df.schema if f.name in rest and f.name not in order and not re.search("map<|variant", f.dataType.simpleString())]
    if set(rest) <= {*order, *ordered}:
        # The least (or greatest) row holds everything; ``min_by`` would carry it twice through the shuffle.
        row = (F.max if descending else F.min)(F.struct(*order, *ordered)).alias("_row")
    else:
        row = (F.max_by if descending else F.min_by)(F.struct(*rest), F.struct(*order, *ordered)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def one_per_product_store(listings: DataFrame) -> DataFrame:
    """One listing per (product, store): the lowest listing id."""
    return first_per_key(listings, ["product_id", "store_id"], ["listing_id"])


def last_turn_per_session(traces: DataFrame) -> DataFrame:
    return first_per_key(traces, ["session_id"], ["created_at", "trace_id"], descending=True)


def latest_run_per_store(runs: DataFrame) -> DataFrame:
    """Newest finished run per store; runs that never finished come last."""
    order = [F.col("finished_at").desc_nulls_last(), F.col("run_id").desc()]
    return top_n(runs, ["store_id"], order, 1).drop("rank")


def keep_first(df: DataFrame, keys: list[str], position: str, cap: int | None = None, group: list[str] | None = None):
    """Keep the first row per key in arrival order; optionally only the first ``cap`` of each group."""
    group = group or []
    kept = first_per_key(df, [*group, *keys], [position])
    if cap is None:
        return kept
    if not group:
        return kept.orderBy(position).limit(cap)
    return top_n(kept, group, [F.col(position)], cap).drop("rank")


def merge_recent(current: DataFrame, incoming: DataFrame, cap: int = 20) -> DataFrame:
    """Recent-items list: an item already there keeps its time, newest first, at most ``cap`` per owner.

    Both sides have ``owner, item_type, item_id, added_at, position``.
    """
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    kept = first_per_key(both, ["owner", "item_type", "item_id"], ["_new", "position"])
    order = [F.col("added_at").desc(), F.col("_new"), F.col("position")]
    return top_n(kept, ["owner"], order, cap).drop("_new")


def paginate(df: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of a single ranked list (page 1 is the first)."""
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def page_of(df: DataFrame, page: Column | int = 1, page_size: Column | int = 20, rank: str = "rank") -> DataFrame:
    """One page per query of a ranked batch."""
    page = page if isinstance(page, Column) else F.lit(page)
    size = page_size if isinstance(page_size, Column) else F.lit(page_size)
    return df.where((F.col(rank) > (page - 1) * size) & (F.col(rank) <= page * size))


def brand_tier(brand: Column, wanted: Column) -> Column:
    """0 when the brand holds the wanted text, 1 for another brand, 2 for none; 0 for all when nothing is wanted."""
    needle = F.lower(F.trim(wanted))
    have = F.lower(F.coalesce(brand, F.lit("")))
    return (
        F.when(F.coalesce(needle, F.lit("")) == "", 0).when(have == "", 2).when(have.contains(needle), 0).otherwise(1)
    )


def rerank_by_brand(ranked: DataFrame, wanted: Column, keys: list[str] | None = None) -> DataFrame:
    """Stable re-rank of each list by brand tier."""
    tiered = ranked.withColumn("brand_tier", brand_tier(F.col("brand"), wanted)).withColumnRenamed("rank", "_before")
    return rank_within(tiered, keys or ["query_id"], [F.col("brand_tier"), F.col("_before")]).drop("_before")


def online_then_limit(ranked: DataFrame, online_only: Column, limit: Column, keys: list[str] | None = None):
    """Drop offline rows where asked, and only then cut each list."""
    kept = ranked.where(~online_only | F.col("is_online")).withColumnRenamed("rank", "_before")
    return rank_within(kept, keys or ["query_id"], [F.col("_before")]).drop("_before").where(F.col("rank") <= limit)


def stratified_sample(df: DataFrame, stratum: str, key: str, total: int) -> DataFrame:
    """About ``total`` rows spread evenly over the strata, chosen by hash order (same rows every run).

    The per-stratum share comes from the number of strata.
    """
    strata = df.agg(F.count_distinct(F.coalesce(F.col(stratum).cast("string"), F.lit("")))).scalar()
    share = F.ceil(F.lit(total) / strata)
    order = [F.md5(F.col(key).cast("string")), F.col(key)]
    # The constant bound lets Spark limit each stratum before the shuffle.
    return rank_within(df, [stratum], order).where((F.col("rank") <= total) & (F.col("rank") <= share))
