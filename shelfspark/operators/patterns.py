"""Equi-joins that find ILIKE matches and points within a radius for whole batches.

A pattern is looked up by the rarest short piece of its literal runs: posting lists of the
texts' pieces are counted, the piece of a pattern with the shortest list meets the texts in a
hash join, and ``ilike`` decides. Long lists are dealt over several tasks. A radius is looked
up in a grid whose cell size fits it. Neither loops over all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage

GRAM = 3
LIST_ROWS = 100_000


def pieces(text: Column) -> Column:
    """Distinct lower-cased substrings of 0 to 3 characters."""
    lowered = F.lower(text)

    def of_size(n: int) -> Column:
        starts = F.when(F.length(lowered) >= n, F.sequence(F.lit(1), F.length(lowered) - (n - 1)))
        return F.coalesce(
            F.transform(starts, lambda i: F.substring(lowered, i, F.lit(n))), F.array().cast("array<string>")
        )

    return F.array_distinct(F.concat(F.array(F.lit("")), *[of_size(n) for n in range(1, GRAM + 1)]))


def tidy_pattern(pattern: Column) -> Column:
    """Drop backslashes that escape an ordinary character (they stand for the character)."""
    return F.regexp_replace(pattern, r"\\([^%_\\])", "$1")


def lookup_pieces(pattern: Column) -> Column:
    """Pieces that every match must hold: all of ``GRAM`` characters, else the longest runs, else the empty piece."""
    runs = F.split(F.lower(pattern), r"[%_\\]+")
    size = F.least(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(GRAM))
    cut = lambda run: F.transform(
        F.sequence(F.lit(1), F.length(run) - size + 1), lambda i: F.substring(run, i, size)
    )
    return F.array_distinct(F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) >= size), cut)))


def rarest_pieces(patterns: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """``pattern, piece, texts``: the piece of each pattern that the fewest texts hold, and how many these are.

    Patterns with a piece that no text holds match nothing and are left out. Pieces are
    counted only where a pattern asks for them.
    """
    wanted = patterns.select("pattern").distinct().withColumn("piece", F.explode(lookup_pieces(F.col("pattern"))))
    offered = texts.select(F.explode(pieces(F.col(text))).alias("piece"))
    counted = offered.join(wanted.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("texts"))
    held = wanted.join(counted, "piece", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rarest = held.groupBy("pattern").agg(F.min(F.struct("texts", "piece")).alias("r")).select("pattern", "r.piece", "r.texts")
    return rarest.where("texts > 0")


def pattern_join(patterns: DataFrame, texts: DataFrame, text: str = "text", list_rows: int = LIST_ROWS) -> DataFrame:
    """Rows of ``patterns`` (with a ``pattern`` column) joined to the texts they match.

    ``texts`` should hold each distinct text once. Texts that hold a piece are dealt into
    lists of about ``list_rows``, each of which meets the patterns of that piece; a pattern
    of wildcards only has the empty piece, which every text holds.
    """
    asked = patterns.withColumn("pattern", tidy_pattern(F.col("pattern")))
    chosen = cut_lineage(rarest_pieces(asked, texts, text).withColumn("_lists", F.ceil(F.col("texts") / list_rows)))
    lists = chosen.groupBy(F.col("piece").alias("_piece")).agg(F.max("_lists").alias("_lists"))
    offered = texts.withColumn("_piece", F.explode(pieces(F.col(text)))).join(lists, "_piece")
    offered = offered.withColumn("_list", F.pmod(F.xxhash64(text), F.col("_lists"))).drop("_lists")
    spread = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_lists") - 1)).alias("_list")
    keyed = asked.join(chosen.select("pattern", F.col("piece").alias("_piece"), spread), "pattern")
    return offered.join(keyed, ["_piece", "_list"]).where(F.ilike(F.col(text), F.col("pattern"))).drop("_piece", "_list")


_BASE_DEGREES = 0.05
_LEVELS = 9


def near_join(queries: DataFrame, places: DataFrame) -> DataFrame:
    """Queries (``q_lat, q_lng, radius_km``) joined to the places that can lie within their radius.

    Places have ``lat, lng``. A place is listed once per grid level; a query reads the
    level whose cells are at least as tall as its radius, so it touches three rows of
    cells. The caller compares the true distance.
    """
    from shelfspark.functions.numbers import flat_earth_km

    sizes = F.array(*[F.lit(_BASE_DEGREES * 2**level) for level in range(_LEVELS)])
    reach = F.col("radius_km") / 111.0
    fitting = F.filter(F.sequence(F.lit(0), F.lit(_LEVELS - 1)), lambda i: F.get(sizes, i) >= reach)
    asked = queries.withColumn("_level", F.coalesce(F.get(fitting, F.lit(0)), F.lit(_LEVELS - 1)))
    size = F.get(sizes, F.col("_level"))
    wide = F.least(reach / F.greatest(F.abs(F.cos(F.radians("q_lat"))), F.lit(1e-3)), F.lit(360.0))
    span = lambda mid, r: F.explode(F.sequence(F.floor((mid - r) / size), F.floor((mid + r) / size)))
    asked = asked.withColumn("_row", span(F.col("q_lat"), reach)).withColumn("_col", span(F.col("q_lng"), wide))
    listed = places.where("lat IS NOT NULL AND lng IS NOT NULL").withColumn(
        "_level", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS - 1)))
    )
    listed = listed.withColumn("_row", F.floor(F.col("lat") / F.get(sizes, F.col("_level")))).withColumn(
        "_col", F.floor(F.col("lng") / F.get(sizes, F.col("_level")))
    )
    found = asked.join(listed, ["_level", "_row", "_col"]).drop("_level", "_row", "_col")
    exact = flat_earth_km(F.col("q_lat"), F.col("q_lng"), F.col("lat"), F.col("lng"))
    return found.withColumn("exact_km", exact).where("exact_km <= radius_km")
