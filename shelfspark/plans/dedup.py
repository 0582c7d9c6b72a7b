"""Near-duplicate resolution of the product catalogue.

The rule is the sequential one: walk products by id; a product not yet claimed
takes all unclaimed products within the threshold into its group. That walk picks
the lowest-id maximal independent set, which is found in rounds: a product becomes a
leader once no undecided neighbour has a lower id; products next to a leader are
settled; the others go into the next round. Chains, in which each product waits for one
other, are contracted by pointer jumping, so their length costs a logarithm. A settled
product joins its lowest-id leader, which is always one of its lower neighbours: where the
lowest of these leads, ids alone tell; only the other products are compared with the leaders.

Pairs are never listed: a round asks for the two lowest neighbours per product. Exact
copies stand in as one vector (they are always claimed together), and products packed
around a pivot settle by a minimum per cell before any block is multiplied.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.joins import repoint_listings
from shelfspark.operators.cover_tree import CoverTree
from shelfspark.operators.vectors import lowest_neighbours, place
from shelfspark.session import cut_lineage

log = logging.getLogger(__name__)


def duplicate_groups(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``id, leader`` of every product in a group of two or more (the leader has its own row).

    ``vectors`` has ``id, embedding``.
    """
    usable = vectors.select("id", "embedding").where(
        "embedding IS NOT NULL AND size(embedding) > 0 AND exists(embedding, x -> x <> 0)"
    )
    copies = cut_lineage(usable.groupBy("embedding").agg(F.min("id").alias("rep")))
    placed, tree = place(copies.select(F.col("rep").alias("id"), "embedding"), threshold)
    of_rep = _rounds(placed, threshold, tree)
    members = usable.join(copies, "embedding").select("id", "rep")
    grouped = members.join(of_rep.withColumnRenamed("id", "rep"), "rep").select("id", "leader")
    sizes = grouped.groupBy("leader").agg(F.count("*").alias("members")).where("members > 1")
    return grouped.join(sizes.select("leader"), "leader", "left_semi").select("id", "leader")


def _chains(found: DataFrame) -> DataFrame:
    """Ids that lead for certain, from ``id, neighbours``: the lowest two undecided neighbours below each product.

    Without one a product leads. With a single one it leads if and only if that one does
    not, so such products form chains; pointer jumping halves their length in every step
    and counts how often the answer turns over. Chains that end at a product with two or
    more stay undecided.
    """
    size = F.size("neighbours")
    links = cut_lineage(found.where(size <= 1).select("id", F.coalesce(F.get("neighbours", 0), F.col("id")).alias("to"), size.alias("turns")))
    while True:
        ahead = links.where("turns > 0").select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("turns").alias("more"))
        jumped = links.join(ahead, "to", "left").select("id", F.coalesce("next", "to").alias("to"), (F.col("turns") + F.coalesce("more", F.lit(0))).alias("turns"), F.col("next").isNotNull().alias("moved"))
        links = cut_lineage(jumped)
        if links.where("moved").isEmpty():
            break
    ends = links.where("id = to AND turns = 0").select(F.col("id").alias("to"))
    return links.join(ends, "to", "left_semi").where("turns % 2 = 0").select("id")


def _rounds(placed: DataFrame, threshold: float, tree: CoverTree) -> DataFrame:
    """``id, leader`` of each vector; a leader has its own id."""
    # Settled vectors that a later leader of a lower id may yet take stay in ``claimed``, with all leaders next to them in ``claims``.
    undecided, decided, claimed, claims = placed, [], placed.limit(0), []
    number = 0
    while not undecided.isEmpty():
        number += 1
        # In a core any two vectors are neighbours, so only its lowest id can lead.
        lowest = undecided.where("core").groupBy("cell").agg(F.min("id").alias("core_first"))
        open_ = undecided.join(lowest, "cell", "left").where("NOT (core AND id > core_first)").drop("core_first")
        found = lowest_neighbours(open_, undecided, threshold, tree, 2, below=True)
        below = cut_lineage(open_.select("id").join(found, "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast(found.schema["neighbours"].dataType))))
        leaders = cut_lineage(_chains(below))
        # No leader next to a vector is lower than its lowest undecided neighbour.
        first = below.select("id", F.get("neighbours", 0).alias("leader"))
        joined = first.join(leaders.select(F.col("id").alias("leader")), "leader", "left_semi").select("id", "leader")
        now = cut_lineage(leaders.select("id", F.col("id").alias("leader")).unionByName(joined))
        marked = cut_lineage(undecided.join(now, "id", "left"))
        decided.append(now)
        new, rest = (marked.where(c).drop("leader") for c in ("id = leader", "leader IS NULL"))
        # Each leader meets the vectors that ids did not settle once, in the round in which it is found.
        claim = cut_lineage(lowest_neighbours(rest.unionByName(claimed), new, threshold, tree, below=True).select("id", F.get("neighbours", 0).alias("leader")))
        claims.append(claim)
        claimed = cut_lineage(claimed.unionByName(rest.join(claim, "id", "left_semi")))
        undecided = cut_lineage(rest.join(claim, "id", "left_anti"))
    log.info("duplicate groups settled in %d rounds", number)
    if not decided:
        return placed.select("id", F.col("id").alias("leader"))
    least = reduce(DataFrame.unionByName, claims).groupBy("id").agg(F.min("leader").alias("leader"))
    return reduce(DataFrame.unionByName, decided).unionByName(least)


def group_canonical(groups: DataFrame, listings: DataFrame) -> DataFrame:
    """``id, canonical_id``: the member with most listings stands for its group.

    Ties go to the leader, then to the lowest id.
    """
    counts = listings.groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("n"))
    weighed = groups.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    key = F.struct((-F.col("n")).alias("n"), (F.col("id") != F.col("leader")).alias("other"), F.col("id"))
    chosen = weighed.groupBy("leader").agg(F.min_by("id", key).alias("canonical_id"))
    return groups.join(chosen, "leader").select("id", "leader", "canonical_id")


def deduplicate_catalog(
    products: DataFrame, embeddings: DataFrame, listings: DataFrame, threshold: float = 0.95
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products with ``is_duplicate``/``canonical_product_id``, listings re-pointed, stats).

    Products that an earlier run has marked keep their marks and take no part; without
    these columns all products are undecided. A dry run reads the stats only; nothing is
    written here.
    """
    marks = ["is_duplicate", "canonical_product_id"]
    undecided = embeddings.select(F.col("product_id").alias("id"), "embedding")
    before = dict.fromkeys(marks, F.lit(None))
    if set(marks) <= set(products.columns):
        before = {c: F.col(c) for c in marks}
        decided = products.where("is_duplicate").select(F.col("product_id").alias("id"))
        undecided = undecided.join(decided, "id", "left_anti")
    groups = cut_lineage(group_canonical(duplicate_groups(undecided, threshold), listings))
    mapping = groups.where("id <> canonical_id").select(F.col("id").alias("product_id"), "canonical_id")
    marked = products.join(mapping, "product_id", "left").select(
        *[c for c in products.columns if c not in marks],
        (F.col("canonical_id").isNotNull() | F.coalesce(before[marks[0]].cast("boolean"), F.lit(False))).alias(marks[0]),
        F.coalesce("canonical_id", before[marks[1]].cast("bigint")).alias(marks[1]),
    )
    return marked, repoint_listings(listings, mapping), duplicate_stats(groups)


def duplicate_stats(groups: DataFrame) -> DataFrame:
    """Number of groups and of products merged into another."""
    return groups.agg(
        F.count_if(F.col("id") == F.col("canonical_id")).alias("groups_found"),
        F.count_if(F.col("id") != F.col("canonical_id")).alias("products_merged"),
    )


def duplicate_rate(groups: DataFrame, products: DataFrame, limit_pct: float = 2.0) -> DataFrame:
    """Share of duplicate products and whether it stays below the limit."""
    merged = groups.agg(F.count_if(F.col("id") != F.col("canonical_id"))).scalar()
    pct = F.round(100.0 * F.col("duplicates") / F.greatest("products", F.lit(1)), 2)
    return (
        products.agg(F.count("*").alias("products"))
        .withColumn("duplicates", merged)
        .withColumn("duplicate_pct", pct)
        .withColumn("passed", F.col("duplicate_pct") < limit_pct)
    )
