"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage

log = logging.getLogger(__name__)


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, component`` (the least node reachable) of every node of ``links`` (``a, b``).

    Alternates two contractions: every node sends its larger neighbours to its least
    neighbour, then its smaller ones. Both keep components, and the links become a star
    per component after a number of rounds that grows with the logarithm of its size.
    Nodes are compared as Spark orders them. Each round is a written table, so lost
    executors repeat one round at most. Raises if ``max_rounds`` do not suffice.
    """
    both = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = cut_lineage(both.where("hi <> lo").distinct())
    before = None
    for number in range(max_rounds):
        near = edges.unionAll(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = near.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("m", "hi").alias("m"))
        larger = near.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        least = larger.groupBy("hi").agg(F.min("lo").alias("m"))
        smaller = larger.join(least, "hi")
        edges = cut_lineage(
            smaller.select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.*").where("hi <> lo").distinct()
        )
        # A star per component: nothing above is below, and the table stays as it was.
        now = edges.agg(F.count("*"), F.sum(F.hash("hi", "lo").cast("long"))).first()
        if now == before:
            log.info("components settled in %d rounds", number + 1)
            stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
        before = now
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
