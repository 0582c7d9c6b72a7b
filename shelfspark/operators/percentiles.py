"""Exact percentiles of large groups without sorting a group in one task.

Approximate percentiles bracket each wanted rank with a guaranteed rank error;
only the values inside a bracket (pre-counted per distinct value) are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ACCURACY = 10_000
# Half widths of brackets as shares of a group: the narrowest that spans 3 ranks and the approximation's error holds the rank.
_MARGINS = [5.0 / _ACCURACY, 3e-3, 3e-2, 3e-1, 1.0]


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, percents: dict[str, float], method: str = "interpolate"
) -> DataFrame:
    """One row per key with ``n`` and one column per named percent.

    A rank that a bracket does not hold is an error, never a wrong answer.
    ``interpolate`` reads between the two ranks around ``(n-1)*p``; ``pick`` takes the
    value at 0-based index ``floor(n*p)``, the way report scripts index a sorted list.
    """
    df = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    keyed = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"_k{i}") for i, k in enumerate(keys)] or [
        # One group: a literal key would be folded away and leave a nested loop.
        F.when(F.col("_v").isNotNull(), 0).alias("_k0")
    ]
    df = df.select(*keys, "_v", *keyed)
    marks = [f"_k{i}" for i in range(len(keyed))]
    names = list(percents)
    bounds = [b for p in percents.values() for m in _MARGINS for b in (max(0.0, p - m), min(1.0, p + m))]
    brackets = df.groupBy(*marks).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_v", bounds, _ACCURACY).alias("_b"),
        *[F.first(k).alias(k) for k in keys],
    )

    chosen = F.lit(len(_MARGINS) - 1)
    for i in reversed(range(len(_MARGINS) - 1)):
        chosen = F.when(F.col("_n") * (_MARGINS[i] - 2.0 / _ACCURACY) >= 3, i).otherwise(chosen)
    targets = []
    for index, name in enumerate(names):
        p = percents[name]
        position = (F.col("_n") - 1) * F.lit(p) if method == "interpolate" else F.floor(F.col("_n") * F.lit(p))
        position = F.least(position.cast("double"), (F.col("_n") - 1).cast("double"))
        targets.append(
            F.struct(
                F.lit(name).alias("name"),
                F.get("_b", 2 * (index * len(_MARGINS) + chosen)).alias("lo"),
                F.get("_b", 2 * (index * len(_MARGINS) + chosen) + 1).alias("hi"),
                position.alias("position"),
            )
        )
    wanted = brackets.select(*marks, F.inline(F.array(*targets)))
    reduced = df.groupBy(*marks, "_v").agg(F.count("*").alias("_c"))
    placed = reduced.join(wanted, marks)
    below = (
        placed.where("_v < lo").groupBy(*marks, "name").agg(F.sum("_c").alias("_below"))
    )
    inside = placed.where("_v >= lo AND _v <= hi").join(below, [*marks, "name"], "left")
    running = Window.partitionBy(*marks, "name").orderBy("_v")
    ranked = inside.withColumn("_end", F.coalesce("_below", F.lit(0)) + F.sum("_c").over(running))
    low = F.floor("position")
    read = ranked.groupBy(*marks, "name").agg(
        F.min(F.when(F.col("_end") > low, F.col("_v"))).alias("_lo_v"),
        F.min(F.when(F.col("_end") > F.ceil("position"), F.col("_v"))).alias("_hi_v"),
        F.first("position").alias("position"),
        F.first(F.coalesce("_below", F.lit(0))).alias("_below"),
        F.max("_end").alias("_last"),
    )
    outside = (F.col("_below") > low) | (F.col("_last") <= F.ceil("position"))
    read = read.withColumn(
        "_lo_v", F.when(outside, F.raise_error(F.lit("a percentile's rank lies outside its bracket"))).otherwise(F.col("_lo_v"))
    )
    answer = F.col("_lo_v") + (F.col("_hi_v") - F.col("_lo_v")) * (F.col("position") - low)
    wide = read.groupBy(*marks).agg(*[F.max(F.when(F.col("name") == name, answer)).alias(name) for name in names])
    return brackets.join(wide, marks).select(*keys, F.col("_n").alias("n"), *names)
