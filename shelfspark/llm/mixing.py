"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic). Raking scales the cells' token
weights to the target marginals of one dimension after the other until they hold in all.
A document then stays with a probability that follows from its cell's weight, calibrated
so that the expected number of tokens is the wanted one.

Everything is DataFrame expressions; only cells are raked, never documents. The driver sees
sums per language and topic, no cells.
"""

from __future__ import annotations

import logging
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage

log = logging.getLogger(__name__)

DIMENSIONS = ("source", "lang", "topic")
#: Raking ends when a round moves no factor by more than this share of it, or after so many rounds.
TOLERANCE = 1e-10
ROUNDS = 40
#: Most (language, topic) pairs whose sums the driver fits; with more, factors are tables.
PAIRS = 4_096
#: Exponents of the shares that are the default targets: 1 keeps a dimension's mix, 0 makes it even.
EVENNESS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
RATE = 0.5
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
#: Topics by the first pattern that a text matches.
TOPICS = (
    ("legal", "License|Copyright|copyright"),
    ("technical", "token|password|secret|https?://"),
    ("contact", "[A-Za-z0-9]@[A-Za-z0-9]"),
)
#: By pattern: pieces of which every match holds one, and whether each of them is a match.
PIECES = {
    "License|Copyright|copyright": (("License", "Copyright", "copyright"), True),
    "token|password|secret|https?://": (("token", "password", "secret", "http://", "https://"), True),
    "[A-Za-z0-9]@[A-Za-z0-9]": (("@",), False),
}
OTHER = "general"
NO_VALUE = "(none)"


def _matches(text: Column, pattern: str) -> Column:
    """``text.rlike(pattern)``; pieces are found in the text's bytes, in a fraction of the time."""
    pieces, enough = PIECES.get(pattern, ((), False))
    if not pieces:
        return text.rlike(pattern)
    held = reduce(or_, (text.contains(piece) for piece in pieces))
    return held if enough else held & text.rlike(pattern)


def topic_of(text: Column) -> Column:
    topic = F.lit(OTHER)
    for name, pattern in reversed(TOPICS):
        topic = F.when(_matches(text, pattern), name).otherwise(topic)
    return F.coalesce(topic, F.lit(OTHER))


def _asked(cells: DataFrame, name: str, given: DataFrame | None) -> DataFrame:
    """``name, asked``: what each value of a dimension is to get, before the values are normalised."""
    held = cells.groupBy(name).agg(F.sum("tokens").alias("held"))
    if given is None:
        asked = F.pow(F.col("held").cast("double"), EVENNESS[name])
    else:
        held = held.join(given.select(F.col("value").alias(name), F.col("target").cast("double").alias("asked")), name, "left")
        asked = F.when(F.col("held") > 0, F.coalesce("asked", F.lit(0.0))).otherwise(0.0)
    return held.select(name, asked.alias("asked"))


def _goals(cells: DataFrame, name: str, given: DataFrame | None) -> DataFrame:
    """``name, goal``: the share of the mix that each value of a dimension is to get."""
    told = cut_lineage(_asked(cells, name, given))
    total = told.agg(F.sum("asked")).first()[0] or 0.0
    return told.select(name, (F.col("asked") / total if total > 0 else F.lit(0.0)).alias("goal"))


def _weighed(cells: DataFrame, factors: dict[str, DataFrame]) -> DataFrame:
    """``cells`` with ``weight``: their tokens times one factor of each dimension.

    Merge joins: a broadcast in every step would fill the driver's memory for tables that
    are small anyway.
    """
    weight = F.col("tokens").cast("double")
    for name, table in factors.items():
        cells = cells.join(table.select(name, F.col("factor").alias(f"f_{name}")).hint("merge"), name)
        weight = weight * F.col(f"f_{name}")
    return cells.withColumn("weight", weight).drop(*[f"f_{name}" for name in factors])


def _rake_tables(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, tolerance: float) -> DataFrame:
    """``rake`` with any number of values: every step is a table with one row per value in the shared folder."""
    factors = {
        name: _goals(cells, name, targets.get(name)).select(name, "goal", F.lit(1.0).alias("factor"), F.lit(0.0).alias("moved"))
        for name in DIMENSIONS
    }
    for number in range(rounds):
        for name in DIMENSIONS:
            held = _weighed(cells, {n: f for n, f in factors.items() if n != name}).groupBy(name).agg(F.sum("weight").alias("held"))
            new = F.when(F.col("held") > 0, F.col("goal") / F.col("held")).otherwise(0.0)
            moved = F.when(new > 0, F.abs(F.col("factor") / new - 1)).otherwise(0.0)
            fitted = held.join(factors[name].select(name, "goal", "factor").hint("merge"), name)
            factors[name] = cut_lineage(fitted.select(name, "goal", new.alias("factor"), moved.alias("moved")))
        moves = [f.agg(F.max("moved").alias("moved")) for f in factors.values()]
        most = moves[0].unionAll(moves[1]).unionAll(moves[2]).agg(F.max("moved")).first()[0]
        if (most or 0.0) <= tolerance:
            log.info("raking settled in %d rounds", number + 1)
            break
    return _weighed(cells, factors)


def _fitted(share: np.ndarray, at: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The factor of each value that brings the sum of ``share`` at that value to its goal."""
    held = np.bincount(at, share, len(goal))
    return np.divide(goal, held, out=np.zeros(len(goal)), where=held > 0)


def _moved(old: np.ndarray, new: np.ndarray) -> float:
    up = new > 0
    return float(np.abs(old[up] / new[up] - 1).max(initial=0.0))


def _rake_rows(
    cells: DataFrame, pairs: list[tuple[str, str]], targets: dict[str, DataFrame], rounds: int, tolerance: float
) -> DataFrame:
    """``rake`` where (language, topic) ``pairs`` are few: a row per source holds its cells.

    A source's factor follows from its row and one factor per pair, so it is stored
    nowhere. A round is one sum per pair over all sources; from these sums the driver,
    which knows pairs only, fits languages and topics.
    """
    spark = cells.sparkSession
    numbered = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "pair int, lang string, topic string")
    held = cells.join(F.broadcast(numbered), ["lang", "topic"]).groupBy("source").agg(
        F.collect_list(F.struct("pair", "lang", "topic", "tokens")).alias("cells")
    )
    rows = cut_lineage(held.join(_goals(cells, "source", targets.get("source")), "source"))
    at, goals, factors = {}, {}, {}
    for k, name in enumerate(DIMENSIONS[1:]):
        asked = {r[name]: r["asked"] for r in _asked(cells, name, targets.get(name)).collect()}  # at most as many as pairs
        total = sum(asked.values())
        number = {v: i for i, v in enumerate(dict.fromkeys(p[k] for p in pairs))}
        at[name] = np.array([number[p[k]] for p in pairs], np.int64)
        goals[name] = np.array([asked[v] / total if total > 0 else 0.0 for v in number])
        factors[name] = np.ones(len(number))

    def per_pair() -> np.ndarray:
        return factors["lang"][at["lang"]] * factors["topic"][at["topic"]]

    def listed(values: np.ndarray) -> Column:
        return F.split(F.lit(",".join(map(repr, values.tolist()))), ",").cast("array<double>")

    def source_factor(weights: np.ndarray) -> Column:
        known = listed(weights)
        total = F.aggregate("cells", F.lit(0.0), lambda n, c: n + c["tokens"].cast("double") * F.get(known, c["pair"]))
        return F.when(total > 0, F.col("goal") / total).otherwise(0.0)

    used, factor = per_pair(), F.lit(1.0)
    for number in range(rounds):
        old, used = factor, per_pair()
        factor = source_factor(used)
        moved = F.when(F.col("new") > 0, F.abs(F.col("old") / F.col("new") - 1)).otherwise(0.0)
        told = (
            rows.select("cells", old.alias("old"), factor.alias("new")).select(F.explode("cells").alias("c"), "new", moved.alias("moved"))
            .groupBy("c.pair").agg(F.sum(F.col("c.tokens").cast("double") * F.col("new")).alias("share"), F.max("moved").alias("moved"))
            .collect()
        )
        share = np.zeros(len(pairs))
        for r in told:
            share[r["pair"]] = r["share"]
        most = max((r["moved"] for r in told), default=0.0)
        for name, other in (("lang", "topic"), ("topic", "lang")):
            new = _fitted(share * factors[other][at[other]], at[name], goals[name])
            most, factors[name] = max(most, _moved(factors[name], new)), new
        if most <= tolerance:
            log.info("raking settled in %d rounds", number + 1)
            break
    weight = F.col("c.tokens").cast("double") * F.col("factor") * F.get(listed(per_pair()), F.col("c.pair"))
    return rows.select("source", F.explode("cells").alias("c"), factor.alias("factor")).select(
        "source", "c.lang", "c.topic", "c.tokens", weight.alias("weight")
    )


def rake(
    cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE,
    pairs: int = PAIRS,
) -> DataFrame:
    """``cells`` (``source, lang, topic, tokens``) with ``weight``, the share of the mix that a cell gets.

    ``targets`` gives ``value, target`` for a dimension; values without a target get none
    of the mix. By default a value's target is its share of tokens to the power in
    ``EVENNESS``. Targets are normalised over the values that have tokens. A cell's weight
    is its tokens times a factor of each of its values; factors are fitted one dimension
    after the other until a whole round moves none by more than ``tolerance`` of itself, so
    that all marginals hold. Where targets contradict each other it ends after ``rounds``
    rounds, with the marginals of the last dimension exact. Up to ``pairs`` pairs of a
    language and a topic a round is one sum over the sources; with more of them every step
    is a table in the shared folder.
    """
    known = cells.select("lang", "topic").where("lang IS NOT NULL AND topic IS NOT NULL").distinct().limit(pairs + 1).collect()
    if not known:
        return cells.limit(0).select(*DIMENSIONS, "tokens", F.lit(0.0).alias("weight"))
    if len(known) > pairs:
        return _rake_tables(cells, targets or {}, rounds, tolerance)
    return _rake_rows(cells, sorted(map(tuple, known)), targets or {}, rounds, tolerance)


def calibrate(raked: DataFrame, rate: float = RATE) -> DataFrame:
    """``raked`` with ``p``: the probability that a document of the cell stays.

    Probabilities follow weight / tokens. They are scaled so that the expected tokens are
    ``rate`` of all; where that takes a cell above 1 it stays whole and the others are
    scaled for the rest. Each pass over the cells gives three sums; passes end when no
    further cell stays whole.
    """
    pull = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    pulled = cut_lineage(raked.withColumn("pull", pull))
    scale, whole = 0.0, -1
    while True:
        full = F.col("pull") * scale > 1
        tokens, spare, weight, now = pulled.agg(
            F.sum("tokens"), F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)
        ).first()
        if now == whole or not weight:
            break
        scale, whole = ((tokens or 0) * rate - spare) / weight, now
    p = F.when(F.col("pull") > 0, F.least(F.lit(1.0), F.col("pull") * scale if weight else F.lit(1.0))).otherwise(0.0)
    return pulled.select(*DIMENSIONS, "tokens", "weight", p.alias("p"))


def mix(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    rate: float = RATE,
    rounds: int = ROUNDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic_col: str | None = None,
) -> DataFrame:
    """``docs`` with ``mix_topic, mix_tokens, mix_weight, mix_p, mix_kept`` behind its columns.

    ``mix_weight`` is the share of the mix that the document's cell gets, ``mix_p`` its
    probability, ``mix_kept`` the draw, which depends on ``seed`` and the id only: repeated
    rows are drawn alike, rows with a null id share one draw. Topics are the values of
    ``topic_col`` where one is given, else those of ``TOPICS``. Null sources and languages
    are a value of their own. Tokens are words between white space; documents without any
    weigh nothing and are not kept. Columns of ``docs`` with these names are replaced. An
    empty table gives no rows.
    """
    added = ("mix_topic", "mix_tokens", "mix_weight", "mix_p", "mix_kept")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    text = F.col(text_col)
    topic = F.coalesce(F.col(topic_col).cast("string"), F.lit(NO_VALUE)) if topic_col else topic_of(text)
    tokens = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    keyed = docs.select(*rest, topic.alias("mix_topic"))
    source, lang = (F.coalesce(F.col(c).cast("string"), F.lit(NO_VALUE)) for c in ("source", "lang"))
    cells = keyed.groupBy(source.alias("source"), lang.alias("lang"), F.col("mix_topic").alias("topic")).agg(F.sum(tokens).alias("tokens"))
    fitted = cut_lineage(calibrate(rake(cut_lineage(cells), targets, rounds), rate))
    found = fitted.select(
        F.col("source").alias("c_source"), F.col("lang").alias("c_lang"), F.col("topic").alias("c_topic"),
        F.col("weight").alias("mix_weight"), F.col("p").alias("mix_p"),
    )
    # Its own file size tells whether the table of cells is small enough to be broadcast.
    joined = keyed.join(found, (source == F.col("c_source")) & (lang == F.col("c_lang")) & (F.col("mix_topic") == F.col("c_topic")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    # Tokens are counted behind the draw, so a caller who keeps only what is drawn counts only there.
    return joined.select(*rest, "mix_topic", tokens.alias("mix_tokens"), "mix_weight", "mix_p", (draw < F.col("mix_p")).alias("mix_kept"))
