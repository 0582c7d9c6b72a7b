"""Raking by sums per language and topic equals raking by tables, in few Spark executions."""

import random

import pytest

from shelfspark.llm import mixing


def cells_of(spark, n_sources=60, n_topics=5, seed=3):
    draw = random.Random(seed)
    rows = [
        (f"s{s}", lang, f"t{t}", 0 if draw.random() < 0.1 else draw.randrange(1, 10_000))
        for s in range(n_sources) for lang in ("de", "en", "fr") for t in range(n_topics) if draw.random() < 0.6
    ]
    rows += [("zero", "en", "t0", 0), ("none", None, "t0", 50), (None, "en", "t1", 70), ("none", "en", None, 90), ("big", "en", "t1", 10**15)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")


def targets_of(spark):
    def table(rows):
        return spark.createDataFrame(rows, "value string, target double")

    langs = [("de", 2.0), ("en", 1.0), ("absent", 5.0)]  # fr gets nothing
    return {"lang": table(langs), "source": table([(f"s{s}", 1.0 + s % 7) for s in range(50)])}


def weights(df):
    return {(r.source, r.lang, r.topic): (r.tokens, r.weight) for r in df.collect()}


@pytest.mark.parametrize("given", [False, True])
def test_both_ways_agree(spark, given):
    cells = mixing.cut_lineage(cells_of(spark))
    targets = targets_of(spark) if given else None
    rows, tables = (weights(mixing.rake(cells, targets, 6, pairs=n)) for n in (mixing.PAIRS, 0))
    assert len(rows) > 400 and rows.keys() == tables.keys()
    for key, (tokens, weight) in rows.items():
        assert tokens == tables[key][0] and weight == pytest.approx(tables[key][1], rel=1e-9)


def test_no_cells(spark):
    assert mixing.rake(cells_of(spark).limit(0)).collect() == []


def executions(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_a_round_is_one_execution(spark):
    """The driver keeps every execution's plan: steps of three written tables a round filled its memory."""
    cells = mixing.cut_lineage(cells_of(spark))
    counts = []
    for rounds in (2, 6):
        before = executions(spark)
        mixing.rake(cells, rounds=rounds, tolerance=0.0)
        counts.append(executions(spark) - before)
    assert counts[1] - counts[0] <= 4 and counts[0] <= 12
