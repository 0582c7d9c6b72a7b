"""Passes over whole texts look at each text as little as they can, with the same results."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import decontaminate as dc
from shelfspark.llm import mixing, simhash

TEXTS = [
    "License", "a copyright b", "Copyrigh", "COPYRIGHT", "tok en", "my token", "http:/x", "http://", "https://x", "https:/", "secre", "secret@", "a@b", "@", "a @ b",
    "é@é", "9@Z", "", None, " ", "pass\nword", "password copyright", "日本@a", "x@y License",
]


def test_topics_are_those_of_the_patterns(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").select("text", mixing.topic_of(F.col("text")).alias("topic"))
    for r in rows.collect():
        assert r.topic == next((name for name, pattern in mixing.TOPICS if re.search(pattern, r.text or "")), mixing.OTHER), r.text


def test_topics_of_plain_pieces_need_no_pattern(spark):
    rows = spark.createDataFrame([("x",)], "text string").select(mixing.topic_of(F.col("text")).alias("topic"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and "Contains" in plan  # the pattern of addresses


def test_word_counts(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, "...", "a", ".a", "a.", "a..b c9", "É-é x"]], "text string")
    for r in rows.select("text", dc.word_count(F.col("text")).alias("n")).collect():
        assert r.n == len([w for w in re.split(dc.NO_WORD, r.text or "") if w]), r.text


def spans(words, item, window):
    """Positions of the words that lie in ``window`` consecutive words of the item."""
    there = {tuple(item[i : i + window]) for i in range(len(item) - window + 1)}
    return {p for i in range(len(words) - window + 1) if tuple(words[i : i + window]) in there for p in range(i, i + window)}


@pytest.mark.parametrize("power", [6, dc.TABLE])
def test_a_table_of_any_size_loses_no_hit(spark, monkeypatch, power):
    draw = random.Random(7)
    names = [f"w{i}" for i in range(12)]  # few words: shared passages of all lengths
    texts = {i: [draw.choice(names) for _ in range(draw.choice([3, 9, 10, 40, 200]))] for i in range(60)}
    items = {f"i{k}": [draw.choice(names) for _ in range(30)] for k in range(8)}
    for k, at in enumerate(range(0, 60, 4)):
        item = items[f"i{k % 8}"]
        start, size = draw.randrange(20), draw.choice([9, 10, 11, 15, 30])
        texts[at] = texts[at][:5] + item[start : start + size] + texts[at][5:]
    monkeypatch.setattr(dc.looked_up, "__defaults__", (power,))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id int, text string")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id string, text string")
    found = {r.doc_id: r for r in dc.decontaminate(docs, benchmark).collect()}
    assert any(r.contaminated for r in found.values())
    for i, words in texts.items():
        hit = {k: spans(words, item, dc.WINDOW) for k, item in items.items()}
        assert found[i].n_words == len(words)
        assert found[i].n_hit == len(set().union(*hit.values())) and found[i].n_items == sum(map(bool, hit.values())), i


def test_few_other_grams_reach_the_join(spark):
    """All kept k-grams of every text went through the join before."""
    text = lambda at, n: " ".join(f"w{at + i}" for i in range(n))
    words = lambda df: df.select("id", dc.word_hashes(F.col("text")).alias("words"))
    docs = words(spark.createDataFrame([(i, text(1000 * i, 500)) for i in range(20)], "id int, text string"))
    items = words(spark.createDataFrame([(0, text(3100, 30)), (1, text(900_000, 40))], "id int, text string"))
    prints = dc.fingerprints(items, 10, 5).select("print")
    kept = dc.looked_up(docs, prints, 10, 5).select("id", "at", "print", "near", "before").collect()
    assert {r.print for r in kept} >= {r.print for r in dc.fingerprints(docs.where("id = 3"), 10, 5).join(prints, "print", "left_semi").collect()}
    assert 1 <= len(kept) <= 30
    assert all(len(r.near) == 15 and r.before == 5 for r in kept if 5 <= r.at <= 485)


@pytest.mark.parametrize("longs", [1, 8])
def test_majority_of_many_hashes(longs):
    """Equals counting bit by bit, at sizes around those that are summed at once."""
    step, most = 0x9E3779B97F4A7C15, (1 << 64) - 1
    draw = random.Random(5)
    for n in (0, 1, 2, 254, 255, 256, 600):
        hashes = [draw.getrandbits(64) for _ in range(n)]
        want = []
        for j in range(longs):
            mixed = hashes
            if j:
                mixed = [((h ^ (j * step & most)) * 0xFF51AFD7ED558CCD) & most for h in hashes]
                mixed = [((h ^ (h >> 32)) * 0xC4CEB9FE1A85EC53) & most for h in mixed]
                mixed = [h ^ (h >> 29) for h in mixed]
            want.append(sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in mixed) > n))
        whole = np.array(hashes, "<u8")
        assert simhash.majority((whole,), longs).tolist() == want
        assert simhash.majority((whole[:100], whole[100:]), longs).tolist() == want
