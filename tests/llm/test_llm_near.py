"""Near duplicates by Jaccard similarity, against all pairs in plain Python."""

import random

import pytest

from conftest import SMALL
from shelfspark.llm import simhash
from shelfspark.llm.queries import table
from shelfspark.llm.simhash import confirmed_links, near_duplicate_keepers


def shingles(text: str) -> set[str]:
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def keepers(texts: dict[int, str], least: float = 0.8) -> set[int]:
    sets = {i: shingles(t) for i, t in sorted(texts.items())}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(sets):
        for b in list(sets)[:n]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small >= least * large and jaccard(sets[a], sets[b]) >= least:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i for i in sets if find(i) == i}


def planted(draw: random.Random, pairs: int) -> dict[int, str]:
    """Pairs 2i, 2i + 1 of similarities from 0.7 to 0.95."""
    texts = {}
    for i in range(pairs):
        n, like = draw.randint(100, 600), 0.7 + 0.25 * i / pairs
        words = [f"w{draw.randrange(10**9)}" for _ in range(n)]
        same = round(n * 2 * like / (1 + like))
        texts[2 * i] = " ".join(words)
        texts[2 * i + 1] = " ".join(words[:same] + [f"v{draw.randrange(10**9)}" for _ in range(n - same)])
    return texts


def kept_of(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    return {r.doc_id for r in near_duplicate_keepers(df).collect()}


def test_planted_pairs(spark):
    texts = planted(random.Random(11), 600)
    got = kept_of(spark, texts)
    want = {i for i in texts if i % 2 == 0 or jaccard(shingles(texts[i]), shingles(texts[i - 1])) < 0.8}
    assert not want - got  # no document without a near duplicate goes
    assert len(got - want) <= 3  # of 360


@pytest.mark.parametrize("sets_at_once", [16, 2_048])
def test_dense_group_in_blocks(spark, sets_at_once):
    draw = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = {0: " ".join(base)}
    for i in range(1, 150):
        words = list(base)
        for at in draw.sample(range(120), draw.randint(0, 5)):
            words[at] = f"x{draw.randrange(3)}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    prints = simhash.set_prints(df, "doc_id", "text", 5, 1)
    members = prints.selectExpr("1L AS component", "node", "size", "doc_id", "text_hash").dropDuplicates(["node"])
    links = confirmed_links(df, members, "doc_id", "text", 5, 0.8, sets_at_once)
    parts = {r.node: r.component for r in simhash.connected_components(links).collect()}
    groups = {}
    for r in prints.collect():
        groups.setdefault(parts.get(r.node, r.node), []).append(r.doc_id)
    assert {min(g) for g in groups.values()} == keepers(texts)


def test_documents_table(spark):
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    assert kept_of(spark, texts) == keepers(texts)
