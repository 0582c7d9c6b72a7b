"""Robust quality outliers: statistics against plain Python, estimates against numpy, edge rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import quality_outliers as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed)"""
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), len(lines),
        n < 10 or 100 * len(repeated) > 20 * n,
    )


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed")
TEXTS = [
    None, "", "   \n\n", "one", "a a a a a", "a a a a a a", "a b c d e a b c d e", "a b c d e f a b c d e\na b\n a b\na b\r\n", "é\xa0x y \x0b z\x1c",
    "#*$ %&| <>\n# #\n# #", "x y z w v " * 300, " ".join(f"w{i}" for i in range(60_000)), " ".join(f"w{i % 30_000}" for i in range(60_000)),
    "🙂 🙂🙂\n🙂 🙂🙂",
]


def test_statistics_equal_plain_python(spark):
    draw = random.Random(5)
    texts = TEXTS + [" ".join(draw.choice("ab") for _ in range(n)) for n in range(40)] + ["\n".join(draw.choice(["x", "x ", "", "y|"]) for _ in range(9)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("words", F.lit(1))
    for r in q.text_statistics(df).collect():
        assert tuple(r[c] for c in COLUMNS) == plain_statistics(texts[r.doc_id]), texts[r.doc_id]


def plain_distances(vectors):
    """The same estimate in numpy, on whole numbers."""
    floor, p = np.diag([(q.UNIT * f) ** 2 for f in q.FLOORS]), q.DIMS
    of = lambda x: (x.mean(axis=0), np.cov(x.T, bias=True) + floor)
    far = lambda m, c: (np.linalg.solve(np.linalg.cholesky(c), (vectors - m).T) ** 2).sum(axis=0)
    low = np.floor(vectors / 10)
    median = np.sort(low, axis=0)[math.ceil(len(low) / 2) - 1]
    mad = np.sort(np.abs(low - median), axis=0)[math.ceil(len(low) / 2) - 1]
    starts = [of(vectors), (10 * median, np.diag(np.maximum(14.826 * mad, q.UNIT * np.array(q.FLOORS)) ** 2))]
    found = []
    for estimate in starts:
        for _ in range(q.STEPS):
            bucket = np.floor(q.STEPS_PER_LOG * np.log2(1 + far(*estimate)))
            estimate = of(vectors[bucket <= np.sort(bucket)[math.ceil(q.SHARE * len(bucket)) - 1]])
        found.append((np.linalg.det(estimate[1]), estimate))
    best = min(found, key=lambda x: x[0])[1]
    inner = vectors[far(*best) <= q.chi_square_quantile(1 - q.LEFT_OUT, p) * q._consistency(q.SHARE)]
    return far(*of(inner)) / q._consistency(1 - q.LEFT_OUT)


def corpus(draw, n, junk):
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9))) for _ in range(400)]
    for i in range(n):
        some = [draw.choice(words) for _ in range(draw.randrange(15, 300))]
        if i < junk:
            some = [w + "$$$%" for w in some]
        yield " ".join(some)


def test_estimates_equal_numpy_and_planted_rows_go(spark):
    draw = random.Random(9)
    rows = [(i, t, "en", "a") for i, t in enumerate(corpus(draw, 150, 30))] + [(i + 1000, t, "de", None) for i, t in enumerate(corpus(draw, 90, 5))]
    rows += [(i + 2000, t, "fr", f"s{i % 30}") for i, t in enumerate(corpus(draw, 90, 9))]  # small sources, pooled
    rows += [(i + 3000, t, "es", "x") for i, t in enumerate(corpus(draw, 12, 6))]  # too few even so
    got = {r.doc_id: r for r in q.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for low in (0, 1000, 2000):
        mine = [got[i] for i, *_ in rows if low <= i < low + 1000 and not got[i].base_failed]
        vectors = np.array([[math.floor(1000 * x + 0.5) for x in (
            math.log(r.n_words), math.log(r.word_chars / r.n_words), math.log(1 + r.n_symbols / r.n_words),
            math.log(1 + r.n_dup_lines / r.n_lines), math.log(1 + r.n_repeat_words / r.n_words))] for r in mine], dtype=float)
        want = plain_distances(vectors)
        assert np.allclose([r.distance for r in mine], want, rtol=1e-6)
        junk = {0: 30, 1000: 5, 2000: 9}[low]
        assert all(r.kept == (r.doc_id - low >= junk) for r in mine)
    assert all(got[i].kept and got[i].distance is None for i, *_ in rows if i >= 3000)


def test_any_rows(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    text = "eleven words stand in this line so that it passes rules"
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (None, None, None, None), (None, text, None, None), (2, "", "en", "b"), (3, long, "en", "b")]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in ("n_words", "kept", "grp", "salt", "v0", "n", "distance", "qs_text")})
    got = Counter((r.doc_id, r.n_words, r.base_failed, r.kept) for r in q.quality_verdicts(df).collect())
    assert got == Counter({(1, 11, False, True): 2, (None, 0, True, False): 1, (None, 11, False, True): 1, (2, 0, True, False): 1, (3, 100_000, False, True): 1})
    assert q.quality_verdicts(df.limit(0)).collect() == []
    same = spark.createDataFrame([(i, text, "en", "a") for i in range(100)], schema)
    assert {(r.kept, r.distance) for r in q.quality_verdicts(same).collect()} == {(True, 0.0)}


@pytest.mark.parametrize("share, freedom, value", [(0.975, 5, 12.8325), (0.975, 4, 11.1433), (0.5, 2, 1.38629), (0.99, 7, 18.4753)])
def test_chi_square(share, freedom, value):
    assert abs(q.chi_square_quantile(share, freedom) - value) < 1e-3
