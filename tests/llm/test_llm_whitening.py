"""Whitening against numpy's eigenvectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from shelfspark.llm.queries import QUERIES, table
from shelfspark.llm.whitening import one_sided_jacobi, pivoted_cholesky, principal_axes, whitened_components


def plain(vectors, components=8):
    """{(row, component): values} by numpy, with exact integers for the deviations."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[float(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for k in range(components):
        e, u = values[-1 - k], axes[:, -1 - k]
        scores = centred @ u / np.sqrt(e)
        for i, row in enumerate(x):
            out[i, k + 1] = (n, sum((n * c - s) ** 2 for c, s in zip(row, sums)), scores[i], e / values.sum())
    return out


def test_query_equals_numpy(spark):
    rows = table(spark, SMALL, "embeddings").collect()
    want = plain([r.embedding for r in rows])
    at = {r.vec_id: i for i, r in enumerate(rows)}
    got = QUERIES["op12_whitening"](spark, SMALL).collect()
    assert len(got) == len(want) == 8 * len(rows)
    signs = {}
    for r in got:
        n, deviation, score, explained = want[at[r.vec_id], r.component]
        sign = signs.setdefault(r.component, 1.0 if r.whitened * score > 0 else -1.0)
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(sign * r.whitened - score) < 1e-9 and abs(r.explained / explained - 1) < 1e-9
        assert r.identity_error < 1e-9


@pytest.mark.parametrize("shape, rank", [((40, 12), 12), ((40, 13), 5), ((6, 9), 6), ((1, 1), 1)])
def test_factor_and_rotations(shape, rank):
    draw = np.random.default_rng(7)
    rows = draw.normal(size=(shape[0], rank)) @ draw.normal(size=(rank, shape[1])) if rank < min(shape) else draw.normal(size=shape)
    scatter = rows.T @ rows
    factor, order = pivoted_cholesky(scatter)
    assert factor.shape[1] == rank
    assert np.allclose(factor @ factor.T, scatter[np.ix_(order, order)], atol=1e-9)
    assert np.array_equal(np.tril(factor), factor)  # triangular
    gram = one_sided_jacobi(factor).T @ one_sided_jacobi(factor)
    assert np.allclose(gram, np.diag(np.diag(gram)), atol=1e-9 * gram.max())
    axes, values = principal_axes(scatter, shape[0], 20)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(scatter))[::-1][:rank] / shape[0], rtol=1e-8)
    assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-9)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, 0.9]), (1, [0.1, 0.9]), (None, [0.5, -0.2]), (2, [-0.7, 0.3])]
    bad = [(3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [])]
    names = "vec_id long, embedding array<float>"
    df = spark.createDataFrame(good + bad, names).withColumn("n", F.lit("x")).withColumn("whitened", F.lit("y")).withColumn("v", F.lit(0))
    got = whitened_components(df).collect()
    assert len(got) == 8 and {r.n for r in got} == {4} and {r.component for r in got} == {1, 2}
    assert sorted({str(r.vec_id) for r in got}) == ["1", "2", "None"]
    assert got[0].identity_error < 1e-12 and abs(sum({r.explained for r in got}) - 1) < 1e-12
    ones = [r for r in got if r.vec_id == 1]
    assert len(ones) == 4 and len({(r.component, r.whitened) for r in ones}) == 2
    assert whitened_components(df.limit(0)).collect() == []
    assert whitened_components(df.where("vec_id = 1")).collect() == []  # equal vectors span nothing
    line = spark.createDataFrame([(i, [i / 8, i / 4, 1.0]) for i in range(9)], names)
    flat = whitened_components(line).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12  # one dimension only
    with pytest.raises(Exception, match="lengths differ"):
        whitened_components(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], names)).collect()
