"""The cover tree and the contraction of chains, against brute force."""

import itertools
import logging
import math

import numpy as np
import pytest

from shelfspark.operators import cover_tree
from shelfspark.operators.vectors import place
from shelfspark.plans import dedup
from test_jobs import rows, vector_frame, walk


def unit(matrix):
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


@pytest.mark.parametrize("n, dims, fan", [(1, 3, 4), (5, 2, 4), (300, 6, 4), (300, 40, 16)])
def test_visits_hold_every_neighbour(n, dims, fan):
    rng = np.random.default_rng(n + dims)
    matrix = unit(rng.normal(size=(8, dims))[rng.integers(0, 8, n)] + 0.3 * rng.normal(size=(n, dims)))
    tree = cover_tree.CoverTree.of(matrix[: max(1, n // 6)], fan)
    nodes, angles = tree.paths(matrix)
    for level in range(len(tree.sizes)):
        tree.measure(level, nodes[:, level], angles[:, level], np.ones(n, dtype=np.int64))
    for threshold, tree.level in itertools.product((0.5, 0.9, 1.0), range(len(tree.sizes))):
        visits = tree.visits(matrix, np.full(n, math.acos(threshold)))
        row, column = np.nonzero(np.round(matrix @ matrix.T, 9) >= threshold)
        assert all(nodes[j, tree.level] in visits[i] for i, j in zip(row, column))
        got = set(zip(*(x.tolist() for x in cover_tree.near_pairs(matrix, matrix, threshold, tree.basis)[:2])))
        assert got == set(zip(row.tolist(), column.tolist()))


def test_clustered_vectors_meet_few_cells(spark):
    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(60, 32))[rng.integers(0, 60, 6000)] + 0.1 * rng.normal(size=(6000, 32))
    placed, tree = place(vector_frame(spark, matrix), 0.95)
    assert len(tree.pivots) == math.ceil(6000 / cover_tree.LEAF_ROWS)  # they grow with the rows
    assert tree.level > 0
    assert cover_tree.mean_visits(placed) < 0.25


def test_a_chain_settles_in_few_rounds(spark, caplog):
    # Each vector shares one axis with the next one only, so leaders alternate along the whole chain.
    n = 1000
    matrix = np.eye(n, n + 1) + np.eye(n, n + 1, 1)
    frame = vector_frame(spark, matrix)
    with caplog.at_level(logging.INFO, logger="shelfspark.plans.dedup"):
        got = rows(dedup.duplicate_groups(frame, 0.45))
    assert got == walk(matrix, list(range(n)), 0.45)
    settled = [r for r in caplog.records if "settled" in r.message]
    assert settled and settled[0].args[0] <= 15
