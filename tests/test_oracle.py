"""Every registered query against its SQL on the smallest tables.

``python tests/compare.py <folder> [prefix ...]`` runs the same comparison elsewhere.
"""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from conftest import SMALL
from shelfspark.checks import load

QUERIES, ORACLES = load()

# The smallest tables lack the rows these look for; the larger ones have them.
EMPTY_WHEN_SMALL = {
    "f09_store_list_filter", "f10_store_search_filter", "c21_list_stores", "f19_website_pending", "j05_popularity_left_join",
    "j05_worklist_by_id", "j06_distinct_by_store",
}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, duck):
    problem = compare(QUERIES[name](spark, SMALL), duck, ORACLES[name])
    if name in EMPTY_WHEN_SMALL and problem == "both empty":
        return
    assert problem == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
