"""Every registered query against its SQL on the smallest tables."""

import pytest
from checking import connect, differences

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLE[name]) is None


def test_approximate_neighbours_are_mostly_the_exact_ones(spark):
    pick = lambda name: {
        (r.query_id, r.chunk_id) for r in QUERIES[name](spark, FOLDER).where("rank <= 5").collect()
    }
    exact, found = pick("dense_topk"), pick("dense_topk_hashed")
    assert len(exact & found) / len(exact) > 0.5


def test_flagship_runs(spark):
    assert entry.entry(spark).count() == 1
