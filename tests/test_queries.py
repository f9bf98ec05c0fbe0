"""Every registered query next to its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
#: The smallest tables hold too few shapes for these; larger ones are checked by tools/check.py.
MAY_BE_EMPTY = {"email_domain_whitelist", "keyword_search"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name not in ORACLES:
        assert df.collect()
        return
    problems = compare(df, con, ORACLES[name])
    if name in MAY_BE_EMPTY:
        problems = [p for p in problems if p != "no rows"]
    assert not problems
