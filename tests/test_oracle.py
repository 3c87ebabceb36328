"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from berth.plans import queries as plans  # noqa: E402
from tools.check import compare, database  # noqa: E402

SF = os.environ.get("BERTH_TEST_SF", "/root/testdata/sf0.001")
QUERIES, ORACLE = {name: q.run for name, q in plans.QUERIES.items()}, plans.oracles()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES[name], ORACLE.get(name)) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()


def test_full_answers_hold_the_folded_ones(spark):
    dated, folded = (QUERIES[n](spark, SF) for n in ("find_dated_trips_full", "find_dated_trips"))
    assert dated.count() == folded.agg({"n_trips": "sum"}).first()[0]
    offers, keyed = (QUERIES[n](spark, SF) for n in ("search_trips_full", "search_trips"))
    assert offers.count() == keyed.agg({"n_requests": "sum"}).first()[0]
