"""Every registered query against DuckDB on the same tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import connect, duck_rows, spark_rows
from runpulse.plans.oracle import ORACLE
from runpulse.plans.queries import REGISTRY

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_same_names():
    assert set(REGISTRY) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, con, name):
    got_names, got = spark_rows(entry.queries()[name](spark, SF_DIR))
    want_names, want = duck_rows(con, entry.oracle_sql()[name])
    assert got_names == want_names
    assert len(got) == len(want)
    differing = [(g, w) for g, w in zip(got, want) if g != w]
    assert not differing, differing[:3]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
