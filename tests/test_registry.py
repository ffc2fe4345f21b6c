"""Every registered query against its SQL on the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import rows, same
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not SF.exists(), reason="driver tables are missing")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in SF.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


# How many documents are scored is no matter of SQL.
NO_SQL = {"pruning_report"}


def test_each_query_has_its_sql():
    assert set(QUERIES) - NO_SQL == set(ORACLES)
    assert QUERIES.keys() <= queries().keys()
    assert oracle_sql().keys() <= queries().keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    found, wanted = queries()[name](spark, str(SF)), db.sql(oracle_sql()[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    ours = rows(found.columns, [tuple(row) for row in found.collect()])
    theirs = rows(wanted.columns, wanted.fetchall())
    assert len(ours) == len(theirs) > 0
    assert all(map(same, ours, theirs))


def test_entry(spark):
    assert entry(spark).count() > 0


def test_scored_documents_lie_between_pools_and_candidates(spark, db):
    known = dict(
        db.sql(f"SELECT qid, count(*) FROM ({ORACLES['candidates']}) GROUP BY qid").fetchall()
    )
    found = QUERIES["pruning_report"](spark, str(SF)).collect()
    assert {row["qid"]: row["candidates"] for row in found} == known
    for row in found:
        assert min(20, row["candidates"]) <= row["scored"] <= row["candidates"]
    assert sum(row["scored"] for row in found) < sum(known.values())
