"""Every registered query that has SQL gives the same rows as DuckDB, at the smallest size."""

import glob
import os

import duckdb
import pytest

from palimpsest.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([v[i] for i in order]) for v in values)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_every_commit_is_reached_and_ranked(spark):
    from palimpsest.sources import tables

    commits = sorted(r.sha for r in tables.order_commits(spark, SF).select("sha").collect())
    run = catalogue.queries()
    for name in ("ancestors", "ancestors_by_joins", "first_parent", "all_refs"):
        assert sorted(r.sha for r in run[name](spark, SF).collect()) == commits
    ranks = run["walk_order"](spark, SF).collect()
    assert sorted(r.sha for r in ranks) == commits and sorted(r.walk_seq for r in ranks) == list(range(1, len(commits) + 1))
    assert 0 < run["rev_range"](spark, SF).count() < len(commits)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_first_occurrences_come_from_what_was_written(spark):
    """Dates come with the changes, so neither orders are derived again nor changes dealt by commit for them."""
    files = catalogue.queries()["occurrence_dedup"](spark, SF).inputFiles()
    assert files and not any("orders.parquet" in f for f in files)
