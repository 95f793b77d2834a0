"""Each query against its SQL twin, run by DuckDB on the same tables."""

import duckdb
import pytest

from orderlens.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def oracle():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    ours = catalogue.queries()[name](spark, SF)
    theirs = oracle.sql(catalogue.oracle_sql()[name])
    got, want = table([tuple(r) for r in ours.collect()], ours.columns), table(theirs.fetchall(), theirs.columns)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) and got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs_and_repeats(spark, name):
    first = sorted(map(str, catalogue.queries()[name](spark, SF).collect()))
    assert first and first == sorted(map(str, catalogue.queries()[name](spark, SF).collect()))
