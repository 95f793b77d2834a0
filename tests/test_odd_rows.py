"""Queries against their SQL twins on rows that the small tables lack."""

import datetime

import duckdb
import pytest

from orderlens.plans import catalogue

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def rows_of(df):
    """Rows as text, so that an infinite value or NaN equals itself."""
    return sorted(str([round(x, 6) + 0.0 if isinstance(x, float) else x for x in r]) for r in df)


def both(spark, folder, name, **tables):
    c = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    theirs = c.sql(catalogue.oracle_sql()[name])
    ours = catalogue.queries()[name](spark, str(folder)).select(*theirs.columns)
    return rows_of(ours.collect()), rows_of(theirs.fetchall())


@pytest.mark.parametrize("name", ["boundary_metrics", "scalar_projections"])
def test_prices_of_zero(spark, tmp_path, name):
    """A price of 0 first, later and beside a quantity of 0."""
    start = datetime.datetime(2024, 1, 1)
    values = [(0, 0.0, 7), (0, 5.0, 9), (1, 12.5, 30), (1, 0.0, 0), (1, 0.0, 40), (3, 0.0, 0), (3, 8.0, 50), (4, 3.0, 2), (5, 0.0, 99)]
    rows = [(i, start + datetime.timedelta(hours=9 * i), b, "view", v, f'{{"k": {k}}}') for i, (b, v, k) in enumerate(values)]
    got, want = both(spark, tmp_path, name, events=spark.createDataFrame(rows, EVENTS))
    assert got == want and "inf" in str(want)


def test_waits_at_the_edge_of_a_nanosecond(spark, tmp_path):
    """The last bit of this agent's logarithm decides where its first wake is rounded to."""
    customers = spark.createDataFrame([(227187,), (3,), (4,)], "c_custkey long")
    got, want = both(spark, tmp_path, "agent_population", customer=customers)
    assert got == want and "169541234228" in str(want)
