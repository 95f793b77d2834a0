"""Windows over long and short series: equal results, few reads, and what they are built into."""

import math
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlens.functions import stats, windows
from orderlens.operators import flow, results
from orderlens.plans import catalogue

SF = "/root/testdata/sf0.001"
KEYS, ORDER = ["book_id"], ["t", "id"]


@pytest.fixture(scope="module")
def book(spark):
    """One book with almost all rows, null keys, ties and nulls in the order."""
    rows = [(7 if i % 10 else (None if i % 20 else 1), None if i % 97 == 0 else (i * 37) % 400, i, float(i % 13) if i % 5 else None) for i in range(3000)]
    return spark.createDataFrame(rows, "book_id long, t long, id long, x double").repartition(4).cache()


@pytest.fixture(params=[2_000_000, 100], ids=["short", "long"])
def limit(request, monkeypatch):
    monkeypatch.setattr(windows, "LONG", request.param)
    return request.param


@pytest.mark.parametrize("width", [None, 50])
@pytest.mark.parametrize("few", [200_000, 0])
def test_windows(book, limit, width, few, monkeypatch):
    monkeypatch.setattr(windows, "FEW_SLICES", few)
    w = Window.partitionBy("book_id").orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = book.select("id", F.sum("x").over(upto).alias("s"), F.max("x").over(upto).alias("m"), F.last("x", ignorenulls=True).over(upto).alias("k"), F.row_number().over(w).alias("n"), F.lag("x", 3).over(w).alias("b"))
    got = flow.running(book, KEYS, ORDER, {"s": F.col("x")}, {"m": F.col("x")}, width=width)
    got = windows.row_numbers(flow.carry_forward(got, KEYS, ORDER, F.col("x"), "k", width), KEYS, ORDER, "n", width)
    got = windows.framed(got, KEYS, ORDER, 3, lambda v: {"b": F.lag("x", 3).over(v)}, width, block=64).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("keys", [["book_id"], []])
def test_percentiles(book, limit, keys, monkeypatch):
    monkeypatch.setattr(windows, "LONG", min(limit, 5) if limit == 100 else limit)  # 13 distinct values
    exact = book.groupBy(*keys).agg(F.coalesce(F.percentile("x", F.lit(0.9)), F.lit(0.0)).alias("p"), F.coalesce(F.percentile("x", F.lit(0.5)), F.lit(0.0)).alias("q"), F.coalesce(F.round(F.avg("x"), 9), F.lit(0.0)).alias("m"))
    got = stats.percentiles(book, keys, "x", {"p": 0.9, "q": 0.5}, mean_as="m").withColumn("m", F.round("m", 9)).select(*exact.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, exact.collect()))
    none = stats.percentiles(book.where("x is null"), ["book_id"], "x", {"p": 0.9}).collect()
    assert {r["p"] for r in none} == {0.0} and len(none) == 3


@pytest.mark.parametrize("keys", [["book_id"], []])
def test_distribution(book, limit, keys, monkeypatch):
    monkeypatch.setattr(windows, "LONG", min(limit, 5) if limit == 100 else limit)
    plain = {}
    for r in book.collect():
        plain.setdefault(tuple(r[k] for k in keys), []).append(r["x"])
    for r in flow.distribution(book, keys, "x").collect():
        values = plain[tuple(r[k] for k in keys)]
        below = sum(v is None or (r["value"] is not None and v <= r["value"]) for v in values)
        assert r["count"] == values.count(r["value"]) and math.isclose(r["probability"], r["count"] / len(values)) and math.isclose(r["cumulative_probability"], (below if r["value"] is not None else r["count"]) / len(values))


def plain_acf(x, k):
    m = sum(x) / len(x)
    return sum((x[i] - m) * (x[i - k] - m) for i in range(k, len(x))) / sum((v - m) ** 2 for v in x)


def test_autocorrelations(book, limit):
    rows = {}
    for r in sorted(book.where("x is not null").collect(), key=lambda r: (r["t"] is not None, r["t"] or 0, r["id"])):
        rows.setdefault(r["book_id"], []).append(r["x"])
    for r in stats.autocorrelations(book, KEYS, ORDER, "x", [1, 5], "a").collect():
        assert math.isclose(r["a1"], plain_acf(rows[r["book_id"]], 1), abs_tol=1e-9) and math.isclose(r["a5"], plain_acf(rows[r["book_id"]], 5), abs_tol=1e-9)


@pytest.mark.parametrize("share", [0.2, 0.999, 1e-3])
def test_decayed_means_are_the_whole_fold(spark, limit, share):
    rng = random.Random(2)
    rows = [(i % 2, i, 0, None if rng.random() < 0.1 else rng.gauss(1e6 if i < 40 else 300, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "book_id long, t long, id long, x double").repartition(3)
    want, now = {}, {}
    for b, t, _, x in rows:
        if x is not None:
            now[b] = x if b not in now else (1 - share) * now[b] + share * x
        want[t] = now.get(b)
    got = {r["t"]: r["e"] for r in windows.decayed_means(df, KEYS, ORDER, "x", share, "e").collect()}
    assert got.keys() == want.keys() and all(got[t] is None if want[t] is None else math.isclose(got[t], want[t], rel_tol=1e-11) for t in want)


def test_own_past_is_asof_with_itself(book, limit):
    df = book.where("t is not null").withColumn("p", F.col("id") % 7)
    for back in (0, 30):
        ours = flow.own_past(df, KEYS, "t", ["x", "p"], back)
        theirs = flow.asof(df, df, KEYS, "t", ["x", "p"], back)
        assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.select(*ours.columns).collect()))


def test_lowest_takes_a_share(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([rng.getrandbits(63), -rng.getrandbits(63), 5, 5, None]), 1) for i in range(2000)] + [(None, 5, 1), (7, 5, 1), (7, 5, 1)]
    df = spark.createDataFrame(rows, "id long, k long, _x int").repartition(5)
    floor = -(1 << 63)
    order = sorted(rows, key=lambda r: (floor if r[1] is None else r[1], floor if r[0] is None else r[0]))
    for k in (0, 1, 2, 199, 400, 1000, 1500, 2002, 2003, 5000):
        got = sorted(map(str, map(tuple, flow.lowest(df, F.col("k"), "id", k).collect())))
        assert got == sorted(map(str, order[:k])), k
    assert "Limit" not in flow.lowest(df.where("id between 10 and 1900"), F.col("k"), "id", 100)._jdf.queryExecution().executedPlan().toString().split("Union")[0]


def test_moments_do_not_cancel(spark):
    """A mean of 10^6 with deviations of 10^-3."""
    rng = random.Random(1)
    x = [1e6 + rng.gauss(0, 1e-3) for _ in range(5000)]
    df = spark.createDataFrame([(1, i, i, v) for i, v in enumerate(x)], "book_id long, t long, id long, x double").repartition(7)
    m = sum(v - 1e6 for v in x) / len(x)
    variance = sum((v - 1e6 - m) ** 2 for v in x) / len(x)
    lagged = windows.lagged(df, KEYS, ORDER, {"b": ("x", 1)})
    got = lagged.agg(stats.one_pass(F.col("x"))["variance"].alias("v"), F.var_pop("x").alias("w"), F.covar_pop("x", "b").alias("c")).first()
    assert math.isclose(got["v"], variance, rel_tol=1e-6)
    acf = stats.autocorrelations(df, KEYS, ORDER, "x", [1], "a").first()["a1"]
    assert math.isclose(acf, plain_acf([v - 1e6 for v in x], 1), abs_tol=1e-6)


def shape(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[-1]
    return len(re.findall(r"FileScan|Scan parquet", plan)), len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange ", plan))


@pytest.mark.parametrize(("name", "scans", "exchanges"), [("acf_abs_lags", 1, 1), ("order_flow_imbalance", 1, 1), ("momentum_signal", 1, 1), ("spread_percentiles", 1, 2), ("log_return_moments", 1, 1), ("onepass_moments", 1, 1), ("rolling_volatility", 1, 1), ("asset_summary", 2, 2)])
def test_a_series_is_read_once(spark, name, scans, exchanges):
    assert shape(catalogue.queries()[name](spark, SF)) == (scans, exchanges)


@pytest.mark.parametrize("name", ["acf_abs_lags", "order_flow_imbalance", "log_return_moments", "onepass_moments", "asset_summary", "rolling_volatility", "spread_percentiles", "fifo_match_totals", "risk_gates", "stale_snapshots"])
def test_long_books_give_the_same(spark, name, monkeypatch):
    short = sorted(map(str, catalogue.queries()[name](spark, SF).collect()))
    monkeypatch.setattr(windows, "LONG", 20)
    assert sorted(map(str, catalogue.queries()[name](spark, SF).collect())) == short


def test_shock_takes_its_share(spark):
    books = spark.createDataFrame([(i, f"s{i}", 10.0) for i in range(103)], "book_id long, symbol string, bid_depth double")
    assert results.shock_targets(books, 0.1, 5, 2.0).agg(F.sum("is_shock_target")).first()[0] == 10
