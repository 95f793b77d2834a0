"""The book by hand-computed cases, and invariants over random flows."""

import random
import struct

import numpy as np
import pytest

from orderlens.operators import book, hawkes, results, simulate
from orderlens.operators.book import CANCEL_AT, CANCEL_OWNER, LIMIT, MARKET, Book


def after(*orders):
    b = Book()
    done = [b.apply(*o) for o in orders]
    return b, done, b.state()


def test_opening():
    s = Book().state()
    assert (s["best_bid"], s["bid_depth"], s["best_ask"], s["ask_depth"], s["mid"]) == (2203400, 1623, 2203700, 823, 2203550)


def test_market_buy():
    _, done, s = after((MARKET, 1, 100, 0, 0, 0, 1, 1))
    assert done == [(100, 0, 0)] and (s["ask_depth"], s["bought"], s["last_trade"]) == (723, 100, 2203700)


def test_sweep_two_levels():
    b, _, s = after((MARKET, 1, 1000, 0, 0, 0, 1, 1))
    assert [(t[2], t[3]) for t in b.trades] == [(2203700, 823), (2203800, 177)] and (s["best_ask"], s["ask_depth"]) == (2203800, 646)


def test_crossing_limit():
    _, done, s = after((LIMIT, 1, 1000, 2203700, 0, 0, 1, 1))
    assert done == [(823, 177, 0)] and (s["best_bid"], s["bid_depth"], s["best_ask"], s["mid"]) == (2203700, 177, 2203800, 2203750)


def test_passive_limit_and_ignored_price():
    _, done, s = after((LIMIT, 1, 50, 2203500, 0, 0, 1, 1), (LIMIT, 1, 50, 0, 0, 0, 2, 2), (MARKET, 1, 0, 0, 0, 0, 3, 3))
    assert done == [(0, 50, 0), (0, 0, 0), (0, 0, 0)] and (s["best_bid"], s["bid_depth"]) == (2203500, 50)


def test_exhausted_side():
    _, done, s = after((MARKET, -1, 10_000, 0, 0, 0, 1, 1))
    assert done == [(9910, 0, 0)] and s["best_bid"] == 0 and s["mid"] == 0


def test_cancels():
    assert after((CANCEL_AT, 1, 2000, 0, 1, 0, 1, 1))[1] == [(0, 0, 1723)]
    assert after((CANCEL_AT, 1, 10, 0, 7, 0, 1, 1))[1] == [(0, 0, 0)]
    _, done, s = after((LIMIT, 1, 10, 2203400, 0, 5, 1, 1), (CANCEL_AT, 1, 10, 0, 0, 0, 2, 2))
    assert done[1] == (0, 0, 10) and s["bid_depth"] == 1623
    assert after((CANCEL_OWNER, 1, 0, 0, 0, 0, 1, 1))[1] == [(0, 0, 0)]
    _, done, s = after((LIMIT, 1, 10, 2203400, 0, 5, 1, 1), (LIMIT, -1, 7, 2203900, 0, 5, 2, 2), (CANCEL_OWNER, 1, 0, 0, 0, 5, 3, 3))
    assert done[2] == (0, 0, 17) and s["bid_depth"] == 1623


def test_first_in_first_out():
    b, _, _ = after((LIMIT, 1, 10, 2203500, 0, 1, 1, 1), (LIMIT, 1, 10, 2203500, 0, 2, 2, 2), (MARKET, -1, 15, 0, 0, 3, 3, 3))
    assert [(t[3], t[4], t[5]) for t in b.trades] == [(10, 1, 3), (5, 2, 3)]


def test_quantities_are_conserved():
    rng = random.Random(1)
    b = Book()
    total = lambda: sum(b.bids.depth.values()) + sum(b.asks.depth.values())
    for n in range(3000):
        held = total()
        side, kind = rng.choice([1, -1]), rng.randrange(4)
        price = (2203400 if side > 0 else 2203700) + rng.randrange(-5, 6) * 100
        done, rest, gone = b.apply(kind, side, rng.randrange(1, 400), price, rng.randrange(4), rng.randrange(5), n, n)
        assert total() == held - done + rest - gone
        s = b.state()
        assert not s["best_bid"] or not s["best_ask"] or s["best_bid"] < s["best_ask"]


def orders(spark, n=400):
    rng = random.Random(3)
    rows = [(b, i * 10, rng.randrange(4), rng.choice([1, -1]), rng.randrange(1, 300), 2203500 + rng.randrange(-6, 7) * 100, rng.randrange(3), rng.randrange(4), i, rng.randrange(9), 0) for i in range(n) for b in range(5)]
    return spark.createDataFrame(rows, "book_id long, arrival_ns long, action int, side int, quantity long, price long, distance long, owner long, sequence long, tie_breaker long, source_rank int")


def test_partitions_do_not_matter(spark):
    one = sorted(map(tuple, book.tape_hash(book.match_trades(orders(spark))).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    two = sorted(map(tuple, book.tape_hash(book.match_trades(orders(spark).repartition(7))).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert one == two and len(one) == 5


def test_reports_have_both_parties(spark):
    trades = book.match_trades(orders(spark)).cache()
    want = sum((t["buyer"] > 0) + (t["seller"] > 0) for t in trades.collect())
    assert book.reports(trades).count() == want > 0


def orders_at(*rows):
    """(generated, owner, action, sequence, tie, rank)"""
    return [r[3] for r in book.in_order(list(rows))]


def test_order_of_one_arrival_time():
    cancel, limit, other = (5, 1, CANCEL_OWNER, 2, 3, 0), (5, 1, LIMIT, 1, 1, 0), (5, 2, MARKET, 3, 2, 0)
    for rows in ([cancel, limit, other], [other, limit, cancel], [limit, other, cancel]):
        assert orders_at(*rows) == [2, 1, 3]
    # A limit of one owner doesn't overtake another's market order for its kind.
    assert orders_at((5, 1, LIMIT, 1, 9, 0), (5, 2, MARKET, 2, 4, 0)) == [2, 1]
    assert orders_at((5, 0, LIMIT, 1, 9, 0), (5, 0, CANCEL_AT, 2, 4, 0), (4, 1, CANCEL_OWNER, 3, 5, 0), (5, 1, LIMIT, 4, 3, 0)) == [4, 2, 3, 1]
    assert book.in_order([]) == []


def test_replays_and_results(spark):
    """Results are told to institutions alone, fills to all; executed quantities are the trades'."""
    from pyspark.sql import functions as F

    flow = orders(spark).withColumn("agent_kind", F.when(F.col("owner") == 1, book.INSTITUTIONAL).otherwise(0))
    done = book.run_books(flow).cache()
    told = book.routed_reports(done).collect()
    results = [r for r in told if r["kind"] == "ORDER_RESULT"]
    assert {r["owner"] for r in results} == {1} and len(results) == flow.where("owner = 1").count()
    assert sum(r["kind"] == "FILL" for r in told) == book.reports(book.trades_of(done)).count() > 0
    totals = done.agg(F.sum("executed"), F.sum(F.aggregate("trades", F.lit(0).cast("long"), lambda a, t: a + t["quantity"]))).first()
    assert totals[0] == totals[1] > 0 and done.where("best_removed and action = 0").count() == 0 and done.where("best_removed").count() > 0


def test_clusters_have_the_rates_of_the_process():
    config = hawkes.HawkesConfig()
    times, kinds = hawkes.clusters(config, 5, 400.0)
    assert (times[1:] >= times[:-1]).all() and set(kinds) == set(range(6)) and times[-1] < 400 * hawkes.NANO
    plain = hawkes.HawkesConfig(own=0.0, limit_to_market=0.0, limit_to_cancel=0.0)
    assert len(hawkes.clusters(plain, 5, 100.0)[0]) == pytest.approx(9900, rel=0.04)
    assert len(hawkes.clusters(hawkes.HawkesConfig(mu=(0,) * 6), 5, 10.0)[0]) == 0
    # Stationary means solve m = mu + alpha m / beta.
    excited = hawkes.HawkesConfig(own=5.0, limit_to_market=2.0, limit_to_cancel=1.0)
    want = np.linalg.solve(np.eye(6) - excited.alpha() / excited.beta, np.array(excited.mu))
    assert np.bincount(hawkes.clusters(excited, 7, 500.0)[1]) / 500 == pytest.approx(want, rel=0.05)


def test_arrivals_one_by_one():
    """The same means as by cluster; multipliers scale them; steps are whole and end at the end."""
    excited = hawkes.HawkesConfig(own=5.0, limit_to_market=2.0, limit_to_cancel=1.0)
    seen = list(hawkes.Arrivals(excited, 3).until(150 * hawkes.NANO))
    assert all(b > a for (a, _), (b, _) in zip(seen, seen[1:])) and seen[-1][0] <= 150 * hawkes.NANO
    want = np.linalg.solve(np.eye(6) - excited.alpha() / excited.beta, np.array(excited.mu))
    assert np.bincount([k for _, k in seen]) / 150 == pytest.approx(want, rel=0.1)
    calm, n = hawkes.Arrivals(hawkes.HawkesConfig(own=0.0, limit_to_market=0.0, limit_to_cancel=0.0), 3), 0
    while calm.next(100 * hawkes.NANO, (0.5, 0, 0, 0, 0, 0)) is not None:
        n += 1
    assert n == pytest.approx(900, rel=0.1)
    assert hawkes.Arrivals(hawkes.HawkesConfig(), 3).next(hawkes.NANO, (0,) * 6) is None and hawkes.Arrivals(hawkes.HawkesConfig(), 3).next(0) is None


def test_quote_sizes():
    config = simulate.MarketConfig(maker_quantity=100, risk_limit=1000.0)
    sizes = lambda held, gross=0.0, books=1: simulate.quote_sizes(held, gross, books, config)
    assert sizes(0) == (100, 100) and sizes(500, 500) == (50, 150) and sizes(-500, 500) == (150, 50) and sizes(9000)[0] == 25
    assert sizes(0, 750.0) == (50, 50) and sizes(0, 750.0, 2) == (100, 100) and sizes(0, 1000.0) == (0, 0)


def test_simulation_repeats_and_shocks():
    config = simulate.MarketConfig(books=2, seconds=1.0, shock_s=0.5, shock_multiple=2.0, shocked=(1,))
    first, again = list(simulate.simulate(1, 9, config)), list(simulate.simulate(1, 9, config))
    assert first == again and len(first) == 2 * 11
    last = {r[1]: r for r in first[-2:]}
    assert last[1][-2] > 0 and last[0][-2] == 0 and last[1][-1] <= last[1][-2]
    alone = list(simulate.simulate(1, 9, config, range(1, 2)))
    assert alone == [r for r in first if r[1] == 1]
    fixed = simulate.MarketConfig(books=1, seconds=1.0, shock_s=0.5, shock_quantity=77, shocked=(0,))
    assert list(simulate.simulate(1, 9, fixed))[-1][-2] == 77


def test_hashes():
    """FNV-1a of the empty string, of "a", and of numbers as big-endian 64 bits or doubles."""
    assert book.fnv(book.BASIS, b"") == 0xCBF29CE484222325 and book.fnv(book.BASIS, b"a") == 0xAF63DC4C8601EC8C
    assert book.record_bytes([1, -1, 1.5]) == bytes(7) + b"\x01" + b"\xff" * 8 + bytes.fromhex("3ff8000000000000")


def test_tapes_of_order(spark):
    trades = book.match_trades(orders(spark, 100))
    rows = sorted(trades.collect(), key=lambda t: (t["book_id"], t["time_ns"], t["trade_sequence"]))
    want = {}
    for t in rows:
        n, state = want.get(t["book_id"], (0, book.BASIS))
        want[t["book_id"]] = n + 1, book.fnv(state, book.record_bytes(list(t)))
    tapes = book.tape_hash(trades)
    assert {r["book_id"]: (r["trades"], int(r["tape_hash"], 16)) for r in tapes.collect()} == want
    whole = results.combined_tape(tapes).first()
    assert whole["combined_trade_count"] == len(rows) and whole == results.combined_tape(tapes.repartition(3)).first()
    floats = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.25)], "k long, t long, x double")
    state = book.fnv(book.fnv(book.BASIS, struct.pack(">d", 0.25)), struct.pack(">d", 0.5))
    assert tuple(book.ordered_hash(floats, "k", ["t"], ["x"], "n", "h").first()) == (1, 2, f"{state:016x}")


def test_summaries_of_runs(spark, tmp_path):
    from pyspark.sql import functions as F

    from orderlens.sources import sinks

    fields = {
        "profile": "small", "duration_seconds": 1.0, "sync_window_us": 10_000, "population_scale": 1.0, "market_makers": 3, "momentum": 600, "informed": 290, "institutional": 10, "total_agents": 903, "generated_strategic": 50,
        "processed_strategic": 48, "processed_background": 90, "fill_reports": 7, "order_result_reports": 2, "pending_end": 2, "peak_pending": 6, "mean_spread": 300.0, "mean_best_bid_depth": 900.0, "mean_best_ask_depth": 800.0, "conserved": True,
    }
    summary = spark.createDataFrame([{"run_id": i} | fields for i in (0, 1)])
    shown = [{"run_id": i, "time_ns": t, "best_bid": 1000, "best_ask": 1200 + 100 * (t % 3), "bid_depth": 5, "ask_depth": 6, "n_limit_buy": t} for i in (0, 1) for t in range(11)]
    clock = results.StageClock()
    with clock.stage("agents"):
        pass
    rollup = results.run_rollup(clock.rows(spark), ["gather"], "agents")
    one = results.simulation_summary(summary, rollup, 1, 2.0)
    assert len(one.columns) == 26 and one.count() == 2 and one.first()["throughput_events_per_second"] > 0
    moments = results.asset_summary(spark.createDataFrame(shown), ["run_id"], ["time_ns"], 100, 11, 1.0, ["n_limit_buy"])
    many = results.distributed_summary(summary, moments, 1, 2.0, 100, final_ns=10**9)
    assert len(many.columns) == 29 and {r["structurally_valid"] for r in many.collect()} == {1} and {r["terminated_early"] for r in many.collect()} == {0}
    sinks.write_summary(many, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 2
    market = simulate.MarketConfig(books=3, seconds=1.0)
    samples = simulate.run_markets(spark.createDataFrame([(0, 3)], "run_id long, seed long"), market).cache()
    tapes = spark.createDataFrame([(0, 5, "aa"), (1, 6, "bb")], "book_id long, trades long, tape_hash string")
    symbols = spark.range(3).select(F.col("id").alias("book_id"), F.concat(F.lit("B"), "id").alias("symbol"))
    books = results.book_summary(samples, tapes, symbols, 100, 11, 1.0, ranks=2).orderBy("book_id").collect()
    assert [b["owner_rank"] for b in books] == [0, 1, 0] and {b["combined_trade_count"] for b in books} == {11} and books[2]["trade_count"] == 0
    assert all(b["structurally_valid"] and b["processed_events"] == sum(b[f"{n}_events"] for n in ("limit_buy", "limit_sell", "market_buy", "market_sell", "cancel_bid", "cancel_ask")) for b in books)
    found = {r["name"] for r in simulate.run_moments(samples, market).collect()}
    assert {"market_order_best_removal_rate", "cancel_best_removal_rate", "spread_p90", "return_variance"} <= found
