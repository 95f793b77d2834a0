import math

import pytest
from pyspark.sql import functions as F

from orderlens.functions import market, rng, stats, windows
from orderlens.operators import flow, results, simulate
from orderlens.sources import sinks, tables
from orderlens.streaming import flows, timers


def write(path, text):
    path.write_text(text)
    return str(path)


def test_distribution(spark, tmp_path):
    path = write(tmp_path / "d.csv", "quantity,count\n24,1\n25.4,2\nbad,3\n\n30,1\n-3,2\n2.5,1\n")
    assert sorted(r["value"] for r in tables.distribution(spark, path, "quantity", 25).collect()) == [25, 30]
    assert sorted(r["value"] for r in tables.distribution(spark, path, "other", 0).collect()) == [3, 24, 25, 30]


def test_loss_targets(spark, tmp_path):
    path = write(tmp_path / "t.csv", "metric, value, weight, floor\n# note\nmean_return,0.1,,\n Mean_Spread ,300,2,50\nreturn_variance,x,1,1\nmid_move_rate,0.2,0,1\n")
    rows = {r["name"]: tuple(r)[1:] for r in tables.loss_targets(spark, path).collect()}
    assert rows == {"return_mean": (0.1, 0.5, 1e-6), "mean_spread": (300.0, 2.0, 50.0)}
    with pytest.raises(ValueError):
        tables.loss_targets(spark, write(tmp_path / "u.csv", "a,b\n1,2\n"))


HEAD = "book_id,symbol,data_dir,hawkes_rates_file,fundamental_price_ticks,initial_best_bid_ticks,initial_best_ask_ticks,initial_best_bid_depth,initial_best_ask_depth,beta,basket_weight,market_maker_quote_quantity,target_spread_ticks\n"


def test_books(spark, tmp_path):
    good = tables.book_configs(spark, write(tmp_path / "b.csv", HEAD + "0,A,d,f,100,10000,10200,5,6,1,0.5,100,2\n1,B,d,f,100,0,0,0,0,1,0.5,100,2\n"))
    assert tables.book_violations(good).count() == 0
    assert tables.calibrated_book(good, 100).where("book_id = 0").count() == 20
    bad = tables.book_configs(spark, write(tmp_path / "c.csv", HEAD + "0,A,d,f,0,10000,0,5,6,0,0.5,100,2\n2,A,d,f,100,0,0,0,0,1,-1,100,0\n"))
    assert sorted(r["rule"] for r in tables.book_violations(bad).collect()) == ["beta", "fundamental", "ids", "opening", "spread", "symbol", "weight"]


def test_rates(spark, tmp_path):
    names = list(market.EVENT_NAMES)
    text = "event_type,configured_mu\n" + "".join(f"{n},{i}\n" for i, n in enumerate(names))
    assert tables.hawkes_rates(spark, write(tmp_path / "r.csv", text + "other,5\n")) == (0, 1, 2, 3, 4, 5)
    for wrong in (text.replace("limit_sell,1\n", ""), text + "limit_buy,2\n", text.replace(",3", ",-3")):
        with pytest.raises(ValueError):
            tables.hawkes_rates(spark, write(tmp_path / "w.csv", wrong))


def test_opening_book_and_config(spark):
    assert tables.opening_book(spark).count() == 20 and tables.opening_book(spark, 1e-9).agg(F.max("quantity")).first()[0] == 1
    assert tables.run_config(["--seconds", "7", "--profile", "baseline"]).seconds == 7 and tables.run_config(["--profile", "baseline"]).momentum == 6000
    with pytest.raises(SystemExit):
        tables.run_config(["--seconds", "-1"])


def test_draws_equal_the_stream(spark):
    stream = rng.Stream(12345)
    want = [stream.next() for _ in range(5)]
    assert want[0] == 2454886589211414944
    got = [r[0] & rng.MASK for r in spark.range(1, 6).select(rng.draw(F.lit(12345).cast("long"), F.col("id"))).collect()]
    assert got == want
    low = spark.range(1, 6).select(rng.uniform_int(rng.draw(F.lit(12345).cast("long"), F.col("id")), F.lit(3), F.lit(17))).collect()
    assert [r[0] for r in low] == [3 + w % 15 for w in want]


def test_short_series(spark):
    df = spark.createDataFrame([("a", 1, 1.0)] + [("b", i, 5.0) for i in range(6)] + [("c", i, x) for i, x in enumerate([1.0, 2.0, 4.0, 9.0, 20.0])], "s string, t int, x double")
    x = F.col("x")
    rows = {r["s"]: r for r in df.groupBy("s").agg(stats.variance(x).alias("v"), stats.skewness(x).alias("k"), stats.kurtosis(x).alias("q"), stats.percentile(x, 0.9).alias("p"), stats.correlation(x, F.col("t").cast("double")).alias("c")).collect()}
    assert tuple(rows["a"])[1:4] == (0, 0, 0) and tuple(rows["b"])[1:4] == (0, 0, 0) and rows["b"]["c"] == 0
    assert rows["c"]["v"] == pytest.approx(60.7) and rows["c"]["p"] == pytest.approx(15.6)
    acf = {r["s"]: r["f1"] for r in stats.autocorrelations(df, ["s"], ["t"], "x", [1, 7], "f").collect()}
    assert acf["a"] == acf["b"] == 0 and acf["c"] != 0


def test_asof_edges(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("a", 30), ("b", 1)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1), ("a", 9, 2)], "k string, t long, v int")
    got = {(r["k"], r["t"]): r["asof_v"] for r in flow.asof(left, right, ["k"], "t", ["v"], tolerance=10).collect()}
    assert got == {("a", 5): 1, ("a", 10): 2, ("a", 30): None, ("b", 1): None}


def test_scalars(spark):
    row = spark.range(1).select(
        market.clamp(F.lit(None).cast("int"), 0, 3).alias("n"), market.ceil_to_tick(F.lit(101), 25).alias("c"), market.floor_to_tick(F.lit(124), 25).alias("f"), market.add_time(F.lit(2**63 - 2), F.lit(9)).alias("t"),
        market.owner_rank(market.owner_id(F.lit(3), F.lit(7))).alias("r"), market.owner_index(market.owner_id(F.lit(3), F.lit(7))).alias("i"), market.scaled_quantity(F.lit(1e12), 1.0).alias("q"), market.finite_or_zero(F.lit(math.inf)).alias("z"),
        market.informed_quantity(F.lit(-6.0), 1.0, 100, F.lit(0.5)).alias("s"), market.inventory_scale(F.lit(9), F.lit(10)).alias("v"), market.spread_bps(F.lit(10), F.lit(20), F.lit(1000.0)).alias("b"),
    ).first()
    assert tuple(row) == (None, 125, 100, 2**63 - 1, 3, 7, 2**31 - 1, 0.0, -200, 0.75, 100.0)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1), (2, 1 / 3)], "rank int, seconds double")
    sinks.write_table(df, str(tmp_path / "p"), ["rank"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.write_summary(df, str(tmp_path / "c"))
    assert sorted(r["seconds"] for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()) == ["0.1", "0.333333333333"]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(b, i * 700_000_000, i % 3 if i % 3 < 2 else 3, 1 if i % 2 else -1, 10 + i, 2203500 + i % 7 * 100, 0, 1 + i % 3, i) for i in range(60) for b in range(2)]
    schema = "book_id long, arrival_ns long, action int, side int, quantity long, price long, distance long, owner long, sequence long"
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.parquet(str(tmp_path / f"in{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    timed = flows.tumbling_flow(flows.event_time(stream, "arrival_ns", "10 minutes"), "10 seconds")
    timed.writeStream.outputMode("complete").format("memory").queryName("flow").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start().awaitTermination(120)
    batch = spark.createDataFrame(rows, schema)
    want = flows.tumbling_flow(batch.withColumn("event_time", F.timestamp_micros(F.floor(F.col("arrival_ns") / 1000).cast("long"))), "10 seconds")
    assert sorted(map(tuple, spark.table("flow").collect())) == sorted(map(tuple, want.collect()))
    query = flows.stateful_books(stream).writeStream.outputMode("append").format("memory").queryName("tops").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    query.awaitTermination(180)
    tops = spark.table("tops").collect()
    from orderlens.operators.book import Book

    for b in range(2):
        whole = Book()
        for r in (r for r in rows if r[0] == b):
            whole.apply(*r[2:7], r[7], r[8], r[1])
        last = max((t for t in tops if t["book_id"] == b), key=lambda t: t["arrival_ns"]).asDict()
        assert {k: last[k] for k in whole.state()} == whole.state()


def stream_of(spark, tmp_path, rows, schema, parts, name):
    for i, part in enumerate(parts):
        spark.createDataFrame([rows[j] for j in part], schema).coalesce(1).write.parquet(str(tmp_path / f"{name}{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}*"))


def collected(spark, df, tmp_path, name, mode="append"):
    df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c_{name}")).start().awaitTermination(180)
    return spark.table(name).collect()


ORDERS = "book_id long, arrival_ns long, generated_ns long, owner long, action long, sequence long, tie_breaker long, source_rank long, agent_kind long, side long, quantity long, price long, distance long"


def order_rows():
    """Many orders of one arrival time, cancels after the limits they replace, and a last one that lets event time pass all others."""
    rows = [(b, i // 4 * 700_000_000, i // 8, 1 + i % 2, (0, 2, 1, 0)[i % 4], i, (i * 7919) % 101, 0, 0, 1 if i % 3 else -1, 10 + i, 2203500 + i % 7 * 100, 0) for i in range(48) for b in range(2)]
    return rows + [(b, 10**12, 10**12, 0, 0, 10**6, 0, 0, 0, 1, 1, 2203000, 0) for b in range(2)]


def test_streams_and_batches_break_ties_alike(spark, tmp_path):
    """Whatever the micro-batches, orders of one time included, the books end as in the batch kernel."""
    from orderlens.operators import book

    rows = order_rows()
    halves = [range(0, 30), range(30, 98)], [range(40, 98), range(0, 40)]
    want = {(r["book_id"], r["sequence"]): r for r in book.run_books(spark.createDataFrame(rows[:-2], ORDERS)).collect()}
    last = {b: max((r for (k, _), r in want.items() if k == b), key=lambda r: r["arrival_ns"])["arrival_ns"] for b in range(2)}
    ends = {b: [r for (k, _), r in want.items() if k == b and r["arrival_ns"] == last[b]] for b in range(2)}
    for i, parts in enumerate(halves):
        stream = stream_of(spark, tmp_path, rows, ORDERS, parts, f"o{i}_")
        timed = flows.event_time(stream, "arrival_ns", "2 hours" if i else "1 second")
        tops = [r for r in collected(spark, flows.stateful_books(timed), tmp_path, f"tops{i}") if r["arrival_ns"] == last[r["book_id"]]]
        assert {r["book_id"] for r in tops} == ({0, 1} if not i else set()) or i
        for r in tops:
            assert tuple(r[c] for c in ("best_bid", "best_ask", "bid_depth", "ask_depth", "bought", "sold")) in {tuple(w[c] for c in ("best_bid", "best_ask", "bid_depth", "ask_depth", "bought", "sold")) for w in ends[r["book_id"]]}


def test_messages_are_held_until_due(spark, tmp_path):
    rows = order_rows()
    stream = flows.event_time(stream_of(spark, tmp_path, rows, ORDERS, [range(0, 50), range(50, 98)], "h"), "arrival_ns", "1 second")
    got = collected(spark, timers.hold_until_due(stream, 1_000_000_000), tmp_path, "held")
    assert {(r["book_id"], r["sequence"]) for r in got} == {(r[0], r[5]) for r in rows[:-2]}
    from orderlens.operators.book import in_order

    for b in range(2):
        mine = [(r["arrival_ns"], r["sequence"]) for r in got if r["book_id"] == b]
        assert [a for a, _ in mine] == sorted(a for a, _ in mine)
        for at in {a for a, _ in mine}:
            same = [tuple(r[2:8]) for r in rows if r[0] == b and r[1] == at]
            assert [s for a, s in mine if a == at] == [r[3] for r in in_order(same)]


def test_states_sampled_on_a_clock(spark, tmp_path):
    rows = [(b, t * 100_000_000, float(t + b)) for t in (1, 4, 12, 13, 55) for b in range(2)] + [(b, 10_000_000_000, 0.0) for b in range(2)]
    stream = flows.event_time(stream_of(spark, tmp_path, rows, "book_id long, time_ns long, mid double", [range(0, 4), range(4, 12)], "s"), "time_ns", "1 second")
    got = {(r["book_id"], r["time_ns"] // 10**9): r["mid"] for r in collected(spark, timers.sampled(stream, 1_000_000_000, "mid"), tmp_path, "clock")}
    assert all(got[b, t] == v + b for b in range(2) for t, v in ((1, 4.0), (2, 13.0), (5, 13.0), (6, 55.0), (8, 55.0)))


def test_lookback_forgets(spark, tmp_path):
    times = [0, 1, 2, 3, 9, 10]
    rows = [(1, t * 10**9, float(t)) for t in times]
    stream = stream_of(spark, tmp_path, rows, "book_id long, time_ns long, mid double", [range(0, 3), range(3, 6)], "l")
    got = {r["time_ns"] // 10**9: r["past"] for r in collected(spark, timers.looked_back(stream, 10**9, 5 * 10**9, "mid"), tmp_path, "past")}
    assert got == {0: None, 1: 0.0, 2: 1.0, 3: 2.0, 9: None, 10: 9.0}


def test_order_guard(spark, tmp_path):
    rows = [(1, k) for k in (1, 2, 5)] + [(1, k) for k in (4, 6, 6)]
    stream = stream_of(spark, tmp_path, rows, "book_id long, key long", [range(0, 3), range(3, 6)], "g")
    assert sorted((r["key"], r["largest"]) for r in collected(spark, timers.out_of_order(stream, "key"), tmp_path, "guard")) == [(4, 5), (6, 6)]


def test_appended_stream_and_two_clocks(spark, tmp_path):
    rows = [(1, i * 250_000_000, 1 if i % 2 else -1, i) for i in range(20)]
    schema = "book_id long, arrival_ns long, side int, quantity long"
    stream = stream_of(spark, tmp_path, rows, schema, [range(0, 10), range(10, 20)], "a")
    sinks.append_stream(stream, str(tmp_path / "table"), str(tmp_path / "c_append")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.schema(schema).parquet(str(tmp_path / "table")).collect())) == rows
    timed = spark.createDataFrame(rows, schema).withColumn("event_time", F.timestamp_micros(F.floor(F.col("arrival_ns") / 1000).cast("long")))
    slow, fast = flows.dual_clock_flow(timed, "2 seconds", "1 second")
    assert slow.count() == 3 and fast.count() == 5 and slow.agg(F.sum("bought")).first() == fast.agg(F.sum("bought")).first()


def test_several_files_make_one_source(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"shard{i}.csv", f"quantity,count\n{30 + i},1\n")
    assert sorted(r["value"] for r in tables.distribution(spark, str(tmp_path / "shard*.csv"), "quantity", 25).collect()) == [30, 31, 32]


def test_sources_of_a_run(spark, tmp_path):
    for name, (column, _) in tables.DISTRIBUTIONS.items():
        write(tmp_path / f"{name}_distribution.csv", f"{column},count\n" + "".join(f"{v},1\n" for v in (-3, 5, 26, 40, 77)))
    found = tables.drawn_values(spark, str(tmp_path))
    assert found["quantities"] == ((26, 40, 77),) * 6 and found["distances"] == ((5, 26, 40, 77),) * 4
    assert len(list(simulate.simulate(1, 3, simulate.MarketConfig(seconds=0.5, **found)))) == 6
    write(tmp_path / "cancel_ask_distance_distribution.csv", "distance_ticks\n-1\n")
    with pytest.raises(ValueError, match="no values"):
        tables.drawn_values(spark, str(tmp_path))


def test_books_of_a_run(spark, tmp_path):
    clones = tables.resolved_books(spark, None, 3)
    assert clones.count() == 3 and tables.book_violations(clones).count() == 0
    path = write(tmp_path / "b.csv", HEAD + "0,A,d,f,100,10000,10200,5,6,1,0.5,100,2\n")
    assert tables.resolved_books(spark, path, 9).count() == 1
    with pytest.raises(ValueError, match="beta"):
        tables.resolved_books(spark, write(tmp_path / "c.csv", HEAD + "0,A,d,f,100,10000,10200,5,6,0,0.5,100,2\n"), 1)
    with pytest.raises(ValueError):
        tables.resolved_books(spark, None, 0)
    (one, a), (_, b) = tables.process_of(spark, 0, 5, None), tables.process_of(spark, 1, 5, None)
    assert a != b and tables.process_of(spark, 0, 5, None)[1] == a and one.mu[0] == 18.0
    config = tables.windowed_of(tables.run_config(["--profile", "scale10"]))
    assert (config.momentum * config.scale, config.makers, config.window_us) == (60_000, 3, 10_000)


@pytest.mark.parametrize("args", [["--seconds", "0.001"], ["--seconds", "nan"], ["--scale", "0"], ["--seed", "-1"], ["--momentum", "-4"], ["--output", ""], ["--profile", "other"], ["--seconds", "x"]])
def test_wrong_run_configurations(args):
    with pytest.raises(SystemExit):
        tables.run_config(args)


def test_stage_clock(spark):
    clock = results.StageClock(2, "here")
    with clock.stage("match"):
        pass
    with pytest.raises(ZeroDivisionError), clock.stage("match"):
        1 / 0
    rows = results.combined_stages(results.gathered([clock.rows(spark), results.StageClock(3, "there", [(3, "there", "match", -1.0)]).rows(spark)])).collect()
    assert {(r["rank"], r["calls"]) for r in rows} == {(2, 2), (3, 1)} and {r["rank"]: r["total_seconds"] for r in rows}[3] == 0.0


def test_two_pass_windows_of_a_hot_book(spark):
    """One book with almost all rows, null keys, ties and nulls in the order, against plain windows."""
    from pyspark.sql import Window

    rows = [(7 if i % 10 else (None if i % 20 else 1), None if i % 97 == 0 else (i * 37) % 400, i, float(i % 13) if i % 5 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "book_id long, t long, id long, x double")
    w = Window.partitionBy("book_id").orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.sum("x").over(upto).alias("s"), F.max("x").over(upto).alias("m"), F.last("x", ignorenulls=True).over(upto).alias("k"), F.row_number().over(w).alias("n"), F.lag("x", 3).over(w).alias("b"))
    for width in (None, 50):
        got = flow.running(df, ["book_id"], ["t", "id"], {"s": F.col("x")}, {"m": F.col("x")}, width=width)
        got = windows.row_numbers(flow.carry_forward(got, ["book_id"], ["t", "id"], F.col("x"), "k", width), ["book_id"], ["t", "id"], "n", width)
        got = windows.framed(got, ["book_id"], ["t", "id"], 3, lambda v: {"b": F.lag("x", 3).over(v)}, width, block=64).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    exact = df.groupBy("book_id").agg(F.coalesce(F.percentile("x", F.lit(0.9)), F.lit(0.0)).alias("p"), F.coalesce(F.percentile("x", F.lit(0.5)), F.lit(0.0)).alias("q"))
    assert sorted(map(str, stats.percentiles(df, ["book_id"], "x", {"p": 0.9, "q": 0.5}).collect())) == sorted(map(str, exact.collect()))


def test_calibration_outputs(spark, tmp_path):
    losses = spark.createDataFrame([(1, 0.5), (0, 0.25)], "candidate_id long, loss double")
    moments = spark.createDataFrame([(0, "a", 1 / 3), (1, "a", 2.0)], "candidate_id long, name string, value double")
    sinks.write_calibration(losses, moments, str(tmp_path / "cal"))
    assert spark.read.parquet(str(tmp_path / "cal/candidates")).count() == 2
    assert spark.read.csv(str(tmp_path / "cal/best"), header=True).first()["loss"] == "0.25"
    assert [r["value"] for r in spark.read.csv(str(tmp_path / "cal/best_moments"), header=True).collect()] == ["0.333333333333"]


def test_late_and_future(spark):
    df = spark.createDataFrame([(5,), (10,), (11,)], "t long")
    due, later = flows.split_due(df, "t", 10)
    assert due.count() == 1 and later.count() == 2
    assert sorted(r[0] for r in flows.clamp_late(df, "t", 10).collect()) == [10, 10, 11]


def test_wall_clock_limit(spark, tmp_path):
    endless = spark.readStream.format("rate").option("rowsPerSecond", 5).load().writeStream.format("memory").queryName("endless").option("checkpointLocation", str(tmp_path / "c")).start()
    assert flows.run_for(endless, 2) == "limit" and not endless.isActive
    short = spark.readStream.schema("k long").parquet(str(tmp_path)).writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
    assert flows.run_for(short, 60) == "completed"
    assert flows.batch_horizon({"market_maker": 0.02, "momentum": 1.0}, ["momentum", "market_maker"]) == "20 milliseconds"


def test_maker_settings(spark, tmp_path):
    from orderlens.operators import agents

    books = tables.resolved_books(spark, None, 2).withColumn("beta", F.when(F.col("book_id") == 1, 0.0).otherwise(1.0))
    rows = {r["book_id"]: r["faults"] for r in agents.maker_settings(books, latency_ns=-1).collect()}
    assert rows == {0: ["latency"], 1: ["beta", "latency"]} and agents.maker_settings(books.where("book_id = 0")).first()["faults"] == []
