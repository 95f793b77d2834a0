"""More of the catalogue: ledgers, gates, counters, checks and summaries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import market, rng
from ..functions.windows import lagged, row_numbers
from ..operators import agents, book, fifo, flow, merging, results
from .catalogue import BOOK, CUT, DAY, E, ORDER, SLICE, SPLITMIX, STAGES, START, TRADES, UPTO, W, basket_arbitrage, events, query, rounded, table, trades


def stages(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 8).alias("rank"), F.col("o_orderpriority").alias("stage"), F.col("o_totalprice").alias("seconds"))


@query(f"WITH {STAGES} SELECT rank, stage, round(sum(greatest(0, seconds)), 2) AS total_seconds, count(*) AS calls, round(sum(greatest(0, seconds)) / count(*), 4) AS mean_seconds FROM s GROUP BY rank, stage")
def rank_stage_means(spark, sf_dir):
    out = results.combined_stages(stages(spark, sf_dir))
    return out.withColumns({"total_seconds": F.round("total_seconds", 2), "mean_seconds": F.round("mean_seconds", 4)})


KIND_OF = {"market_makers": "1-URGENT", "momentum": "2-HIGH", "informed": "3-MEDIUM", "institutional": "4-NOT SPECIFIED"}
PROFILE = ", ".join(f"count(DISTINCT CASE WHEN o_orderpriority = '{p}' THEN o_custkey END) AS local_{k}" for k, p in KIND_OF.items())
COUNTERS = {
    "strategic_orders_generated": "true", "strategic_orders_received_exchange": "o_custkey % 8 = 0", "strategic_orders_processed": "o_orderstatus = 'F'", "background_orders_processed": "o_orderstatus = 'P'",
    "reports_created": "o_orderstatus <> 'O'", "reports_received": "o_orderstatus <> 'O' AND o_custkey % 8 <> 0", "fill_reports": "o_orderstatus = 'F' AND o_totalprice > 1000", "order_result_reports": "o_orderstatus = 'P' AND o_totalprice > 1000",
}
SIZES = {"order_bytes_sent": ("strategic_orders_generated", 80), "order_bytes_received_exchange": ("strategic_orders_received_exchange", 80), "report_bytes_sent_exchange": ("reports_created", 64), "report_bytes_received": ("reports_received", 64)}


@query(f"""WITH r AS (SELECT o_custkey % 8 AS rank, {PROFILE}, count(DISTINCT o_orderdate) AS windows, {", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in COUNTERS.items())} FROM orders GROUP BY ALL)
SELECT rank, 'host' || (rank // 4) AS host, CASE WHEN rank = 0 THEN 'exchange' ELSE 'agents' END AS role, {", ".join(f"local_{k}" for k in KIND_OF)}, {" + ".join(f"local_{k}" for k in KIND_OF)} AS local_total_agents, windows, {", ".join(COUNTERS)},
{", ".join(f"{of} * {size} AS {n}" for n, (of, size) in SIZES.items())}, greatest(0, strategic_orders_generated - strategic_orders_processed) AS peak_pending_orders FROM r""")
def rank_profile(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("rank", F.col("o_custkey") % 8)
    kinds = [F.countDistinct(F.when(F.col("o_orderpriority") == p, F.col("o_custkey"))).alias(f"local_{k}") for k, p in KIND_OF.items()]
    out = df.groupBy("rank").agg(*kinds, F.countDistinct("o_orderdate").alias("windows"), *[F.count_if(F.expr(c)).alias(n) for n, c in COUNTERS.items()])
    total = sum((F.col(f"local_{k}") for k in KIND_OF), F.lit(0))
    return out.select(
        "rank", F.concat(F.lit("host"), F.floor(F.col("rank") / 4)).alias("host"), market.role(F.col("rank") == 0, F.col("rank") > 0).alias("role"), *[f"local_{k}" for k in KIND_OF], total.alias("local_total_agents"), "windows", *COUNTERS,
        *[(F.col(of) * size).alias(n) for n, (of, size) in SIZES.items()], F.greatest(F.lit(0), F.col("strategic_orders_generated") - F.col("strategic_orders_processed")).alias("peak_pending_orders"),
    )


@query(f"WITH {STAGES}, r AS (SELECT rank, sum(CASE WHEN stage LIKE '1%' OR stage LIKE '2%' THEN seconds ELSE 0 END) AS c, sum(CASE WHEN stage = '5-LOW' THEN seconds ELSE 0 END) AS a, count(*) FILTER (stage = '5-LOW') AS n FROM s GROUP BY rank) SELECT round(max(a), 2) AS max_agent_seconds, round(max(c), 2) AS max_communication_seconds, round(avg(c), 2) AS mean_communication_seconds, CAST(sum(n) AS BIGINT) AS generated FROM r")
def run_rollup(spark, sf_dir):
    return rounded(results.run_rollup(stages(spark, sf_dir), ["1-URGENT", "2-HIGH"], "5-LOW"), 2)


@query(f"""{E}, d AS (SELECT *, abs(value - lag(value) OVER {W}) > 100 AS gone FROM e)
SELECT book_id, round(coalesce(count(*) FILTER (event_type IN ('purchase', 'signup') AND gone) / nullif(count(*) FILTER (event_type IN ('purchase', 'signup')), 0), 0), 9) AS market_order_best_removal_rate,
round(coalesce(count(*) FILTER (event_type = 'error' AND gone) / nullif(count(*) FILTER (event_type = 'error'), 0), 0), 9) AS cancel_best_removal_rate FROM d GROUP BY book_id""")
def removal_rates(spark, sf_dir):
    df = lagged(events(spark, sf_dir), BOOK, ORDER, {"before": ("value", 1)}, SLICE).withColumn("gone", F.coalesce(F.abs(F.col("value") - F.col("before")) > 100, F.lit(False)))
    return rounded(results.removal_rates(df, BOOK, "event_type", "gone", ["purchase", "signup"], ["error"]))


@query(f"{E} SELECT book_id, count(*) AS reports, count(*) FILTER (event_type IN ('purchase', 'signup')) AS fill_reports, count(*) FILTER (event_type NOT IN ('purchase', 'signup')) AS order_result_reports FROM e GROUP BY book_id")
def report_split(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("kind", F.when(F.col("event_type").isin("purchase", "signup"), "FILL").otherwise("ORDER_RESULT"))
    return results.report_counts(df, BOOK)


@query(f"{E} SELECT book_id, count(*) AS generated, count(*) FILTER (t_us < {CUT}) AS processed, count(*) FILTER (t_us >= {CUT}) AS pending_end, true AS conserved FROM e GROUP BY book_id")
def message_conservation(spark, sf_dir):
    return results.conservation(events(spark, sf_dir), BOOK, "t_us", CUT)


@query(f"{E} SELECT book_id, bool_and(value > 1 AND k < 99) AS structurally_valid, count(*) FILTER (NOT value > 1) AS price_broken, count(*) FILTER (NOT k < 99) AS quantity_broken FROM e GROUP BY book_id")
def book_validity(spark, sf_dir):
    return results.structural_validity(events(spark, sf_dir), BOOK, {"price": F.col("value") > 1, "quantity": F.col("k") < 99})


@query(f"{E} SELECT book_id, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'signup') AS n_signup, count(*) FILTER (event_type = 'error') AS n_error, count(*) AS messages FROM e GROUP BY book_id")
def message_totals(spark, sf_dir):
    kinds = ["view", "click", "purchase", "signup", "error"]
    counted = events(spark, sf_dir).groupBy("book_id").agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds])
    return results.message_total(counted, [f"n_{k}" for k in kinds])


@query(f"{E} SELECT event_id, book_id, CAST(t_us // 1000000 AS BIGINT) AS t_s FROM e WHERE (t_us // 1000000) % 60 = 0")
def boundary_samples(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", "book_id", F.floor(F.col("t_us") / 1_000_000).cast("long").alias("t_s"))
    return results.at_boundaries(df, "t_s", 60)


@query(f"""{E}, x AS (SELECT *, {START} + (book_id % 10) * {DAY} AS s FROM e WHERE event_type = 'purchase'), y AS (SELECT *, sum(k) OVER {UPTO} AS upto FROM x WHERE t_us BETWEEN s AND s + {15 * DAY})
SELECT event_id, book_id, CAST(greatest(0, 300 - upto + k) AS BIGINT) AS remaining FROM y WHERE greatest(0, 300 - upto + k) > 0""")
def institutional_wakes(spark, sf_dir):
    start = START + (F.col("book_id") % 10) * DAY
    df = events(spark, sf_dir).where("event_type = 'purchase'")
    return results.active_orders(df, BOOK, ORDER, "k", start, start + 15 * DAY, 300, SLICE).select("event_id", "book_id", "remaining")


@query(f"{E} SELECT event_type, count(*) FILTER (k > 50) AS over, count(*) FILTER (k >= 50) AS reached FROM e GROUP BY event_type")
def threshold_variants(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(*[F.count_if(market.passes(F.col("k"), 50, inclusive)).alias(name) for name, inclusive in (("over", False), ("reached", True))])


SIDED = f"{E}, f AS (SELECT event_id, book_id, t_us, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS side, k, CAST(floor(value * 100) AS BIGINT) AS price FROM e WHERE event_type IN ('purchase', 'signup'))"


def sided(spark, sf_dir):
    df = events(spark, sf_dir).where("event_type in ('purchase', 'signup')")
    return df.select("event_id", "book_id", "t_us", F.when(F.col("event_type") == "purchase", 1).otherwise(-1).alias("side"), "k", F.floor(F.col("value") * 100).cast("long").alias("price"))


@query(f"{SIDED}, i AS (SELECT *, sum(side * k) OVER {UPTO} - side * k AS inventory FROM f) SELECT event_id, book_id, side, CAST(inventory AS BIGINT) AS inventory, CASE WHEN side > 0 THEN inventory < 100 ELSE inventory > -100 END AS allowed FROM i")
def risk_gates(spark, sf_dir):
    return results.gated(sided(spark, sf_dir), BOOK, ORDER, "side", "k", 100, SLICE).select("event_id", "book_id", "side", "inventory", "allowed")


@query(f"{SIDED} SELECT event_id, book_id, CAST(sum(side * k) OVER {UPTO} AS BIGINT) AS inventory, CAST(sum(-side * k * price) OVER {UPTO} AS BIGINT) AS cash FROM f")
def running_position(spark, sf_dir):
    return results.ledger(sided(spark, sf_dir), BOOK, ORDER, "side", "k", "price", SLICE).select("event_id", "book_id", "inventory", "cash")


@query(f"{E} SELECT c_mktsegment AS agent_kind, count(*) AS reports, CAST(sum(k) AS BIGINT) AS quantity FROM e JOIN customer ON c_custkey = book_id GROUP BY c_mktsegment")
def agent_lookup(spark, sf_dir):
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_mktsegment").alias("agent_kind"))
    return agents.to_owners(events(spark, sf_dir), owners, "book_id").groupBy("agent_kind").agg(F.count(F.lit(1)).alias("reports"), F.sum("k").alias("quantity"))


@query(f"WITH {TRADES}, m AS (SELECT s_suppkey AS o FROM supplier WHERE s_acctbal < 2000 UNION SELECT p_partkey + 1000000 FROM part WHERE p_size < 3) SELECT side, count(*) AS trades, CAST(sum(q) AS BIGINT) AS quantity FROM t WHERE a IN (SELECT o FROM m) OR b IN (SELECT o FROM m) GROUP BY side")
def maker_trades(spark, sf_dir):
    makers = table(spark, sf_dir, "supplier").where("s_acctbal < 2000").select(F.col("s_suppkey").alias("owner")).union(table(spark, sf_dir, "part").where("p_size < 3").select(F.col("p_partkey") + 1_000_000))
    return results.trades_of_makers(trades(spark, sf_dir), makers).groupBy("side").agg(F.count(F.lit(1)).alias("trades"), F.sum("q").alias("quantity"))


@query("""WITH p AS (SELECT o_orderkey AS sequence, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * CAST(floor(o_totalprice / 1000) AS BIGINT) AS quantity FROM orders WHERE o_totalprice >= 1000),
f AS (SELECT l_orderkey AS sequence, CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END * CAST(l_quantity AS BIGINT) AS filled FROM lineitem),
d AS (SELECT p.sequence, CAST(sum(f.filled) AS BIGINT) AS filled FROM p JOIN f ON p.sequence = f.sequence AND sign(p.quantity) = sign(f.filled) GROUP BY p.sequence)
SELECT p.sequence, quantity, coalesce(filled, 0) AS filled, CAST(sign(quantity) * greatest(0, abs(quantity) - abs(coalesce(filled, 0))) AS BIGINT) AS "left" FROM p LEFT JOIN d USING (sequence)""")
def hedge_fills(spark, sf_dir):
    size = F.floor(F.col("o_totalprice") / 1000).cast("long")
    pending = table(spark, sf_dir, "orders").where("o_totalprice >= 1000").select(F.col("o_orderkey").alias("sequence"), (F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1) * size).alias("quantity"))
    fills = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sequence"), (F.when(F.col("l_returnflag") == "R", 1).otherwise(-1) * F.col("l_quantity").cast("long")).alias("filled"))
    return results.matched_hedges(pending, fills)


@query(f"{E}, d AS (SELECT *, CAST(t_us // {DAY} AS BIGINT) AS day, row_number() OVER (PARTITION BY book_id, t_us // {DAY} ORDER BY t_us, event_id) AS n FROM e WHERE event_type = 'purchase') SELECT book_id, day, event_id, value FROM d WHERE n = 1")
def first_maker_trade(spark, sf_dir):
    df = events(spark, sf_dir).where("event_type = 'purchase'").withColumn("day", F.floor(F.col("t_us") / DAY).cast("long"))
    return results.first_trade(df, ["book_id", "day"], ORDER, ["event_id", "value"])


@query(f"""{E} SELECT event_id, book_id, round(coalesce(stddev_samp(value) OVER (PARTITION BY book_id ORDER BY t_us, event_id ROWS 29 PRECEDING), 0), 6) AS volatility,
round(list_reduce(list(value) OVER {UPTO}, lambda a, b: 0.8::DOUBLE * a + 0.2::DOUBLE * b), 6) AS ewma FROM e""")
def rolling_volatility(spark, sf_dir):
    return rounded(results.rolling(events(spark, sf_dir), BOOK, ORDER, "value", width=SLICE).select("event_id", "book_id", "volatility", "ewma"), 6)


@query(f"{E}, c AS (SELECT *, last_value(CASE WHEN k % 5 <> 0 THEN value END IGNORE NULLS) OVER {UPTO} AS known FROM e) SELECT book_id, count(*) AS samples, count(*) FILTER (k % 5 = 0 AND known IS NOT NULL) AS stale, count(*) FILTER (known IS NULL) AS missing FROM c GROUP BY book_id")
def stale_snapshots(spark, sf_dir):
    return results.stale_uses(events(spark, sf_dir), BOOK, ORDER, F.col("k") % 5 != 0, "value", SLICE)


FLOW_KINDS = ("view", "click", "purchase", "signup")


@query(f"{E} SELECT book_id, " + ", ".join(f"count(*) FILTER (event_type = '{n}') AS {n}_events, round(coalesce(avg(CASE WHEN event_type = '{n}' THEN k END), 0), 9) AS {n}_mean_quantity" for n in FLOW_KINDS) + ", count(*) FILTER (event_type = 'error') AS owner_cancel_messages FROM e GROUP BY book_id")
def calibration_record(spark, sf_dir):
    return rounded(results.recorder(events(spark, sf_dir), BOOK, "event_type", "k", FLOW_KINDS, "error"))


SAMPLES = f"{E}, s AS (SELECT book_id, t_us, event_id, CAST(floor(value * 100) AS BIGINT) AS best_bid, CAST(floor(value * 100) AS BIGINT) + (k - 5) * 100 AS best_ask, k AS bid_depth, 2 * k AS ask_depth, row_number() OVER (PARTITION BY book_id ORDER BY t_us, event_id) AS n_events FROM e)"


def sampled(spark, sf_dir):
    bid = F.floor(F.col("value") * 100).cast("long")
    df = events(spark, sf_dir).select("book_id", "t_us", "event_id", bid.alias("best_bid"), (bid + (F.col("k") - 5) * 100).alias("best_ask"), F.col("k").alias("bid_depth"), (2 * F.col("k")).alias("ask_depth"), F.lit(1).alias("one"))
    return flow.running(df, BOOK, ORDER, {"n_events": F.col("one")}, width=SLICE)


@query(f"""{SAMPLES}, v AS (SELECT *, best_bid > 0 AND best_ask > best_bid AS ok, (best_bid + best_ask) / 2 AS mid FROM s), c AS (SELECT book_id, count(*) AS n, count(*) FILTER (NOT ok) AS bad, CAST(max(n_events) AS BIGINT) AS events, avg(CASE WHEN ok THEN (best_ask - best_bid) / 100 END) AS spread, avg(CASE WHEN ok THEN bid_depth END) AS bid, avg(CASE WHEN ok THEN ask_depth END) AS ask FROM v GROUP BY book_id),
g AS (SELECT *, lag(mid) OVER {W} AS b FROM v WHERE ok), r AS (SELECT *, ln(mid) - ln(b) AS r FROM g WHERE b IS NOT NULL), l AS (SELECT *, abs(r) AS a, lag(abs(r)) OVER {W} AS ab FROM r),
m AS (SELECT book_id, avg(r) AS m1, avg(r * r) AS m2, avg(r * r * r * r) AS m4, avg(a) AS am, avg(a * a) AS a2, avg(a * ab) AS x, avg(CASE WHEN mid <> b THEN 1.0 ELSE 0.0 END) AS moved FROM l GROUP BY book_id)
SELECT c.book_id, n AS sample_count, 60 AS expected_sample_count, bad AS invalid_sample_count, n = 60 AND bad = 0 AS structurally_valid, events AS background_event_count, round(events / 86400.0, 9) AS background_event_rate, round(coalesce(spread, 0), 6) AS mean_spread_ticks, round(coalesce(bid, 0), 6) AS mean_bid_depth, round(coalesce(ask, 0), 6) AS mean_ask_depth,
round(coalesce(moved, 0), 6) AS mid_move_rate, round(coalesce(m2 - m1 * m1, 0), 6) AS return_variance, round(coalesce(CASE WHEN m2 - m1 * m1 > 2.2e-16 THEN m4 / pow(m2 - m1 * m1, 2) END, 0), 6) AS return_kurtosis, round(coalesce(CASE WHEN a2 - am * am > 2.2e-16 THEN (x - am * am) / (a2 - am * am) END, 0), 6) AS absolute_return_acf1 FROM c LEFT JOIN m USING (book_id)""")
def asset_summary(spark, sf_dir):
    out = results.asset_summary(sampled(spark, sf_dir), BOOK, ORDER, 100, 60, 86400.0, ["n_events"], SLICE)
    return rounded(out.withColumn("background_event_rate", F.round("background_event_rate", 9)), 6).withColumn("background_event_rate", F.round(F.col("background_event_count") / 86400.0, 9))


@query(f"""WITH s AS (SELECT s_suppkey AS event_id, s_name, CAST(floor(abs(s_acctbal)) AS BIGINT) AS depth FROM supplier), {SPLITMIX.replace(E, "").lstrip(", ").replace("FROM e, (VALUES (1), (2))", "FROM s, (VALUES (1))")},
o AS (SELECT s.*, row_number() OVER (ORDER BY CASE WHEN c.z >= 9223372036854775808 THEN CAST(c.z::HUGEINT - 18446744073709551616 AS BIGINT) ELSE CAST(c.z AS BIGINT) END, event_id) AS n, (SELECT greatest(1, CAST(round(0.1 * count(*)) AS BIGINT)) FROM s) AS k FROM s JOIN c USING (event_id))
SELECT event_id AS asset_id, s_name AS symbol, CASE WHEN n <= k THEN 1 ELSE 0 END AS is_shock_target, 1 AS shock_enabled, CAST(CASE WHEN n <= k THEN greatest(1, round(depth * 1.5)) ELSE 0 END AS BIGINT) AS counterfactual_sell_quantity FROM o""")
def shock_targets(spark, sf_dir):
    books = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("book_id"), F.col("s_name").alias("symbol"), F.floor(F.abs("s_acctbal")).cast("double").alias("bid_depth"))
    return results.shock_targets(books, 0.1, 1, 1.5)


@query(f"""{E}, o AS (SELECT *, first_value(k) OVER {W} AS k0, first_value(value) OVER {W} AS v0 FROM e), f AS (SELECT CAST(t_us // {DAY} AS BIGINT) AS day, book_id % 3 = 0 AS hit, k > 5 AS sided, k, value, NOT k > 5 OR k > 2 * k0 OR value < 0.5 * v0 AS bad FROM o)
SELECT day, round(avg(CASE WHEN sided THEN k END), 6) AS mean_spread, round(avg(value), 6) AS mean_top_depth, round(avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END), 9) AS affected, round(avg(CASE WHEN sided THEN 1.0 ELSE 0.0 END), 9) AS two_sided,
round(avg(CASE WHEN hit THEN CASE WHEN bad THEN 1.0 ELSE 0.0 END END), 9) AS affected_shocked, round(avg(CASE WHEN NOT hit THEN CASE WHEN bad THEN 1.0 ELSE 0.0 END END), 9) AS affected_unshocked, round(avg(CASE WHEN hit AND sided THEN k END), 6) AS spread_shocked, round(avg(CASE WHEN NOT hit AND sided THEN k END), 6) AS spread_unshocked,
round(avg(CASE WHEN hit THEN value END), 6) AS depth_shocked, round(avg(CASE WHEN NOT hit THEN value END), 6) AS depth_unshocked FROM f GROUP BY day""")
def contagion(spark, sf_dir):
    df = events(spark, sf_dir)
    first = df.groupBy("book_id").agg(F.min_by(F.struct(F.col("k").alias("spread_0"), F.col("value").alias("depth_0")), F.struct(*ORDER)).alias("f")).select("book_id", "f.*")
    rows = df.join(first, "book_id").select(F.floor(F.col("t_us") / DAY).cast("long").alias("day"), (F.col("book_id") % 3 == 0).alias("hit"), (F.col("k") > 5).alias("sided"), F.col("k").alias("spread"), F.col("value").alias("depth"), "spread_0", "depth_0")
    out = results.contagion_sums(rows, ["day"])
    return out.select("day", *[F.round(c, 9 if c.startswith(("affected", "two")) else 6).alias(c) for c in out.columns if c != "day"])


@query(f"{E}, o AS (SELECT event_id, book_id, t_us, lag(t_us) OVER (PARTITION BY book_id ORDER BY event_id) AS b FROM e) SELECT book_id, count(*) FILTER (t_us <= b) AS violations FROM o GROUP BY book_id")
def key_order(spark, sf_dir):
    df = lagged(events(spark, sf_dir), BOOK, ["event_id"], {"before": ("t_us", 1)})
    return df.groupBy("book_id").agg(F.count_if(F.col("t_us") <= F.col("before")).alias("violations"))


@query(f"""{E} SELECT event_id, CASE WHEN k > 5 THEN (k - 5) / 100.0 END AS spread_ticks, k * CAST(floor(value) AS BIGINT) AS notional, CAST(k * 1000000 + event_id % 1000 + 1 AS BIGINT) AS owner, CAST(k AS BIGINT) AS owner_rank, CAST(event_id % 1000 AS BIGINT) AS owner_index,
CASE k % 7 WHEN 0 THEN 'limit_buy' WHEN 1 THEN 'limit_sell' WHEN 2 THEN 'market_buy' WHEN 3 THEN 'market_sell' WHEN 4 THEN 'cancel_bid' WHEN 5 THEN 'cancel_ask' END AS event_name, CAST(greatest(1, round(k * 0.35::DOUBLE)) AS BIGINT) AS scaled, CAST(round(value * 1e9) AS BIGINT) AS duration_ns,
round(CASE WHEN k - 50 > 0 THEN 1 - least(0.75, abs(k - 50) / 40.0) ELSE 1 + least(0.75, abs(k - 50) / 40.0) END, 9) AS bid_scale, round(CASE WHEN k - 50 < 0 THEN 1 - least(0.75, abs(k - 50) / 40.0) ELSE 1 + least(0.75, abs(k - 50) / 40.0) END, 9) AS ask_scale,
CAST(greatest(1, round(k * 2.5)) AS BIGINT) AS shock, 77::BIGINT AS fixed_shock, (k << 56) | event_id AS rank_sequence, (k << 32) | event_id AS owner_sequence, round(CASE WHEN k > 5 THEN (k - 5) * 10000.0 / value END, 6) AS spread_bps, round((k - value) / 25, 9) AS mispricing_ticks FROM e""")
def scalar_projections(spark, sf_dir):
    k, i, v = F.col("k"), F.col("event_id"), F.col("value")
    owner = market.owner_id(k, i % 1000)
    bid, ask = market.inventory_scales(k - 50, F.lit(40))
    return events(spark, sf_dir).select(
        "event_id", market.spread_ticks(F.lit(5), k, 100).alias("spread_ticks"), market.notional(k, F.floor(v)).alias("notional"), owner.cast("long").alias("owner"), market.owner_rank(owner).alias("owner_rank"), market.owner_index(owner).alias("owner_index"),
        market.event_name((k % 7).cast("int")).alias("event_name"), market.scaled_quantity(k, 0.35).alias("scaled"), market.seconds_to_ns(v).alias("duration_ns"), F.round(bid, 9).alias("bid_scale"), F.round(ask, 9).alias("ask_scale"),
        market.shock_size(k, 2.5).alias("shock"), market.shock_size(k, 2.5, 77).alias("fixed_shock"), market.rank_sequence(k, i).alias("rank_sequence"), market.owner_sequence(k, i).alias("owner_sequence"),
        F.round(market.spread_bps(F.lit(5), k, v), 6).alias("spread_bps"), F.round(market.mispricing_ticks(k, v, 25), 9).alias("mispricing_ticks"),
    )


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def joined_values(spark, sf_dir):
    # A region has as many names as nations.
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


M64 = "18446744073709551616::UHUGEINT"


def draws_sql(source: str, columns: str) -> str:
    """Three steps of splitmix64 over a relation with columns seed and n, and the finished draw as z."""
    return f"""d0 AS (SELECT {columns}, CAST((CAST(seed AS UHUGEINT) + n::UHUGEINT * {rng.GOLDEN}::UHUGEINT) % {M64} AS UBIGINT) AS z FROM {source}),
d1 AS (SELECT {columns}, CAST((xor(z, z >> 30)::UHUGEINT * {rng.MIX_1}::UHUGEINT) % {M64} AS UBIGINT) AS z FROM d0), d2 AS (SELECT {columns}, CAST((xor(z, z >> 27)::UHUGEINT * {rng.MIX_2}::UHUGEINT) % {M64} AS UBIGINT) AS z FROM d1),
d AS (SELECT {columns}, greatest(1e-12, (xor(z, z >> 31) >> 11) / 9007199254740992.0::DOUBLE) AS u FROM d2)"""


WALK = f"""{E}, o AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY t_us, event_id) AS step FROM e), g AS (SELECT book_id, step, x.i AS part, 7 * 1000003 + book_id AS seed, 2 * step + x.i AS n FROM o, range(2) x(i)), {draws_sql("g", "book_id, step, part")},
z AS (SELECT book_id, step, sqrt(-2 * ln(max(CASE WHEN part = 0 THEN u END))) * cos(2 * pi() * max(CASE WHEN part = 1 THEN u END)) AS z FROM d GROUP BY book_id, step)"""
STEP = "(PARTITION BY book_id ORDER BY step ROWS UNBOUNDED PRECEDING)"


def walk_grid(spark, sf_dir):
    """A step for each event of a book."""
    return row_numbers(events(spark, sf_dir).select("book_id", "t_us", "event_id"), BOOK, ORDER, "step", SLICE).select("book_id", F.col("step").cast("long").alias("step"))


@query(f"{WALK} SELECT book_id, step, round(2203550.0 * exp(sum(0.0001::DOUBLE * z - 0.000000005::DOUBLE) OVER {STEP}), 4) AS fundamental FROM z")
def fundamental_path(spark, sf_dir):
    return rounded(agents.fundamental_path(walk_grid(spark, sf_dir), BOOK, "step", 2203550.0, 1.0, 7), 4)


@query(f"{WALK} SELECT book_id, step, round(2203550.0 + sum(z * 0.03 * sqrt(10) * 100) OVER {STEP}, 4) AS fundamental FROM z")
def gaussian_walk(spark, sf_dir):
    return rounded(agents.gaussian_walk(walk_grid(spark, sf_dir), BOOK, "step", 2203550.0, 0.03, 10.0, 100, 7), 4)


KIND_ROWS = [("market_maker", 3, 50.0), ("momentum", 600, 0.20), ("informed", 290, 0.05), ("institutional", 10, 0.01)]


@query(f"""WITH k(kind, agents, rate, code) AS (VALUES {", ".join(f"('{k}', {n}, {r}::DOUBLE, {i + 1})" for i, (k, n, r) in enumerate(KIND_ROWS))}), a AS (SELECT kind, rate, code * 1000000 + c_custkey + 1 AS owner FROM customer JOIN k ON c_custkey % 4 = code - 1),
g AS (SELECT owner, kind, rate, x.i AS n, owner + 42 AS seed FROM a, range(1, 8) x(i)), {draws_sql("g", "owner, kind, rate, n")}, w AS (SELECT owner, kind, rate, {", ".join(f"max(CASE WHEN n = {i} THEN u END) AS u{i}" for i in range(1, 8))} FROM d GROUP BY owner, kind, rate)
SELECT owner, kind, rate AS wake_rate, CAST(greatest(1, round(-ln(u1) / rate * 1e9)) AS BIGINT) AS first_wake_ns, CASE WHEN kind = 'institutional' THEN CASE WHEN u2 < 0.5 THEN 1 ELSE -1 END END AS side, CAST(CASE WHEN kind = 'institutional' THEN 10000 + floor(u3 * 90001) END AS BIGINT) AS parent,
CAST(CASE WHEN kind = 'institutional' THEN 100 + floor(u4 * 901) END AS BIGINT) AS child, round(CASE WHEN kind = 'institutional' THEN least(greatest(0.1 * (0.75 + 0.5 * u5), 0.001), 0.95) END, 9) AS cap, round(CASE WHEN kind = 'institutional' THEN 0.2 * u6 END, 9) AS start_share, round(CASE WHEN kind = 'institutional' THEN 0.8 + 0.2 * u7 END, 9) AS end_share FROM w""")
def agent_population(spark, sf_dir):
    """Each customer as an agent of one of four kinds."""
    kinds = F.array(*[F.lit(k) for k, _, _ in KIND_ROWS])
    code = (F.col("c_custkey") % 4).cast("int")
    owners = table(spark, sf_dir, "customer").select(market.owner_id(code + 1, F.col("c_custkey")).alias("owner"), F.get(kinds, code).alias("kind"))
    return rounded(agents.population_of(owners, 42))


@query(f"""{E}, g AS (SELECT event_id, event_id AS entity, book_id AS s, k AS child FROM e), a AS (SELECT *, entity::UBIGINT AS z FROM g),
{", ".join(f"m{j}a AS (SELECT * REPLACE (CAST((xor(z, z >> 30)::UHUGEINT * {rng.MIX_1}::UHUGEINT) % {M64} AS UBIGINT) AS z) FROM {before}), m{j}b AS (SELECT * REPLACE (CAST((xor(z, z >> 27)::UHUGEINT * {rng.MIX_2}::UHUGEINT) % {M64} AS UBIGINT) AS z) FROM m{j}a), m{j} AS (SELECT * REPLACE (CAST((xor(z, z >> 31)::UHUGEINT + {add}) % {M64} AS UBIGINT) AS z) FROM m{j}b)" for j, (before, add) in enumerate([("a", "s::UHUGEINT"), ("m0", "child::UHUGEINT"), ("m1", "0::UHUGEINT")]))}
SELECT event_id, CASE WHEN z >= 9223372036854775808 THEN CAST(z::HUGEINT - 18446744073709551616 AS BIGINT) ELSE CAST(z AS BIGINT) END AS stable_id FROM m2""")
def stable_ids(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", rng.stable_sequence(F.col("event_id"), F.col("book_id"), F.col("k")).alias("stable_id"))


@query(f"""{SIDED}, w AS (SELECT event_id, book_id, t_us + 5000 AS wake_us, 'traded' AS cause FROM f WHERE k >= 50 UNION ALL SELECT event_id, book_id, t_us + 20000, 'depleted' FROM f WHERE k = 99) SELECT * FROM w""")
def repair_wakes(spark, sf_dir):
    return agents.repair_wakes(sided(spark, sf_dir), F.col("k") >= 50, F.col("k") == 99, "t_us", 5000, 20_000)


BASKET = f"""{E}, s AS (SELECT t_us // {DAY} AS day, book_id % 4 AS book_id, avg(value) AS mid FROM e GROUP BY ALL),
p AS (SELECT day, 10000 * (max(CASE WHEN book_id = 0 THEN mid END) / (sum(CASE WHEN book_id <> 0 THEN book_id * mid END) / sum(CASE WHEN book_id <> 0 THEN book_id END)) - 1) AS x FROM s GROUP BY day),
c AS (SELECT day, CASE WHEN x > 800 THEN -1 WHEN x < -800 THEN 1 WHEN abs(x) < 200 THEN 0 END AS c FROM p), d AS (SELECT CAST(day AS BIGINT) AS day, coalesce(last_value(c IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 0) AS direction FROM c)"""


@query(f"""{BASKET} SELECT day, b.i AS book_id, CAST(CASE WHEN b.i = 0 THEN direction * 100 ELSE -direction * round(100 * b.i / 6.0::DOUBLE) END AS BIGINT) AS quantity FROM d, range(4) b(i) WHERE direction <> 0""")
def basket_legs(spark, sf_dir):
    weights = spark.range(4).select(F.col("id").alias("book_id"), F.col("id").cast("double").alias("weight"))
    return agents.basket_legs(basket_arbitrage(spark, sf_dir).select("day", "direction"), weights, ["day"], 100)


@query(f"""{E}, a AS (SELECT event_id, book_id, t_us, k, count(*) OVER (PARTITION BY book_id, k % 50, t_us // {DAY}) AS same, lag(t_us) OVER (PARTITION BY book_id ORDER BY event_id) AS before FROM e),
f AS (SELECT event_id, unnest([CASE WHEN book_id >= 140 OR book_id % 14 = 13 THEN 'book' END, CASE WHEN t_us < {START} + {DAY} THEN 'past' END, CASE WHEN t_us > {START} + {28 * DAY} THEN 'end' END, CASE WHEN k = 0 THEN 'quantity' END, CASE WHEN same > 1 THEN 'twice' END, CASE WHEN t_us <= before THEN 'order' END]) AS fault FROM a)
SELECT event_id, fault FROM f WHERE fault IS NOT NULL""")
def admission_faults(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("key", F.concat_ws("-", F.col("book_id").cast("string"), (F.col("k") % 50).cast("string"), F.floor(F.col("t_us") / DAY).cast("string")))
    df = lagged(df, BOOK, ["event_id"], {"before": ("t_us", 1)})
    known = (F.col("book_id") < 140) & (F.col("book_id") % 14 != 13)
    return results.admission_faults(df, "event_id", "key", known, F.col("t_us"), START + DAY, START + 28 * DAY, F.col("k"), F.col("before"))


@query(f"""{E}, g AS (SELECT event_id, book_id, k, t_us, (book_id << 32) | event_id AS seq FROM e), s AS (SELECT *, CAST(xor(seq::UBIGINT, 15111065706836454659::UBIGINT) AS UBIGINT) AS seed, 1 AS n FROM g), {draws_sql("s", "event_id, seq, k, t_us").replace("greatest(1e-12, (xor(z, z >> 31) >> 11) / 9007199254740992.0::DOUBLE) AS u", "xor(z, z >> 31) AS t")}
SELECT event_id, seq AS sequence, CASE WHEN t >= 9223372036854775808 THEN CAST(t::HUGEINT - 18446744073709551616 AS BIGINT) ELSE CAST(t AS BIGINT) END AS tie_breaker, t_us * 1000 AS generated_ns, t_us * 1000 + 5000 AS arrival_ns, k AS quantity FROM d WHERE k > 0""")
def order_messages(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", F.col("book_id").alias("owner"), F.col("event_id").alias("counter"), (F.col("t_us") * 1000).alias("generated_ns"), F.lit(5000).alias("latency_ns"), F.col("k").alias("quantity"), F.lit(0).alias("action"))
    return agents.order_messages(df).select("event_id", "sequence", "tie_breaker", "generated_ns", "arrival_ns", "quantity")


TAPE = ["event_id", "t_us", "k"]
VALUES = ", ".join("(" + f"(((event_id % {p}) * {a} + t_us % {p}) % {p}) * {a} + k % {p}" + f") % {p} AS v{i}" for i, (p, a, _) in enumerate(merging.MODULI))
FOLDS = ", ".join(f"list_reduce(list(v{i} ORDER BY {{order}}), lambda a, x: (a * {b} + x) % {p}) AS h{i}" for i, (p, _, b) in enumerate(merging.MODULI))


@query(f"{E}, v AS (SELECT book_id, event_id, t_us, {VALUES} FROM e), h AS (SELECT book_id, count(*) AS records, {FOLDS.format(order='t_us, event_id')} FROM v GROUP BY book_id) SELECT book_id, records, (h0 << 31) | h1 AS tape_digest FROM h")
def event_tape_digests(spark, sf_dir):
    """An order-sensitive digest of each book's events."""
    return merging.tape_digests(events(spark, sf_dir), BOOK, ORDER, TAPE, "records", "tape_digest", SLICE)


@query(f"{E}, v AS (SELECT book_id, event_id, t_us, {VALUES} FROM e), h AS (SELECT count(*) AS records, {FOLDS.format(order='book_id, t_us, event_id')} FROM v) SELECT records, (h0 << 31) | h1 AS tape_digest FROM h")
def combined_tape_digest(spark, sf_dir):
    """Of all books' tapes in order of book: tapes of books are joined, not hashed again."""
    books = merging.joined_tapes(merging.tape_parts(events(spark, sf_dir), BOOK, ORDER, TAPE, SLICE), BOOK, "_slice")
    whole = merging.joined_tapes(books, [], "book_id")
    return whole.select(F.col("n").alias("records"), merging.tape_digest(whole).alias("tape_digest"))


@query(f"""{E}, l AS (SELECT book_id, value, lag(value) OVER {W} AS b, avg(value) OVER (PARTITION BY book_id) AS m FROM e),
s AS (SELECT book_id, count(*) AS n, any_value(m) AS mean, sum((value - m) ** 2) AS m2, sum((value - m) ** 4) AS m4, sum((value - m) * (b - m)) AS c FROM l GROUP BY book_id)
SELECT book_id, n, round(mean, 6) AS mean, round(m2 / n, 4) AS variance, round(CASE WHEN m2 > 0 THEN n * m4 / (m2 * m2) ELSE 0 END, 6) AS kurtosis, round(CASE WHEN m2 > 0 THEN coalesce(c, 0) / m2 ELSE 0 END, 6) AS acf1 FROM s""")
def moments_of_days(spark, sf_dir):
    """Moments of each book's prices, merged from a state for each day."""
    days = merging.moment_states(events(spark, sf_dir), BOOK, ORDER, "value", F.floor(F.col("t_us") / DAY))
    out = merging.finished_moments(merging.merged_moments(days, BOOK), BOOK)
    return out.select("book_id", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), F.round("kurtosis", 6).alias("kurtosis"), F.round("acf1", 6).alias("acf1"))


@query(f"{E} SELECT event_type, CASE book_id % 20 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(market.STAGE_NAMES)) + " ELSE 'unknown' END AS stage, count(*) AS calls, CAST(max(t_us * 1000 + k) AS BIGINT) AS last_ns FROM e GROUP BY ALL")
def named_stages(spark, sf_dir):
    """Calls of each named stage, and when the last one ends."""
    end = market.checked_later(F.col("t_us") * 1000, F.col("k"))
    df = events(spark, sf_dir).select("event_type", market.stage_name((F.col("book_id") % 20).cast("int")).alias("stage"), end.alias("end_ns"))
    return df.groupBy("event_type", "stage").agg(F.count(F.lit(1)).alias("calls"), F.max("end_ns").alias("last_ns"))


PENDING = f"{E}, p AS (SELECT event_id, book_id, CAST(t_us // {DAY} AS BIGINT) AS arrival_ns, k % 4 AS action, CAST(k % 3 AS BIGINT) AS agent_kind, event_id AS sequence, event_id % 7 AS tie_breaker FROM e)"
PRIORITY = "CASE action WHEN 2 THEN 0 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END"


def pending(spark, sf_dir):
    k = F.col("k")
    return events(spark, sf_dir).select("event_id", "book_id", F.floor(F.col("t_us") / DAY).cast("long").alias("arrival_ns"), (k % 4).alias("action"), (k % 3).alias("agent_kind"), F.col("event_id").alias("sequence"), (F.col("event_id") % 7).alias("tie_breaker"))


@query(f"{PENDING} SELECT event_id, book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY arrival_ns, {PRIORITY}, agent_kind, sequence, tie_breaker) AS INTEGER) AS position FROM p")
def pending_positions(spark, sf_dir):
    """Each book's queue of pending orders."""
    return book.pending_positions(pending(spark, sf_dir), BOOK).select("event_id", "book_id", "position")


@query(f"{PENDING} SELECT event_id, arrival_ns, CAST(row_number() OVER (PARTITION BY arrival_ns ORDER BY {PRIORITY}, book_id, agent_kind, sequence, tie_breaker) AS INTEGER) AS position FROM p")
def shared_queue_positions(spark, sf_dir):
    """One queue for all books that orders of a day share."""
    return book.pending_positions(pending(spark, sf_dir), ["arrival_ns"], with_book=True).select("event_id", "arrival_ns", "position")


@query(f"""{E}, o AS (SELECT *, first_value(k) OVER {W} AS k0, first_value(value) OVER {W} AS v0 FROM e), f AS (SELECT CAST(t_us // {DAY} AS BIGINT) AS day, book_id % 3 = 0 AS hit, k > 5 AS sided, 10000 * k / value AS bps, value, k, NOT k > 5 OR 10000 * k / value > 2 * (10000 * k0 / v0) OR value < 0.5 * v0 AS bad FROM o)
SELECT day * 86400.0::DOUBLE AS time_seconds, round(coalesce(avg(CASE WHEN sided THEN bps END), 0), 6) AS mean_spread_bps, round(avg(value), 6) AS mean_top_depth, round(avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END), 9) AS affected_asset_fraction, round(avg(CASE WHEN sided THEN 1.0 ELSE 0.0 END), 9) AS two_sided_book_fraction,
round(coalesce(avg(CASE WHEN hit THEN CASE WHEN bad THEN 1.0 ELSE 0.0 END END), 0), 9) AS affected_shocked_fraction, round(coalesce(avg(CASE WHEN NOT hit THEN CASE WHEN bad THEN 1.0 ELSE 0.0 END END), 0), 9) AS affected_unshocked_fraction, round(coalesce(avg(CASE WHEN hit AND sided THEN bps END), 0), 6) AS shocked_mean_spread_bps, round(coalesce(avg(CASE WHEN NOT hit AND sided THEN bps END), 0), 6) AS unshocked_mean_spread_bps,
round(coalesce(avg(CASE WHEN hit THEN value END), 0), 6) AS shocked_mean_top_depth, round(coalesce(avg(CASE WHEN NOT hit THEN value END), 0), 6) AS unshocked_mean_top_depth, round(sum(k), 6)::DOUBLE AS shared_gross_exposure, round(greatest(0, least(1, 2 * (1 - sum(k) / 20000.0))), 9) AS shared_quote_scale FROM f GROUP BY day""")
def boundary_metrics(spark, sf_dir):
    """The state of all books at each day's end against their first one."""
    df = events(spark, sf_dir)
    bps = market.divided(10_000 * F.col("k"), F.col("value"))
    first = df.groupBy("book_id").agg(F.min_by(F.struct(bps.alias("spread_0"), F.col("value").alias("depth_0")), F.struct(*ORDER)).alias("f")).select("book_id", "f.*")
    rows = df.join(first, "book_id").select((F.floor(F.col("t_us") / DAY) * 86_400.0).alias("time_seconds"), (F.col("book_id") % 3 == 0).alias("hit"), (F.col("k") > 5).alias("sided"), bps.alias("spread"), F.col("value").alias("depth"), "spread_0", "depth_0", F.col("k").alias("exposure"))
    out = results.boundary_metrics(rows, "time_seconds", 20_000.0)
    return out.select(*[F.round(c, 9 if c.endswith(("fraction", "scale")) else 6).alias(c) for c in out.columns])


ACTIONS = {"view": "add", "purchase": "take", "signup": "cancel"}


def resting_flow(spark, sf_dir, price, distance):
    """Asks of each book: views rest, purchases take, signups cancel."""
    df = events(spark, sf_dir).where(F.col("event_type").isin(*ACTIONS))
    action = F.when(F.col("event_type") == "view", "add").when(F.col("event_type") == "purchase", "take").otherwise("cancel")
    return df.select("book_id", "t_us", "event_id", F.col("event_id").alias("id"), action.alias("action"), F.lit(-1).alias("side"), price.cast("long").alias("price"), distance.cast("long").alias("distance"), F.col("k").alias("quantity"))


def matched_totals(orders):
    fills, became = fifo.match_with_cancels(orders, BOOK, ORDER)
    pairs = fills.groupBy("book_id").agg(F.count(F.lit(1)).alias("fills"))
    sums = became.groupBy("book_id").agg(*[F.sum(c).alias(c) for c in ("filled", "cancelled", "resting")])
    return sums.join(pairs, "book_id", "left").select("book_id", F.coalesce("fills", F.lit(0)).alias("fills"), "filled", "cancelled", "resting")


@query(f"""{E}, x AS (SELECT book_id, event_type, k, row_number() OVER (PARTITION BY book_id ORDER BY t_us, event_id) AS n FROM e WHERE event_type IN ('view', 'purchase', 'signup') AND k > 0),
s AS (SELECT *, sum(CASE WHEN event_type = 'view' THEN k ELSE -k END) OVER (PARTITION BY book_id ORDER BY n) AS s FROM x), m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY book_id ORDER BY n)) AS q FROM s),
q AS (SELECT *, coalesce(lag(q) OVER (PARTITION BY book_id ORDER BY n), 0) AS q0 FROM m),
g AS (SELECT *, CASE event_type WHEN 'view' THEN k WHEN 'signup' THEN -least(k, q0) ELSE 0 END AS b, CASE WHEN event_type = 'purchase' THEN least(k, q0) ELSE 0 END AS f FROM q),
p AS (SELECT *, sum(b) OVER (PARTITION BY book_id ORDER BY n) AS back, sum(f) OVER (PARTITION BY book_id ORDER BY n) AS front FROM g),
l AS (SELECT *, min(back) OVER (PARTITION BY book_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM p),
mk AS (SELECT book_id, n, k, back - k AS a, greatest(back - k, least(back, low)) AS z FROM l WHERE event_type = 'view'), tk AS (SELECT book_id, front - f AS a, front AS z FROM l WHERE f > 0),
fl AS (SELECT mk.book_id, mk.n, count(*) AS fills, sum(least(mk.z, tk.z) - greatest(mk.a, tk.a)) AS filled FROM mk JOIN tk ON mk.book_id = tk.book_id AND mk.z > mk.a AND mk.a < tk.z AND tk.a < mk.z GROUP BY ALL)
SELECT mk.book_id, CAST(coalesce(sum(fills), 0) AS BIGINT) AS fills, CAST(coalesce(sum(filled), 0) AS BIGINT) AS filled, CAST(sum(k - (z - a)) AS BIGINT) AS cancelled, CAST(sum(z - a - coalesce(filled, 0)) AS BIGINT) AS resting FROM mk LEFT JOIN fl USING (book_id, n) GROUP BY mk.book_id""")
def lob_queue_with_cancels(spark, sf_dir):
    """One price level for each book, with cancels from the back of its queue."""
    return matched_totals(resting_flow(spark, sf_dir, F.when(F.col("event_type") != "purchase", F.lit(100)), F.lit(None)))


@query()
def lob_side_with_cancels(spark, sf_dir):
    """Many levels for each book; every other cancel names a distance from the best price of its time."""
    price = F.floor(F.col("value") / 25)
    absolute = (F.col("event_type") == "view") | ((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0))
    return matched_totals(resting_flow(spark, sf_dir, F.when(absolute, price), F.when((F.col("event_type") == "signup") & ~absolute, F.col("k") % 4)))
