"""The catalogue of queries and of their SQL twins.

The driver's tables stand for market data: an event is an order of its user's book (value: price, k in props: quantity; purchase buys and
signup sells at market, view and click rest a bid and an ask), a line item a trade of its supplier, an order a timed stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import market, rng, stats
from ..functions.windows import has_long, lagged
from ..operators import agents, book, flow, hawkes, merging, simulate
from ..streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

DAY, HOUR = 86_400_000_000, 3_600_000_000
#: Width of the slices of time that a book's series is cut into.
SLICE = 6 * HOUR
START = 1_704_067_200_000_000
E = r"WITH e AS (SELECT event_id, user_id AS book_id, epoch_us(ts) AS t_us, event_type, value, CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k FROM events)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    plain = dict(df.dtypes)["ts"] == "timestamp_ntz"
    t_us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") if plain else F.unix_micros("ts")
    return df.select("event_id", F.col("user_id").alias("book_id"), t_us.alias("t_us"), "event_type", "value", F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


BOOK, ORDER = ["book_id"], ["t_us", "event_id"]
W = "(PARTITION BY book_id ORDER BY t_us, event_id)"
UPTO = "(PARTITION BY book_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
R = f"{E}, r0 AS (SELECT *, lag(value) OVER {W} AS b FROM e), r AS (SELECT *, ln(value) - ln(b) AS r FROM r0 WHERE value > 0 AND b > 0)"


def returns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, bool]:
    """Log returns of all books, and whether a book is long."""
    df = events(spark, sf_dir)
    long = has_long(df, BOOK)
    return stats.log_returns(df, BOOK, ORDER, "value", width=SLICE, long=long), long


@query(f"""{R}, m AS (SELECT book_id, count(*) AS n, avg(r) AS a, coalesce(var_samp(r), 0) AS v, quantile_cont(r, 0.9) AS q FROM r GROUP BY book_id),
d AS (SELECT book_id, n, a, v, q, sum(pow(r - a, 3)) AS s3, sum(pow(r - a, 4)) AS s4 FROM r JOIN m USING (book_id) GROUP BY ALL)
SELECT book_id, n, round(a, 9) AS return_mean, round(v, 9) AS return_variance, round(CASE WHEN n < 3 OR v <= 1e-30 THEN 0 ELSE s3 / n / pow(v, 1.5) END, 9) AS return_skewness,
round(CASE WHEN n < 4 OR v <= 1e-30 THEN 0 ELSE s4 / n / (v * v) END, 9) AS return_kurtosis, round(q, 9) AS return_p90 FROM d""")
def log_return_moments(spark, sf_dir):
    df, long = returns(spark, sf_dir)
    r = F.col("r")
    aggs = [F.count(r).alias("n"), stats.mean(r).alias("return_mean"), stats.variance(r).alias("return_variance"), stats.skewness(r).alias("return_skewness"), stats.kurtosis(r).alias("return_kurtosis")]
    return rounded(stats.with_percentiles(df, BOOK, "r", aggs, {"return_p90": 0.9}, long))


@query(f"{E} SELECT event_type, round(avg(value), 6) AS mean_spread, round(quantile_cont(value, 0.9), 9) AS spread_p90, round(quantile_cont(value, 0.95), 9) AS spread_p95 FROM e GROUP BY event_type")
def spread_percentiles(spark, sf_dir):
    df = events(spark, sf_dir)
    out = stats.percentiles(df, ["event_type"], "value", {"spread_p90": 0.9, "spread_p95": 0.95}, mean_as="mean_spread")
    return rounded(out.withColumn("mean_spread", F.round("mean_spread", 6)))


def acf_sql(x: str, lags: list[int], prefix: str) -> str:
    shifted = ", ".join(f"lag(d, {k}) OVER {W} AS d{k}" for k in lags)
    out = ", ".join(f"round(coalesce(sum(d * d{k}) / nullif(sum(d * d), 0), 0), 8) AS {prefix}{k}" for k in lags)
    return f"{R}, d AS (SELECT *, {x} - avg({x}) OVER (PARTITION BY book_id) AS d FROM r), l AS (SELECT *, {shifted} FROM d) SELECT book_id, {out} FROM l GROUP BY book_id"


@query(acf_sql("r", [1], "return_acf_lag"))
def acf_returns_lag1(spark, sf_dir):
    df, long = returns(spark, sf_dir)
    return rounded(stats.autocorrelations(df, BOOK, ORDER, "r", [1], "return_acf_lag", SLICE, long), 8)


LAGS = [1, 2, 5, 10, 25, 50, 100]


@query(acf_sql("abs(r)", LAGS, "abs_return_acf_lag"))
def acf_abs_lags(spark, sf_dir):
    df, long = returns(spark, sf_dir)
    return rounded(stats.autocorrelations(df.withColumn("ar", F.abs("r")), BOOK, ORDER, "ar", LAGS, "abs_return_acf_lag", SLICE, long), 8)


@query(f"{R} SELECT book_id, round(coalesce(covar_pop(k, abs(r)) / nullif(sqrt(var_pop(k) * var_pop(abs(r))), 0), 0), 9) AS volume_volatility_corr FROM r GROUP BY book_id")
def volume_volatility_corr(spark, sf_dir):
    return rounded(returns(spark, sf_dir)[0].groupBy("book_id").agg(stats.correlation(F.col("k").cast("double"), F.abs("r")).alias("volume_volatility_corr")))


@query(f"{E}, d AS (SELECT book_id, value - lag(value, 10) OVER {W} AS d FROM e) SELECT book_id, round(coalesce(var_samp(d), 0), 5) AS price_diffusion FROM d GROUP BY book_id")
def price_diffusion_lag10(spark, sf_dir):
    df = lagged(events(spark, sf_dir), BOOK, ORDER, {"before": ("value", 10)}, SLICE).withColumn("d", F.col("value") - F.col("before"))
    return rounded(df.groupBy("book_id").agg(stats.variance(F.col("d")).alias("price_diffusion")), 5)


@query(f"{E}, d AS (SELECT book_id, value - lag(value) OVER {W} AS d FROM e), z AS (SELECT book_id, coalesce(avg(CASE WHEN abs(d) < 1e-12 THEN 1.0 ELSE 0.0 END), 0) AS z FROM d WHERE d IS NOT NULL GROUP BY book_id) SELECT book_id, round(z, 9) AS zero_mid_change_ratio, round(1 - z, 9) AS mid_move_rate FROM z")
def zero_move_ratio(spark, sf_dir):
    df = lagged(events(spark, sf_dir), BOOK, ORDER, {"before": ("value", 1)}, SLICE).withColumn("d", F.col("value") - F.col("before")).where("d is not null")
    z = df.groupBy("book_id").agg(F.avg(F.when(F.abs("d") < 1e-12, 1.0).otherwise(0.0)).alias("z"))
    return rounded(z.select("book_id", F.col("z").alias("zero_mid_change_ratio"), (1 - F.col("z")).alias("mid_move_rate")))


@query(f"{E}, s AS (SELECT greatest((max(t_us) - min(t_us)) / 1e6, 1e-9) AS span FROM e) SELECT event_type, count(*) AS n, round(count(*) / any_value(span), 9) AS rate FROM e, s GROUP BY event_type")
def event_type_rates(spark, sf_dir):
    df = events(spark, sf_dir)
    span = df.agg(F.greatest((F.max("t_us") - F.min("t_us")) / 1e6, F.lit(1e-9))).scalar()
    return rounded(df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", "n", (F.col("n") / span).alias("rate")))


@query(f"""{R}, l AS (SELECT book_id, r, abs(r) AS a, lag(abs(r)) OVER {W} AS b FROM r),
m AS (SELECT book_id, count(*) AS n, avg(r) AS m1, avg(r * r) AS m2, avg(r * r * r * r) AS m4, avg(a) AS am, avg(a * a) AS a2, avg(a * b) AS ab FROM l GROUP BY book_id)
SELECT book_id, n, round(m2 - m1 * m1, 8) AS variance, round(CASE WHEN m2 - m1 * m1 > 2.2e-16 THEN m4 / pow(m2 - m1 * m1, 2) ELSE 0 END, 7) AS kurtosis, round(CASE WHEN a2 - am * am > 2.2e-16 AND ab IS NOT NULL THEN (ab - am * am) / (a2 - am * am) ELSE 0 END, 7) AS abs_acf1 FROM m""")
def onepass_moments(spark, sf_dir):
    df, long = returns(spark, sf_dir)
    df = lagged(df.withColumn("a", F.abs("r")), BOOK, ORDER, {"b": ("a", 1)}, SLICE, long)
    m = stats.one_pass(F.col("r"))
    out = df.groupBy("book_id").agg(*[c.alias(name) for name, c in m.items()], stats.one_pass_acf(F.col("a"), F.col("b")).alias("abs_acf1"))
    return out.select("book_id", "n", F.round("variance", 8).alias("variance"), F.round("kurtosis", 7).alias("kurtosis"), F.round("abs_acf1", 7).alias("abs_acf1"))


@query(f"{E} SELECT p.event_id, p.book_id, v.event_id AS past_event_id, v.value AS past_value FROM (SELECT * FROM e WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') v ON p.book_id = v.book_id AND p.t_us - {HOUR} >= v.t_us")
def asof_past_state(spark, sf_dir):
    df = events(spark, sf_dir)
    out = flow.asof(df.where("event_type = 'purchase'"), df.where("event_type = 'view'"), BOOK, "t_us", ["event_id", "value"], lookback=HOUR, width=SLICE)
    return out.select("event_id", "book_id", F.col("asof_event_id").alias("past_event_id"), F.col("asof_value").alias("past_value"))


@query(f"{E} SELECT event_id, book_id, last_value(CASE WHEN k % 5 <> 0 THEN value END IGNORE NULLS) OVER {UPTO} AS carried FROM e")
def locf_value(spark, sf_dir):
    out = flow.carry_forward(events(spark, sf_dir), BOOK, ORDER, F.when(F.col("k") % 5 != 0, F.col("value")), "carried", SLICE)
    return out.select("event_id", "book_id", "carried")


KINDS = {"bought": "purchase", "sold": "signup", "bids": "view", "asks": "click"}
CUM = f"{E}, c AS (SELECT *, " + ", ".join(f"CAST(sum(CASE WHEN event_type = '{t}' THEN k ELSE 0 END) OVER {UPTO} AS BIGINT) AS {n}" for n, t in KINDS.items()) + " FROM e)"
PAST = f"{CUM}, p AS (SELECT c.*, q.value AS past_value, " + ", ".join(f"greatest(0, c.{n} - q.{n}) AS d_{n}" for n in KINDS) + f" FROM c ASOF LEFT JOIN c q ON c.book_id = q.book_id AND c.t_us - {DAY} >= q.t_us)"


def cumulative(spark, sf_dir, long: bool | None = None) -> DataFrame:
    sums = {name: F.when(F.col("event_type") == kind, F.col("k")).otherwise(0) for name, kind in KINDS.items()}
    return flow.running(events(spark, sf_dir), BOOK, ORDER, sums, width=SLICE, long=long)


def against_past(spark, sf_dir) -> DataFrame:
    long = has_long(events(spark, sf_dir), BOOK)
    out = flow.own_past(cumulative(spark, sf_dir, long), BOOK, "t_us", ["value", *KINDS], DAY, SLICE, long)
    deltas = {f"d_{n}": F.when(F.col(f"asof_{n}").isNotNull(), F.greatest(F.lit(0), F.col(n) - F.col(f"asof_{n}"))) for n in KINDS}
    return out.withColumns(deltas | {"past_value": F.col("asof_value")})


@query(f"{PAST} SELECT event_id, book_id, CASE WHEN d_bought + d_sold >= 50 THEN round((d_bought - d_sold) / (d_bought + d_sold), 9) END AS imbalance FROM p WHERE past_value IS NOT NULL")
def order_flow_imbalance(spark, sf_dir):
    df = against_past(spark, sf_dir).where("past_value is not null")
    return rounded(df.select("event_id", "book_id", market.gated_imbalance(F.col("d_bought"), F.col("d_sold"), 100).alias("imbalance")))


@query(f"""{PAST}, s AS (SELECT event_id, book_id,
CASE WHEN value - past_value > 50 THEN 1 WHEN value - past_value < -50 THEN -1 ELSE 0 END AS mid_signal,
CASE WHEN d_bought + d_sold >= 50 THEN CASE WHEN (d_bought - d_sold) / (d_bought + d_sold) > 0.1 THEN 1 WHEN (d_bought - d_sold) / (d_bought + d_sold) < -0.1 THEN -1 ELSE 0 END ELSE 0 END AS flow_signal,
CASE WHEN d_bids + d_asks > 0 THEN CASE WHEN (d_bids - d_asks) / (d_bids + d_asks) > 0.3 THEN 1 WHEN (d_bids - d_asks) / (d_bids + d_asks) < -0.3 THEN -1 ELSE 0 END ELSE 0 END AS depth_signal FROM p WHERE past_value IS NOT NULL)
SELECT event_id, book_id, mid_signal, flow_signal, depth_signal, (CASE WHEN mid_signal <> 0 AND flow_signal <> 0 AND mid_signal <> flow_signal THEN 0 WHEN mid_signal <> 0 THEN mid_signal WHEN flow_signal <> 0 THEN flow_signal ELSE depth_signal END)
 * (CASE WHEN mid_signal = 0 AND flow_signal = 0 THEN 50 ELSE 100 END) AS quantity FROM s""")
def momentum_signal(spark, sf_dir):
    df = against_past(spark, sf_dir).where("past_value is not null")
    df = df.select(
        "event_id", "book_id", market.sign_at(F.col("value") - F.col("past_value"), 50.0).alias("mid_signal"),
        market.sign_at(market.gated_imbalance(F.col("d_bought"), F.col("d_sold"), 100), 0.1).alias("flow_signal"),
        market.sign_at(market.imbalance(F.col("d_bids"), F.col("d_asks")), 0.3).alias("depth_signal"),
    )
    signals = [F.col(f"{s}_signal") for s in ("mid", "flow", "depth")]
    return df.withColumn("quantity", market.momentum_quantity(*signals, 100))


@query(f"""{E}, f AS (SELECT book_id, avg(value) AS f FROM e GROUP BY book_id), b AS (SELECT event_id, e.book_id, round(10000 * (value / f - 1), 6) AS bps FROM e JOIN f USING (book_id))
SELECT event_id, book_id, bps AS mispricing_bps, CAST(CASE WHEN abs(bps) <= 100 THEN 0 ELSE -sign(bps) * least(50, 10 * (1 + floor((abs(bps) - 100) / 500))) END AS BIGINT) AS quantity FROM b""")
def value_agent_decision(spark, sf_dir):
    df = events(spark, sf_dir)
    fair = df.groupBy("book_id").agg(F.avg("value").alias("f"))
    df = df.join(fair, "book_id").withColumn("bps", F.round(market.mispricing_bps(F.col("value"), F.col("f")), 6))
    return df.select("event_id", "book_id", F.col("bps").alias("mispricing_bps"), market.value_order_quantity(F.col("bps"), 100.0, 500.0, 10, 50, F.lit(1000)).alias("quantity"))


@query(f"{E} SELECT event_id, book_id, CAST(sum(k) OVER (PARTITION BY book_id ORDER BY t_us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS BIGINT) AS volume FROM e")
def trailing_range_volume(spark, sf_dir):
    return flow.trailing(events(spark, sf_dir), BOOK, "t_us", DAY, F.col("k"), "volume").select("event_id", "book_id", "volume")


@query(f"{CUM} SELECT event_id, book_id, bought, sold FROM c")
def cumulative_aggressive_volume(spark, sf_dir):
    return cumulative(spark, sf_dir).select("event_id", "book_id", "bought", "sold")


TRADES = "t AS (SELECT l_suppkey AS a, l_partkey + 1000000 AS b, CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS side, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice) AS BIGINT) AS p FROM lineitem)"


def trades(spark, sf_dir) -> DataFrame:
    side = F.when(F.col("l_returnflag") == "R", 1).otherwise(-1)
    df = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1_000_000).alias("b"), side.alias("side"), F.col("l_quantity").cast("long").alias("q"), F.round("l_extendedprice").cast("long").alias("p"))
    return df.withColumn("buyer", F.when(F.col("side") > 0, F.col("a")).otherwise(F.col("b"))).withColumn("seller", F.when(F.col("side") > 0, F.col("b")).otherwise(F.col("a")))


@query(f"WITH {TRADES}, l AS (SELECT a AS owner, side * q AS q, p FROM t UNION ALL SELECT b, -side * q, p FROM t) SELECT owner, CAST(sum(q) AS BIGINT) AS inventory, CAST(sum(-q * p) AS BIGINT) AS cash, count(*) AS trades FROM l GROUP BY owner")
def position_and_cash(spark, sf_dir):
    return flow.positions(trades(spark, sf_dir), "buyer", "seller", "q", "p")


@query(f"WITH {TRADES}, i AS (SELECT a, sum(side * q) AS inventory FROM t GROUP BY a), x AS (SELECT abs((0.5 + (a % 10) / 10.0) * inventory) AS x FROM i) SELECT count(*) AS books, CAST(sum(CAST(round(x * 1000000) AS BIGINT)) AS BIGINT) / 1000000 AS exposure FROM x")
def beta_exposure(spark, sf_dir):
    held = trades(spark, sf_dir).groupBy("a").agg(F.sum(F.col("side") * F.col("q")).alias("inventory"))
    x = F.abs((0.5 + (F.col("a") % 10) / 10.0) * F.col("inventory"))
    return held.agg(F.count(F.lit(1)).alias("books"), flow.fixed_sum(x).alias("exposure"))


@query(f"""{E}, s AS (SELECT book_id, event_type, row_number() OVER (PARTITION BY book_id, event_type ORDER BY t_us, event_id) AS n, sum(k) OVER (PARTITION BY book_id, event_type ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS hi, k FROM e)
SELECT a.book_id, count(*) AS fills, CAST(sum(least(a.hi, m.hi) - greatest(a.hi - a.k, m.hi - m.k)) AS BIGINT) AS filled FROM s a JOIN s m ON a.book_id = m.book_id AND a.event_type = 'purchase' AND m.event_type = 'click' AND a.k > 0 AND m.k > 0 AND a.hi - a.k < m.hi AND m.hi - m.k < a.hi GROUP BY a.book_id""")
def fifo_match_totals(spark, sf_dir):
    df = events(spark, sf_dir)
    fills = flow.fifo_match(df.where("event_type = 'purchase'"), df.where("event_type = 'click'"), BOOK, ORDER, ORDER, "k", width=SLICE)
    return fills.groupBy("book_id").agg(F.count(F.lit(1)).alias("fills"), F.sum("filled").alias("filled"))


@query(f"""{E}, l AS (SELECT book_id, CASE WHEN event_type = 'view' THEN 1 ELSE -1 END AS side, CAST(floor(value) AS BIGINT) + CASE WHEN event_type = 'view' THEN 0 ELSE 500 END AS price, sum(k) AS q FROM e WHERE event_type IN ('view', 'click') GROUP BY ALL HAVING sum(k) > 0),
b AS (SELECT book_id, max(CASE WHEN side > 0 THEN price END) AS best_bid, min(CASE WHEN side < 0 THEN price END) AS best_ask FROM l GROUP BY book_id)
SELECT book_id, best_bid, best_ask, CAST(max(CASE WHEN side > 0 AND price = best_bid THEN q END) AS BIGINT) AS bid_depth, CAST(max(CASE WHEN side < 0 AND price = best_ask THEN q END) AS BIGINT) AS ask_depth FROM l JOIN b USING (book_id) GROUP BY book_id, best_bid, best_ask""")
def best_level_depth(spark, sf_dir):
    df = events(spark, sf_dir).where("event_type in ('view', 'click')")
    bid = F.col("event_type") == "view"
    levels = df.select("book_id", F.when(bid, 1).otherwise(-1).alias("side"), (F.floor("value") + F.when(bid, 0).otherwise(500)).alias("price"), "k")
    return flow.best_levels(levels, BOOK, "side", "price", "k")


@query(f"{E} SELECT book_id, CAST(t_us // {HOUR} AS BIGINT) AS hour, count(*) AS orders, CAST(sum(CASE WHEN event_type = 'purchase' THEN k ELSE 0 END) AS BIGINT) AS bought, CAST(sum(CASE WHEN event_type = 'signup' THEN k ELSE 0 END) AS BIGINT) AS sold FROM e GROUP BY ALL")
def tumbling_window_flow(spark, sf_dir):
    df = events(spark, sf_dir).select("book_id", F.timestamp_micros("t_us").alias("event_time"), F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", -1).otherwise(0).alias("side"), F.col("k").alias("quantity"))
    out = flows.tumbling_flow(df, "1 hour")
    return out.select("book_id", F.floor(F.unix_micros("start") / HOUR).cast("long").alias("hour"), "orders", "bought", "sold")


CUT = START + 15 * DAY


@query(f"{E} SELECT event_type, count(*) FILTER (t_us < {CUT}) AS due, count(*) FILTER (t_us >= {CUT}) AS waiting FROM e GROUP BY event_type")
def due_future_split(spark, sf_dir):
    due, later = flows.split_due(events(spark, sf_dir), "t_us", CUT)
    both = due.withColumn("d", F.lit(1)).unionByName(later.withColumn("d", F.lit(0)))
    return both.groupBy("event_type").agg(F.sum("d").alias("due"), F.sum(1 - F.col("d")).alias("waiting"))


@query(f"""{E}, g AS (SELECT DISTINCT book_id FROM e), s AS (SELECT book_id, unnest(generate_series(0, {30 * DAY}, {DAY // 2})) AS t FROM g)
SELECT s.book_id, s.t // {DAY // 2} AS step, e.value FROM s ASOF LEFT JOIN e ON s.book_id = e.book_id AND s.t >= e.t_us - {START}""")
def sample_grid_state(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("t", F.col("t_us") - START)
    out = flow.asof(flow.grid(df, BOOK, "t", DAY // 2, 30 * DAY), df, BOOK, "t", ["value"], width=SLICE)
    return out.select("book_id", F.floor(F.col("t") / (DAY // 2)).cast("long").alias("step"), F.col("asof_value").alias("value"))


STAGES = "s AS (SELECT o_orderpriority AS stage, o_custkey % 8 AS rank, o_totalprice AS seconds FROM orders)"


@query(f"WITH {STAGES}, m AS (SELECT stage, min(seconds) AS a, avg(seconds) AS b, max(seconds) AS c, sum(seconds) AS d FROM s GROUP BY stage) SELECT m.stage, a AS min_seconds, round(b, 4) AS mean_seconds, c AS max_seconds, round(d, 2) AS sum_seconds, min(s.rank) AS slowest_rank FROM m JOIN s ON s.stage = m.stage AND s.seconds = m.c GROUP BY ALL")
def stage_summary(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stage"), (F.col("o_custkey") % 8).alias("rank"), F.col("o_totalprice").alias("seconds"))
    out = flow.stage_summary(df, "stage", "rank", "seconds")
    return out.withColumns({"mean_seconds": F.round("mean_seconds", 4), "sum_seconds": F.round("sum_seconds", 2)})


@query(f"WITH {STAGES} SELECT rank, CASE WHEN rank = 0 THEN 'exchange' WHEN rank < 7 THEN 'agents' ELSE 'idle' END AS role, count(*) AS calls, count(DISTINCT stage) AS stages FROM s GROUP BY rank")
def rank_counters(spark, sf_dir):
    rank = F.col("o_custkey") % 8
    df = table(spark, sf_dir, "orders").select(rank.alias("rank"), "o_orderpriority")
    return df.groupBy("rank", market.role(F.col("rank") == 0, F.col("rank").between(1, 6)).alias("role")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("o_orderpriority").alias("stages"))


@query("WITH c AS (SELECT l_returnflag, l_quantity AS value, count(*) AS count FROM lineitem GROUP BY ALL) SELECT l_returnflag, value, count, round(count / sum(count) OVER (PARTITION BY l_returnflag), 12) AS probability, round(sum(count) OVER (PARTITION BY l_returnflag ORDER BY value) / sum(count) OVER (PARTITION BY l_returnflag), 12) AS cumulative_probability FROM c")
def distribution_cdf(spark, sf_dir):
    out = flow.distribution(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return out.withColumns({c: F.round(c, 12) for c in ("probability", "cumulative_probability")})


@query("WITH n AS (SELECT lower(trim(p_name)) AS n FROM part), c AS (SELECT CASE n WHEN 'red widget' THEN 'widget_red' WHEN 'small ring' THEN NULL ELSE n END AS name FROM n) SELECT name, count(*) AS parts FROM c WHERE name IS NOT NULL GROUP BY name")
def canonical_names(spark, sf_dir):
    name = market.canonical(F.concat(F.lit(" "), F.upper("p_name")), {"red widget": "widget_red", "small ring": ""})
    return table(spark, sf_dir, "part").select(name.alias("name")).where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("parts"))


TARGETS = [("return_mean", 0.0, 0.5, 1e-6), ("return_variance", 2.0, 3.0, 1e-8), ("return_p90", 1.5, 1.5, 0.1), ("return_kurtosis", 6.0, 1.5, 1.0), ("mean_spread", 300.0, 2.5, 100.0)]
LOSS = f"""{R}, s AS (SELECT book_id, avg(r) AS return_mean, var_samp(r) AS return_variance, quantile_cont(r, 0.9) AS return_p90 FROM r GROUP BY book_id),
u AS (SELECT book_id, 'return_mean' AS name, round(return_mean, 9) AS value FROM s UNION ALL SELECT book_id, 'return_variance', round(return_variance, 9) FROM s UNION ALL SELECT book_id, 'return_p90', round(return_p90, 9) FROM s),
t(name, target, weight, scale_floor) AS (VALUES {", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for n, a, b, c in TARGETS)}),
j AS (SELECT s.book_id, t.weight, u.value, (coalesce(u.value, 0) - t.target) / greatest(abs(t.target), t.scale_floor, 1e-12) AS err FROM s CROSS JOIN t LEFT JOIN u ON u.book_id = s.book_id AND u.name = t.name),
loss AS (SELECT book_id, sum(weight * err * err) / sum(weight) AS loss, count(*) FILTER (value IS NULL) AS missing FROM j GROUP BY book_id)"""


def losses(spark, sf_dir) -> DataFrame:
    df, long = returns(spark, sf_dir)
    wide = stats.with_percentiles(df, BOOK, "r", [F.avg("r").alias("return_mean"), F.var_samp("r").alias("return_variance")], {"return_p90": 0.9}, long)
    long = wide.unpivot(["book_id"], ["return_mean", "return_variance", "return_p90"], "name", "value").withColumn("value", F.round("value", 9))
    targets = spark.createDataFrame(TARGETS, "name string, target double, weight double, scale_floor double")
    return flow.weighted_loss(long, targets, BOOK)


@query(f"{LOSS} SELECT book_id, round(loss, 3) AS loss, missing FROM loss")
def weighted_loss(spark, sf_dir):
    return losses(spark, sf_dir).withColumn("loss", F.round("loss", 3))


@query(f"{LOSS} SELECT book_id, round(loss, 3) AS loss, missing FROM loss ORDER BY round(loss, 3), book_id LIMIT 1")
def argmin_candidate(spark, sf_dir):
    return flow.first_best(losses(spark, sf_dir).withColumn("loss", F.round("loss", 3)), "book_id")


@query("SELECT c_custkey, c_name FROM customer ORDER BY (c_custkey * 2654435761 + 12345) % 4294967296, c_custkey LIMIT 100")
def seeded_topk(spark, sf_dir):
    return flow.seeded_top(table(spark, sf_dir, "customer"), (F.col("c_custkey") * 2654435761 + 12345) % 4294967296, "c_custkey", 100).select("c_custkey", "c_name")


@query(f"{E}, b AS (SELECT *, first_value(value) OVER {W} AS v0, first_value(k) OVER {W} AS k0 FROM e) SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 2 * v0 OR k < 0.5 * k0 THEN 1.0 ELSE 0.0 END), 9) AS affected FROM b GROUP BY event_type")
def affected_assets(spark, sf_dir):
    df = events(spark, sf_dir)
    first = df.groupBy("book_id").agg(F.min_by(F.struct(F.col("value").alias("v0"), F.col("k").alias("k0")), F.struct(*ORDER)).alias("f"))
    df = df.join(first.select("book_id", "f.*"), "book_id")
    hit = (F.col("value") > 2 * F.col("v0")) | (F.col("k") < 0.5 * F.col("k0"))
    return rounded(df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("affected")))


@query(f"""{E}, s AS (SELECT event_id, CASE WHEN k % 10 = 0 THEN 0 ELSE 10000 + k * 100 END AS bid, CASE WHEN k % 7 = 0 THEN 0 ELSE 10100 + k * 100 + (event_id % 6) * 100 END AS ask, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 10050 + k * 100 END AS last, 20000 AS fair, k + 1 AS q FROM e),
b AS (SELECT *, 200 AS wide, least(greatest(CAST(round(((CASE WHEN last > 0 THEN last ELSE (bid + ask) / 2 END) - 100) / 100) AS BIGINT) * 100, bid), ask - 200) AS bracket,
 CASE WHEN bid > 0 THEN CASE WHEN last > 0 THEN last ELSE bid + 100 END WHEN ask > 0 THEN CASE WHEN last > 0 THEN last ELSE ask - 100 END ELSE CAST(round((CASE WHEN last > 200 THEN last ELSE fair END) / 100) AS BIGINT) * 100 END AS centre FROM s),
p AS (SELECT event_id, q, CASE WHEN bid > 0 AND ask > bid THEN CASE WHEN ask - bid >= 400 THEN bracket ELSE bid END ELSE centre - 100 END AS pb, CASE WHEN bid > 0 AND ask > bid THEN CASE WHEN ask - bid >= 400 THEN bracket + wide ELSE ask END ELSE centre + 100 END AS pa FROM b)
SELECT event_id, l.level, d.side, CAST(CASE WHEN d.side > 0 THEN pb - l.level * 100 ELSE pa + l.level * 100 END AS BIGINT) AS price, CAST(CASE WHEN l.level = 0 THEN q ELSE least(150, q * CAST(pow(2, l.level) AS BIGINT)) END AS BIGINT) AS quantity
FROM p, (VALUES (0), (1), (2)) l(level), (VALUES (1), (-1)) d(side) WHERE pb > 0 AND pa > pb AND pb - l.level * 100 > 0""")
def quote_ladder(spark, sf_dir):
    k, i = F.col("k"), F.col("event_id")
    states = events(spark, sf_dir).select(
        "event_id", F.when(k % 10 == 0, 0).otherwise(10_000 + k * 100).alias("best_bid"), F.when(k % 7 == 0, 0).otherwise(10_100 + k * 100 + (i % 6) * 100).alias("best_ask"),
        F.when(i % 3 == 0, 0).otherwise(10_050 + k * 100).alias("last_trade"), F.lit(20_000).alias("fundamental"), (k + 1).alias("q"),
    )
    return flow.quote_ladder(states, ["event_id"], 100, F.lit(2), F.col("q"), 3, 2, 150)


@query("""WITH p AS (SELECT s_suppkey AS b, floor(abs(s_acctbal)) AS w FROM supplier WHERE s_suppkey <> 0), t AS (SELECT sum(w) AS total FROM p),
r AS (SELECT 0 AS source, b AS target, CASE WHEN total = 0 THEN 1.0 ELSE w END AS weight FROM p, t UNION ALL SELECT b, 0, 1.0 FROM p)
SELECT CAST(source AS BIGINT) AS source, CAST(target AS BIGINT) AS target, round(weight / sum(weight) OVER (PARTITION BY source), 12) AS share FROM r""")
def hedge_routes(spark, sf_dir):
    books = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor(F.abs("s_acctbal")).cast("double").alias("w"))
    routes = flow.hedge_routes(books, "s_suppkey", "w")
    totals = routes.groupBy("source").agg(F.sum("weight").alias("total"))
    return routes.join(totals, "source").select("source", "target", F.round(F.col("weight") / F.col("total"), 12).alias("share"))


@query(f"""{E}, a AS (SELECT DISTINCT book_id, (t_us - {START}) / 1e6 AS t FROM e), s AS (SELECT book_id, (t_us - {START}) / 1e6 AS s FROM e)
SELECT a.book_id, a.t, round(0.5 + coalesce(sum(0.2 * exp(-0.001 * (a.t - s.s))), 0), 9) AS intensity FROM a LEFT JOIN s ON a.book_id = s.book_id AND s.s < a.t AND a.t - s.s <= ln(1e6) / 0.001 GROUP BY ALL""")
def interarrival_intensity(spark, sf_dir):
    df = events(spark, sf_dir).select("book_id", ((F.col("t_us") - START) / 1e6).alias("t"))
    return flow.intensity(df, df, BOOK, "t", 0.2, 0.001, 0.5).select("book_id", "t", F.round("intensity", 9).alias("intensity"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def missing_books(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query(f"{E}, a AS (SELECT event_id, book_id, k FROM e), b AS (SELECT event_id, book_id, CASE WHEN event_id % 500 = 7 THEN k + 1 ELSE k END AS k FROM e) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def replica_diff(spark, sf_dir):
    a = events(spark, sf_dir).select("event_id", "book_id", "k")
    b = a.withColumn("k", F.when(F.col("event_id") % 500 == 7, F.col("k") + 1).otherwise(F.col("k")))
    return merging.replica_difference(a, b, ["event_id", "book_id", "k"])


@query(f"{E}, b AS (SELECT DISTINCT event_type, CAST(t_us // {HOUR} AS BIGINT) AS boundary FROM e) SELECT boundary, count(*) AS clocks FROM b GROUP BY boundary")
def union_clocks(spark, sf_dir):
    """Hours in which any kind of event ticks, and how many kinds do."""
    return flow.union_of_ticks(events(spark, sf_dir).select("event_type", F.floor(F.col("t_us") / HOUR).cast("long").alias("boundary")), "event_type", "boundary")


@query(f"{E}, m AS (SELECT *, 0 AS flow FROM e WHERE event_type = 'purchase' UNION ALL SELECT *, 1 FROM e WHERE event_type = 'signup') SELECT event_id, book_id, flow, row_number() OVER (PARTITION BY book_id ORDER BY t_us, flow, event_id) AS position FROM m")
def merge_two_flows(spark, sf_dir):
    df = events(spark, sf_dir)
    out = flow.merge_flows([df.where("event_type = 'purchase'"), df.where("event_type = 'signup'")], BOOK, ORDER, width=SLICE)
    return out.select("event_id", "book_id", "flow", "position")


@query(f"{E} SELECT event_id, book_id, max(value) OVER {UPTO} AS peak, min(value) OVER {UPTO} AS low FROM e")
def running_peak(spark, sf_dir):
    v = F.col("value")
    return flow.running(events(spark, sf_dir), BOOK, ORDER, maxima={"peak": v}, minima={"low": v}, width=SLICE).select("event_id", "book_id", "peak", "low")


@query(f"{E} SELECT book_id, count(*) AS processed, round(count(*) / nullif((max(t_us) - min(t_us)) / 1e6, 0), 9) AS throughput FROM e GROUP BY book_id")
def throughput_rollup(spark, sf_dir):
    df = events(spark, sf_dir).groupBy("book_id").agg(F.count(F.lit(1)).alias("processed"), ((F.max("t_us") - F.min("t_us")) / 1e6).alias("wall"))
    return rounded(df.select("book_id", "processed", F.try_divide(F.col("processed").cast("double"), F.when(F.col("wall") > 0, F.col("wall"))).alias("throughput")))


@query(f"{E}, p AS (SELECT book_id, t_us, 1 AS d, 0 AS o FROM e UNION ALL SELECT book_id, t_us + k * 60000000, -1, 1 FROM e), s AS (SELECT book_id, sum(d) OVER (PARTITION BY book_id ORDER BY t_us, o DESC ROWS UNBOUNDED PRECEDING) AS n FROM p) SELECT book_id, CAST(max(n) AS BIGINT) AS peak_pending FROM s GROUP BY book_id")
def peak_pending(spark, sf_dir):
    changes = F.explode(F.array(F.struct(F.col("t_us").alias("t"), F.lit(1).alias("d"), F.lit(0).alias("o")), F.struct((F.col("t_us") + F.col("k") * 60_000_000).alias("t"), F.lit(-1).alias("d"), F.lit(1).alias("o"))))
    df = events(spark, sf_dir).select("book_id", changes.alias("c")).select("book_id", "c.*")
    df = flow.running(df.withColumn("o", -F.col("o")), BOOK, ["t", "o"], {"n": F.col("d")}, width=SLICE)
    return df.groupBy("book_id").agg(F.max("n").alias("peak_pending"))


@query(f"{E}, w AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY book_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e WHERE event_type = 'purchase') SELECT event_id, book_id, CAST(least(greatest(300 - b, 0), k) AS BIGINT) AS executed FROM w")
def institutional_slices(spark, sf_dir):
    df = flow.slices(events(spark, sf_dir).where("event_type = 'purchase'"), BOOK, ORDER, F.col("k"), 300, width=SLICE)
    return df.select("event_id", "book_id", "executed")


@query(f"{E}, s AS (SELECT book_id, CASE WHEN event_type = 'view' THEN value END AS bid, CASE WHEN event_type = 'view' THEN value + k - 20 END AS ask, k FROM e) SELECT book_id, count(*) FILTER (bid > 0 AND ask > bid) AS snapshots, round(avg(CASE WHEN bid > 0 AND ask > bid THEN ask - bid END), 6) AS mean_spread, round(avg(CASE WHEN bid > 0 AND ask > bid THEN k END), 6) AS mean_depth FROM s GROUP BY book_id")
def market_summary(spark, sf_dir):
    view = F.col("event_type") == "view"
    df = events(spark, sf_dir).withColumn("bid", F.when(view, F.col("value"))).withColumn("ask", F.when(view, F.col("value") + F.col("k") - 20))
    ok = market.two_sided(F.col("bid"), F.col("ask"))
    return rounded(df.groupBy("book_id").agg(F.count_if(ok).alias("snapshots"), F.avg(F.when(ok, F.col("ask") - F.col("bid"))).alias("mean_spread"), F.avg(F.when(ok, F.col("k"))).alias("mean_depth")), 6)


M64 = "18446744073709551616::UHUGEINT"


SPLITMIX = f"""{E}, d AS (SELECT event_id, n, CAST((CAST(event_id + 1 AS UHUGEINT) + n::UHUGEINT * {rng.GOLDEN}::UHUGEINT) % {M64} AS UBIGINT) AS z FROM e, (VALUES (1), (2)) v(n)),
a AS (SELECT event_id, n, CAST((xor(z, z >> 30)::UHUGEINT * {rng.MIX_1}::UHUGEINT) % {M64} AS UBIGINT) AS z FROM d),
b AS (SELECT event_id, n, CAST((xor(z, z >> 27)::UHUGEINT * {rng.MIX_2}::UHUGEINT) % {M64} AS UBIGINT) AS z FROM a),
c AS (SELECT event_id, n, xor(z, z >> 31) AS z FROM b)"""


@query(f"{SPLITMIX} SELECT event_id, n, round(greatest(1e-12, (z >> 11) / 9007199254740992.0::DOUBLE), 12) AS uniform, CAST(10 + z % 91 AS BIGINT) AS drawn FROM c")
def seeded_draws(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    df = df.withColumn("z", rng.draw(F.col("event_id") + 1, F.col("n")))
    return df.select("event_id", "n", F.round(rng.uniform01(F.col("z")), 12).alias("uniform"), rng.uniform_int(F.col("z"), F.lit(10), F.lit(100)).alias("drawn"))


@query("""WITH v AS (SELECT list(DISTINCT CAST(l_quantity AS BIGINT) ORDER BY CAST(l_quantity AS BIGINT)) AS vals FROM lineitem WHERE l_quantity >= 25) """ + f""", {SPLITMIX.removeprefix("WITH ")} SELECT event_id, vals[1 + CAST(z % len(vals) AS BIGINT)] AS quantity FROM c, v WHERE n = 1""")
def empirical_draws(spark, sf_dir):
    values = table(spark, sf_dir, "lineitem").where("l_quantity >= 25").agg(F.array_sort(F.collect_set(F.col("l_quantity").cast("long"))).alias("v")).scalar()
    df = events(spark, sf_dir).select("event_id", rng.draw(F.col("event_id") + 1, F.lit(1)).alias("z")).withColumn("v", values)
    at = rng.uniform_int(F.col("z"), F.lit(0), (F.size("v") - 1).cast("long"))
    return df.select("event_id", F.element_at("v", (1 + at).cast("int")).alias("quantity"))


@query(f"{E} SELECT event_id, CAST(floor(value * 100) AS BIGINT) - CAST(floor(value * 100) AS BIGINT) % 25 AS low, CASE WHEN k % 2 = 0 THEN t_us + 5000 + (k * 50) ELSE t_us + 20000 END AS arrival, CAST(least(3, greatest(-3, round(0.25 * (k - 50) / 10.0))) AS INT) AS skew, round(CASE WHEN k / 100.0 <= 0.5 THEN 1.0 ELSE 2 * (1 - k / 100.0) END, 9) AS scale FROM e")
def quote_scalars(spark, sf_dir):
    k = F.col("k")
    latency = F.when(k % 2 == 0, market.latency_ns(F.lit("market_maker"), k / 100)).otherwise(market.latency_ns(F.lit("informed"), F.lit(0.0)))
    return events(spark, sf_dir).select(
        "event_id", market.floor_to_tick(F.floor(F.col("value") * 100), 25).alias("low"), market.add_time(F.col("t_us"), latency).alias("arrival"),
        market.inventory_skew(k - 50, 10).alias("skew"), F.round(market.quote_scale(k / 100.0), 9).alias("scale"),
    )


def book_orders(spark, sf_dir) -> DataFrame:
    """Events as orders around the opening book."""
    kind, k = F.col("event_type"), F.col("k")
    side = F.when(kind.isin("view", "purchase"), 1).when(kind == "error", F.when(k % 2 == 0, 1).otherwise(-1)).otherwise(-1)
    action = F.when(kind.isin("view", "click"), book.LIMIT).when(kind.isin("purchase", "signup"), book.MARKET).otherwise(book.CANCEL_AT)
    price = F.when(side > 0, 2203400 + (k % 5 - 3) * 100).otherwise(2203700 - (k % 5 - 3) * 100)
    return events(spark, sf_dir).select(
        "book_id", (F.col("t_us") * 1000).alias("arrival_ns"), action.alias("action"), side.alias("side"), (k + 1).alias("quantity"), price.alias("price"), (k % 4).alias("distance"),
        (F.col("event_id") % 50 + 1).alias("owner"), F.col("event_id").alias("sequence"), rng.draw(F.col("event_id") + 1, F.lit(1)).alias("tie_breaker"), F.lit(0).alias("source_rank"),
    )


@query()
def lob_run(spark, sf_dir):
    return book.match_orders(book_orders(spark, sf_dir))


@query()
def lob_trades(spark, sf_dir):
    return book.match_trades(book_orders(spark, sf_dir))


@query()
def lob_reports(spark, sf_dir):
    return book.reports(book.match_trades(book_orders(spark, sf_dir)))


@query()
def trade_tape_hash(spark, sf_dir):
    return book.tape_hash(book.match_trades(book_orders(spark, sf_dir)))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each supplier, with a seed of its own."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run_id"), F.lit(0).cast("long").alias("book_id"), (F.col("s_suppkey") * 7919 + 17).alias("seed"))


SHORT = {"seconds": 0.25, "sample_ms": 25}


@query()
def hawkes_run(spark, sf_dir):
    return hawkes.hawkes_events(runs(spark, sf_dir), hawkes.HawkesConfig(), 5.0)


@query()
def market_run(spark, sf_dir):
    return simulate.run_markets(runs(spark, sf_dir), simulate.MarketConfig(books=3, hedging=True, **SHORT))


@query()
def market_run_moments(spark, sf_dir):
    config = simulate.MarketConfig(books=2, **SHORT)
    return simulate.run_moments(simulate.run_markets(runs(spark, sf_dir), config), config)


@query()
def shock_run(spark, sf_dir):
    config = simulate.MarketConfig(books=4, shock_s=0.1, shock_multiple=3.0, shocked=(0, 1), **SHORT)
    return simulate.shock_metrics(simulate.run_markets(runs(spark, sf_dir), config), config.shocked)


def quote_states(spark, sf_dir) -> DataFrame:
    k, i = F.col("k"), F.col("event_id")
    return events(spark, sf_dir).select(
        "event_id", F.when(k % 9 == 0, 0).otherwise(10_000 + k * 10).alias("best_bid"), F.when(k % 8 == 0, 0).otherwise(10_050 + k * 10 + (i % 7) * 100).alias("best_ask"), (i % 61 - 30).alias("inventory"),
    )


@query(f"""{E}, s AS (SELECT event_id, CASE WHEN k % 9 = 0 THEN 0 ELSE 10000 + k * 10 END AS bid, CASE WHEN k % 8 = 0 THEN 0 ELSE 10050 + k * 10 + (event_id % 7) * 100 END AS ask, event_id % 61 - 30 AS held FROM e),
c AS (SELECT *, CAST(round((bid + ask) / 2) AS BIGINT) - CAST(least(3, greatest(-3, round(0.25 * held / 10))) AS BIGINT) * 50 AS centre FROM s),
q AS (SELECT event_id, held, CASE WHEN bid > 0 AND ask > 0 THEN least(CASE WHEN ask - bid > 100 THEN greatest(bid + 50, centre - 50) ELSE bid END, ask - 50) WHEN bid > 0 THEN bid WHEN ask > 0 THEN ask - 100 END AS low,
 CASE WHEN bid > 0 AND ask > 0 THEN greatest(CASE WHEN ask - bid > 100 THEN least(ask - 50, centre + 50) ELSE ask END, bid + 50) WHEN bid > 0 THEN bid + 100 WHEN ask > 0 THEN ask END AS high FROM c),
t AS (SELECT event_id, held, low - low % 50 AS low, high + 49 - (high + 49) % 50 AS high FROM q)
SELECT event_id, l.level, d.side, CAST(CASE WHEN d.side > 0 THEN low - l.level * 50 ELSE high + l.level * 50 END AS BIGINT) AS price,
 CAST(CASE WHEN held * d.side > 0 THEN 5 WHEN held * d.side < 0 THEN least(20, 10 + abs(held) // 4) ELSE 10 END AS BIGINT) AS quantity
FROM t, (VALUES (0), (1)) l(level), (VALUES (1), (-1)) d(side) WHERE low > 0 AND high > low AND low - l.level * 50 > 0""")
def passive_quotes(spark, sf_dir):
    return agents.passive_quotes(quote_states(spark, sf_dir), ["event_id"], 50, 10, levels=2)


@query(f"""{E}, s AS (SELECT t_us // {DAY} AS day, user_id % 4 AS book_id, avg(value) AS mid FROM (SELECT *, book_id AS user_id FROM e) GROUP BY ALL),
p AS (SELECT day, 10000 * (max(CASE WHEN book_id = 0 THEN mid END) / (sum(CASE WHEN book_id <> 0 THEN book_id * mid END) / sum(CASE WHEN book_id <> 0 THEN book_id END)) - 1) AS x, count(*) AS n FROM s GROUP BY day),
c AS (SELECT day, x, CASE WHEN x > 800 THEN -1 WHEN x < -800 THEN 1 WHEN abs(x) < 200 THEN 0 END AS c FROM p)
SELECT CAST(day AS BIGINT) AS day, round(x, 6) AS premium_bps, coalesce(last_value(c IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 0) AS direction FROM c""")
def basket_arbitrage(spark, sf_dir):
    df = events(spark, sf_dir).select(F.floor(F.col("t_us") / DAY).cast("long").alias("day"), (F.col("book_id") % 4).alias("book_id"), "value")
    states = df.groupBy("day", "book_id").agg(F.avg("value").alias("mid"))
    weights = spark.range(4).select(F.col("id").alias("book_id"), F.col("id").cast("double").alias("weight"))
    premium = agents.basket_premium(states, weights, ["day"]).withColumn("market", F.lit(0))
    # One market: as many rows as days.
    out = agents.with_hysteresis(premium, ["market"], ["day"], "premium_bps", 800.0, 200.0)
    return out.select("day", F.round("premium_bps", 6).alias("premium_bps"), "direction")


@query(f"WITH {TRADES}, i AS (SELECT a % 5 AS book_id, CAST(sum(side * q) AS BIGINT) AS inventory FROM t GROUP BY ALL), r(source, target, weight) AS (SELECT a.x, b.x, b.x + 1.0 FROM (VALUES (0), (1), (2), (3), (4)) a(x), (VALUES (0), (1), (2), (3), (4)) b(x) WHERE a.x <> b.x), s AS (SELECT source, sum(weight) AS total FROM r GROUP BY source), h AS (SELECT i.book_id, r.target, CAST(-sign(inventory) * floor(abs(0.5 * inventory) * weight / total / 10) * 10 AS BIGINT) AS quantity FROM i JOIN r ON i.book_id = r.source JOIN s ON s.source = r.source WHERE abs(0.5 * inventory) > 100) SELECT book_id, CAST(target AS BIGINT) AS target, quantity FROM h WHERE quantity <> 0")
def hedge_orders(spark, sf_dir):
    held = trades(spark, sf_dir).groupBy((F.col("a") % 5).alias("book_id")).agg(F.sum(F.col("side") * F.col("q")).alias("inventory")).withColumns({"beta": F.lit(0.5), "pending": F.lit(0)})
    pairs = [(a, b, b + 1.0) for a in range(5) for b in range(5) if a != b]
    return agents.hedge_orders(held, spark.createDataFrame(pairs, "source long, target long, weight double"), 100.0, 10)


@query("WITH c AS (SELECT c_custkey % 700 AS book_id, count(*) AS n FROM customer GROUP BY ALL), x AS (SELECT unnest(range(0, 750)) AS book_id) SELECT coalesce(c.book_id, x.book_id) AS book_id, CASE WHEN n IS NULL THEN 'missing' WHEN x.book_id IS NULL THEN 'unknown' WHEN n > 1 THEN 'twice' END AS fault FROM c FULL JOIN x ON c.book_id = x.book_id WHERE n IS NULL OR x.book_id IS NULL OR n > 1")
def completeness(spark, sf_dir):
    seen = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 700).alias("book_id"))
    return agents.complete(seen, spark.range(750).withColumnRenamed("id", "book_id"), "book_id")


@query(f"WITH {STAGES}, r AS (SELECT rank, sum(CASE WHEN stage LIKE '1%' OR stage LIKE '2%' THEN seconds ELSE 0 END) AS c, sum(seconds) AS a FROM s GROUP BY rank) SELECT round(max(c), 2) AS max_communication, round(avg(c), 2) AS mean_communication, round(max(a) / avg(a), 9) AS imbalance FROM r")
def communication_rollup(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 8).alias("rank"), F.substring("o_orderpriority", 1, 1).alias("stage"), F.col("o_totalprice").alias("seconds"))
    out = agents.communication(df, ["1", "2"])
    return out.select(F.round("max_communication", 2).alias("max_communication"), F.round("mean_communication", 2).alias("mean_communication"), F.round("imbalance", 9).alias("imbalance"))


@query(f"{SPLITMIX}, s AS (SELECT e.event_id, e.event_type, row_number() OVER (PARTITION BY e.event_type ORDER BY CASE WHEN c.z >= 9223372036854775808 THEN CAST(c.z::HUGEINT - 18446744073709551616 AS BIGINT) ELSE CAST(c.z AS BIGINT) END, e.event_id) AS n FROM e JOIN c ON c.event_id = e.event_id AND c.n = 1) SELECT event_id, event_type FROM s WHERE n <= 20")
def bucket_samples(spark, sf_dir):
    return merging.bottom_k(events(spark, sf_dir).select("event_id", "event_type"), ["event_type"], "event_id", 20, 1)


@query("WITH n AS (SELECT c_nationkey AS nation, count(*) AS agents FROM customer GROUP BY ALL), p AS (SELECT *, unnest(range(0, 7)) AS part FROM n) SELECT nation, part, agents // 7 + CASE WHEN part < agents % 7 THEN 1 ELSE 0 END AS agents FROM p")
def population_split(spark, sf_dir):
    """The customers of each nation over seven parts."""
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    parts = counts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    return parts.select("nation", "part", agents.split_count(F.col("n"), F.lit(7), F.col("part")).alias("agents"))


from . import ledger  # noqa: E402, F401 - adds its queries
