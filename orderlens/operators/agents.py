"""Populations and decisions of agents, as tables: what needs no feedback inside a window is Column expressions over as-of states."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import market, rng
from ..functions.windows import last_known, running_totals
from .book import CANCEL_OWNER

#: Share and wake rate (per second) of each kind of agent.
RATES = {"market_maker": 50.0, "momentum": 0.20, "informed": 0.05, "institutional": 0.01}


def population_of(owners: DataFrame, seed: int, scale: float = 1.0) -> DataFrame:
    """Parameters of agents (owner, kind), drawn from each owner's own counter: wake rate, first wake, and for institutions side, parent, child, cap and active span (as shares of the run)."""
    u = lambda i: rng.uniform01(rng.draw(F.col("owner") + seed, F.lit(i)))
    rates = F.create_map(*[F.lit(x) for kind, rate in RATES.items() for x in (kind, rate / (1.0 if kind == "market_maker" else scale))])
    # The wait's draw is a column of its own: a Python function isn't planned over nested lambdas.
    df = owners.select("owner", "kind", F.try_element_at(rates, F.col("kind")).alias("wake_rate"), u(1).alias("_u"))
    large = F.col("kind") == "institutional"
    return df.withColumns({
        "first_wake_ns": rng.exponential_wait_ns(F.col("_u"), F.col("wake_rate")),
        "side": F.when(large, F.when(u(2) < 0.5, 1).otherwise(-1)), "parent": F.when(large, (10_000 + F.floor(u(3) * 90_001)).cast("long")), "child": F.when(large, (100 + F.floor(u(4) * 901)).cast("long")),
        "cap": F.when(large, market.clamp(0.1 * (0.75 + 0.5 * u(5)), 0.001, 0.95)), "start_share": F.when(large, 0.2 * u(6)), "end_share": F.when(large, 0.8 + 0.2 * u(7)),
    }).drop("_u")


def population(spark: SparkSession, counts: dict[str, int], seed: int, scale: float = 1.0) -> DataFrame:
    """So many agents of each kind, with owners numbered within it."""
    kinds = [spark.range(n).select(market.owner_id(F.lit(k + 1), F.col("id")).alias("owner"), F.lit(kind).alias("kind")) for k, (kind, n) in enumerate(counts.items())]
    return population_of(reduce(DataFrame.union, kinds), seed, scale)


def split_count(total: Column, parts: Column, index: Column) -> Column:
    """How many of a total the part with this index gets, the rest going to the first parts."""
    return F.floor(total / parts).cast("long") + F.when(index < total % parts, 1).otherwise(0)


def fundamental_path(grid: DataFrame, keys: list[str], step: str, start: float, bps: float, seed: int) -> DataFrame:
    """A log-normal martingale on a grid of steps (from 1): each shock is the step's own draw, the path their running sum."""
    sigma = bps / 1e4
    base = F.lit(seed).cast("long")
    for k in keys:
        base = base * 1_000_003 + F.col(k)
    z = rng.normal01(rng.uniform01(rng.draw(base, 2 * F.col(step))), rng.uniform01(rng.draw(base, 2 * F.col(step) + 1)))
    path = running_totals(grid.withColumn("_z", sigma * z - sigma * sigma / 2), keys, [step], {"_sum": F.col("_z")})
    return path.withColumn("fundamental", start * F.exp("_sum")).drop("_z", "_sum")


def gaussian_walk(grid: DataFrame, keys: list[str], step: str, start: float, shock: float, step_ms: float, tick: int, seed: int) -> DataFrame:
    """A fundamental that moves by a normal shock a window: its deviation grows with the root of the window's milliseconds."""
    base = F.lit(seed).cast("long")
    for k in keys:
        base = base * 1_000_003 + F.col(k)
    z = rng.normal01(rng.uniform01(rng.draw(base, 2 * F.col(step))), rng.uniform01(rng.draw(base, 2 * F.col(step) + 1)))
    path = running_totals(grid.withColumn("_z", z * (shock * max(0.0, step_ms) ** 0.5 * tick)), keys, [step], {"_sum": F.col("_z")})
    return path.withColumn("fundamental", start + F.col("_sum")).drop("_z", "_sum")


def basket_premium(states: DataFrame, weights: DataFrame, keys: list[str], basket: int = 0) -> DataFrame:
    """Premium in bps of a basket book over the weighted middle of its components at each time; null where one lacks a middle."""
    df = states.join(weights, "book_id")
    part = F.col("book_id") != basket
    value = F.sum(F.when(part, F.col("weight") * F.col("mid"))) / F.sum(F.when(part, F.col("weight")))
    whole = F.max(F.when(~part, F.col("mid")))
    sound = F.count_if(F.col("mid").isNull()) == 0
    return df.groupBy(*keys).agg(F.when(sound, 1e4 * (F.try_divide(whole, value) - 1)).alias("premium_bps"))


def with_hysteresis(df: DataFrame, keys: list[str], order: list[str], premium: str, trigger: float, release: float, out: str = "direction") -> DataFrame:
    """-1 from a premium above the trigger on, 1 from one below its negative on, 0 once its size is under the release; else as before."""
    x = F.col(premium)
    change = F.when(x > trigger, -1).when(x < -trigger, 1).when(F.abs(x) < release, 0)
    return last_known(df, keys, order, change, out).withColumn(out, F.coalesce(out, F.lit(0)))


def basket_legs(directions: DataFrame, weights: DataFrame, keys: list[str], quantity: int, basket: int = 0) -> DataFrame:
    """Orders of an arbitrage (keys, direction): the basket one way, its components the other by their weights; none where the direction is 0."""
    total = weights.where(F.col("book_id") != basket).agg(F.sum("weight")).scalar()
    size = F.when(F.col("book_id") == basket, F.lit(quantity)).otherwise(-F.round(quantity * F.col("weight") / total)).cast("long")
    legs = weights.select("book_id", size.alias("size"))
    listed = legs.agg(F.collect_list(F.struct("book_id", "size"))).scalar()  # as many as a basket has components
    return directions.where("direction <> 0").select(*keys, "direction", F.explode(listed).alias("leg")).select(*keys, "leg.book_id", (F.col("direction") * F.col("leg.size")).cast("long").alias("quantity"))


#: Fixed value: salt of tie-breakers.
TIE_SALT = 0xD1B54A32D192ED03 - (1 << 64)


def order_messages(orders: DataFrame) -> DataFrame:
    """Orders (owner, counter, generated_ns, latency_ns, action, quantity) as messages: a sequence that no other owner has, a seeded tie-breaker, the arrival, and no empty ones but cancels of all of an owner's orders."""
    sequence = market.owner_sequence(F.col("owner"), F.col("counter"))
    out = orders.withColumn("sequence", sequence).withColumn("tie_breaker", rng.draw(F.col("sequence").bitwiseXOR(F.lit(TIE_SALT)), F.lit(1)))
    return out.withColumn("arrival_ns", market.add_time(F.col("generated_ns"), F.col("latency_ns"))).where((F.col("quantity") > 0) | (F.col("action") == CANCEL_OWNER))


def maker_settings(books: DataFrame, latency_ns: int = 5000, threshold: float = 1000.0) -> DataFrame:
    """What a shared maker needs of each book of a configuration, with the faults of each (an empty list where it is sound)."""
    rules = {"quantity": F.col("market_maker_quote_quantity") > 0, "spread": F.col("target_spread_ticks") > 0, "beta": F.coalesce(F.abs("beta") < float("inf"), F.lit(False)) & (F.col("beta") != 0), "weight": F.col("basket_weight") >= 0, "latency": F.lit(latency_ns >= 0), "threshold": F.lit(threshold > 0)}
    faults = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return books.select("book_id", F.col("market_maker_quote_quantity").alias("quantity"), F.col("target_spread_ticks").alias("spread"), "beta", F.col("basket_weight").alias("weight"), F.lit(latency_ns).alias("latency_ns"), F.lit(threshold).alias("threshold"), faults.alias("faults"))


def passive_quotes(states: DataFrame, keep: list[str], tick: int, quantity: int, min_spread: int = 2, levels: int = 1) -> DataFrame:
    """A local maker's quotes (best_bid, best_ask, inventory): joins the best unless the spread is wide, leans against inventory, rebuilds a missing side; a row for each side and level."""
    bid, ask, held = F.coalesce("best_bid", F.lit(0)), F.coalesce("best_ask", F.lit(0)), F.col("inventory")
    least = max(2 * tick, min_spread * tick)
    half = max(tick, least // 2)
    both = (bid > 0) & (ask > 0)
    centre = F.round((bid + ask) / 2).cast("long") - market.inventory_skew(held, quantity) * tick
    wide = ask - bid > least
    low = F.when(wide, F.greatest(bid + tick, centre - half)).otherwise(bid)
    high = F.when(wide, F.least(ask - tick, centre + half)).otherwise(ask)
    low, high = F.least(low, ask - tick), F.greatest(high, bid + tick)
    low = F.when(both, low).when(bid > 0, bid).when(ask > 0, ask - least)
    high = F.when(both, high).when(bid > 0, bid + least).when(ask > 0, ask)
    df = states.select(*keep, "inventory", market.floor_to_tick(low, tick).alias("_low"), market.ceil_to_tick(high, tick).alias("_high")).where("_low > 0 and _high > _low")
    df = df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1)))).where(F.col("_low") - F.col("level") * tick > 0)
    against = F.col("inventory") * F.col("side")
    size = F.when(against > 0, F.greatest(F.lit(1), F.lit(quantity // 2))).when(against < 0, F.least(F.lit(2 * quantity), quantity + F.floor(F.abs("inventory") / 4).cast("int"))).otherwise(quantity)
    price = F.when(F.col("side") > 0, F.col("_low") - F.col("level") * tick).otherwise(F.col("_high") + F.col("level") * tick)
    return df.select(*keep, "level", "side", price.alias("price"), size.cast("long").alias("quantity"))


def hedge_orders(exposures: DataFrame, routes: DataFrame, threshold: float, lot: int) -> DataFrame:
    """Orders that bring a book's projected exposure (book_id, beta, inventory, pending) back under the threshold: whole lots on each route by its share."""
    df = exposures.withColumn("exposure", F.col("beta") * (F.col("inventory") + F.col("pending"))).where(F.abs("exposure") > threshold)
    total = routes.groupBy("source").agg(F.sum("weight").alias("total"))
    out = df.join(routes.join(total, "source"), df["book_id"] == F.col("source"))
    lots = F.floor(F.abs("exposure") * F.col("weight") / F.col("total") / lot).cast("long")
    return out.select("book_id", "target", (-F.signum("exposure") * lots * lot).cast("long").alias("quantity")).where("quantity <> 0")


def to_owners(reports: DataFrame, owners: DataFrame, key: str, max_broadcast: int = 1_000_000) -> DataFrame:
    """Reports with the columns of their owner; owners are sent to all tasks only where they are counted to be few."""
    small = owners.limit(max_broadcast + 1).count() <= max_broadcast
    return reports.join(F.broadcast(owners) if small else owners, key)


def repair_wakes(trades: DataFrame, traded: Column, depleted: Column, time: str, report_latency: int, repair_latency: int) -> DataFrame:
    """Wakes of a maker after its book traded or lost a side: one for each cause, later by its latency."""
    causes = F.filter(F.array(F.when(traded, F.struct(F.lit("traded").alias("cause"), F.lit(report_latency).alias("late"))), F.when(depleted, F.struct(F.lit("depleted").alias("cause"), F.lit(repair_latency).alias("late")))), lambda c: c.isNotNull())
    return trades.select("event_id", "book_id", F.col(time), F.explode(causes).alias("c")).select("event_id", "book_id", (F.col(time) + F.col("c.late")).alias("wake_us"), "c.cause")


def complete(seen: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys that are missing, unknown or there more than once, with the fault."""
    counts = seen.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(expected.select(key).distinct().withColumn("_known", F.lit(True)), key, "full_outer")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("_known").isNull(), "unknown").when(F.col("n") > 1, "twice")
    return both.select(key, fault.alias("fault")).where("fault is not null")


def communication(stages: DataFrame, names: list[str]) -> DataFrame:
    """Largest and mean communication time of a rank (rank, stage, seconds), and the imbalance of all its time."""
    ranks = stages.groupBy("rank").agg(F.sum(F.when(F.col("stage").isin(names), F.greatest(F.lit(0.0), "seconds")).otherwise(0.0)).alias("communication"), F.sum(F.greatest(F.lit(0.0), "seconds")).alias("all"))
    return ranks.agg(F.max("communication").alias("max_communication"), F.avg("communication").alias("mean_communication"), F.try_divide(F.max("all"), F.avg("all")).alias("imbalance"))


def config_digest(config) -> str:
    """A digest of a configuration's values; where results go doesn't count."""
    values = {k: v for k, v in asdict(config).items() if k != "output"}
    return hashlib.blake2b(json.dumps(values, sort_keys=True, default=str).encode(), digest_size=8).hexdigest()
