"""Whole-market runs of several books: makers, value traders, hedges and shocks over background flow; moments, calibration and contagion.

Books that aren't coupled are units of work of their own; with hedges a run (all its books) is one. Runs, candidates and repeats spread over
the cluster; feedback between agents stays inside the call.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from heapq import merge
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.kept import keep
from ..functions.rng import MASK, MIX_1, Stream
from . import flow, results
from .book import CANCEL_AT, CANCEL_OWNER, LIMIT, MARKET, TICK, Book
from .hawkes import HawkesConfig, clusters, dealt, hawkes_events


@dataclass
class MarketConfig:
    """One run of several books."""

    books: int = 1
    seconds: float = 2.0
    sample_ms: int = 100
    quote_ms: int = 20
    makers: bool = True
    value_traders: bool = True
    hedging: bool = False
    depth_scale: float = 1.0
    tick: int = TICK
    fundamental: float = 2203550.0
    fundamental_bps: float = 1.0
    value_threshold_bps: float = 1.0
    maker_quantity: int = 100
    maker_levels: int = 1
    risk_limit: float = 5000.0
    shock_s: float | None = None
    shock_multiple: float = 0.0
    shock_quantity: int | None = None
    shocked: tuple = ()
    value_step_bps: float = 1.0
    value_base: int = 50
    value_most: int = 250
    value_capacity: int = 5000
    hedge_threshold: float = 400.0
    hedge_share: float = 0.5
    quantities: tuple = ((25, 200), (25, 200), (25, 700), (25, 700), (25, 500), (25, 500))
    distances: tuple = ((0, 5), (0, 5), (0, 5), (0, 5))
    hawkes: HawkesConfig = field(default_factory=HawkesConfig)


MAKER, VALUE, SHOCK = 1_000_001, 2_000_001, 3_000_001
SAMPLE_SCHEMA = "run_id long, book_id long, time_ns long, best_bid long, best_ask long, bid_depth long, ask_depth long, last_trade long, mid double, spread double, volume long, n_limit_buy long, n_limit_sell long, n_market_buy long, n_market_sell long, n_cancel_bid long, n_cancel_ask long, market_best_removals long, cancel_best_removals long, maker_inventory long, shock_filled long, shock_by_maker long"


def quote_sizes(inventory: int, gross: float, books: int, config: MarketConfig) -> tuple[int, int]:
    """Bid and ask quantity of a maker: the side that adds to its inventory shrinks, the other grows, and both shrink once over half of the risk limit of its books is used."""
    lean = min(0.75, abs(inventory) / max(1.0, config.risk_limit))
    used = gross / (max(1.0, config.risk_limit) * max(1, books))
    scale = 1.0 if used <= 0.5 else max(0.0, 2 * (1 - used))
    bid, ask = (1 - lean if inventory * side > 0 else 1 + lean for side in (1, -1))
    return math.floor(config.maker_quantity * bid * scale + 0.5), math.floor(config.maker_quantity * ask * scale + 0.5)


def drawn(values: tuple[int, ...], rng: Stream) -> int:
    """One of a range (low, high), both included, or one of a longer list."""
    if len(values) == 2:
        low, high = values
        return low + int(rng.uniform() * (high - low + 1))
    return values[int(rng.uniform() * len(values))]


def random_order(kind: int, state: dict, rng: Stream, config: MarketConfig) -> tuple[int, int, int, int, int]:
    """Action, side, quantity, price and distance of a background event, by its place in EVENT_NAMES: limits rest a drawn number of ticks behind their own side's best (or the middle, or the fundamental)."""
    side = (1, -1)[kind % 2]
    quantity = drawn(config.quantities[kind], rng)
    if 2 <= kind < 4:
        return MARKET, side, quantity, 0, 0
    away = max(0, drawn(config.distances[kind % 4], rng))
    if kind >= 4:
        return CANCEL_AT, side, quantity, 0, away
    own = state["best_bid" if side > 0 else "best_ask"]
    anchor = own or round(state["mid"] or state["last_trade"] or config.fundamental)
    return LIMIT, side, quantity, anchor - side * away * config.tick, away


def simulate(run_id: int, seed: int, config: MarketConfig, which: range | None = None) -> Iterator[tuple]:
    """Samples of a run's books (all, or those in a range), in time order. Clocks and background events are merged by time; at one time clocks come first, then books in order."""
    end, members = round(config.seconds * 1e9), which or range(config.books)
    books = {b: Book(config.tick, depth_scale=config.depth_scale) for b in members}
    rngs = {b: Stream((seed * MIX_1 + 7919 * b + 1) & MASK) for b in members}
    fair, position, counts = dict.fromkeys(members, config.fundamental), dict.fromkeys(members, 0), {b: [0] * 6 for b in members}
    removed, shocked = {b: [0, 0] for b in members}, {b: [0, 0] for b in members}
    held = dict.fromkeys(members, 0)
    clock = lambda what, start, step, stop: ((t, what, -1, -1) for t in range(start, stop, step))
    flows = ((t, 3, b, k) for b in members for t, k in zip(*(x.tolist() for x in clusters(config.hawkes, seed + 911382323 * (b + 1), config.seconds))))
    quote = config.quote_ms * 1_000_000
    clocks = [clock(0, 0, config.sample_ms * 1_000_000, end + 1), clock(1, quote, quote, end) if config.makers or config.value_traders else (), [(round(config.shock_s * 1e9), 2, -1, -1)] if config.shock_s is not None else ()]
    sequence = 0

    def send(b: int, action: int, side: int, quantity: int, price: int, distance: int, owner: int, time: int) -> int:
        nonlocal sequence
        sequence += 1
        before = books[b].touched(action, side)
        done = books[b].apply(action, side, quantity, price, distance, owner, sequence, time)[0]
        if owner == 0 and before and books[b].touched(action, side) != before and (action == CANCEL_AT or done):
            removed[b][action == CANCEL_AT] += 1
        for t in books[b].trades:
            position[b] += t[3] * ((t[4] == MAKER + b) - (t[5] == MAKER + b))
            held[b] += t[3] * ((t[4] == VALUE + b) - (t[5] == VALUE + b))
            if SHOCK + b in (t[4], t[5]):
                shocked[b][0] += t[3]
                shocked[b][1] += t[3] * (MAKER + b in (t[4], t[5]))
        books[b].trades.clear()
        return done

    def quotes(b: int, time: int) -> None:
        send(b, CANCEL_OWNER, 1, 0, 0, 0, MAKER + b, time)
        state, tick = books[b].state(), config.tick
        skew = max(-3, min(3, round(0.25 * position[b] / max(1, config.maker_quantity)))) * tick
        low = int(((state["mid"] or state["last_trade"] or fair[b]) - skew) // tick)
        bid, ask = (low - 1) * tick, (low + 1) * tick
        bid = min(bid, state["best_ask"] - tick) if state["best_ask"] else bid
        ask = max(ask, state["best_bid"] + tick) if state["best_bid"] else ask
        # One maker holds all books where hedges couple them, else each book has its own.
        gross = sum(abs(x) for x in position.values()) if config.hedging else abs(position[b])
        sizes = quote_sizes(position[b], gross, len(books) if config.hedging else 1, config)
        for level in range(config.maker_levels):
            send(b, LIMIT, 1, sizes[0], bid - level * tick, 0, MAKER + b, time)
            send(b, LIMIT, -1, sizes[1], ask + level * tick, 0, MAKER + b, time)

    def value(b: int, time: int) -> None:
        """Steps of a base quantity for each step of mispricing over the threshold, as far as the capacity left allows."""
        mid = books[b].state()["mid"]
        excess = abs(1e4 * (mid / fair[b] - 1)) - config.value_threshold_bps if mid else 0
        if excess > 0:
            side = -1 if mid > fair[b] else 1
            size = min(config.value_most, config.value_base * (1 + int(excess // config.value_step_bps)), config.value_capacity - side * held[b])
            if size > 0:
                send(b, MARKET, side, size, 0, 0, VALUE + b, time)

    for time, what, book, kind in merge(*clocks, sorted(flows)):
        if what == 3:
            counts[book][kind] += 1
            send(book, *random_order(kind, books[book].state(), rngs[book], config), 0, time)
            continue
        for b, each in books.items():
            if what == 0:
                s = each.state()
                yield (run_id, b, time, s["best_bid"], s["best_ask"], s["bid_depth"], s["ask_depth"], s["last_trade"], s["mid"], float(s["best_ask"] - s["best_bid"]) if s["mid"] else 0.0, each.bought + each.sold, *counts[b], *removed[b], position[b], *shocked[b])
            elif what == 2 and b in config.shocked:
                send(b, MARKET, -1, config.shock_quantity or max(1, round(config.shock_multiple * each.state()["bid_depth"])), 0, 0, SHOCK + b, time)
            elif what == 1:
                sigma = config.fundamental_bps / 1e4 * math.sqrt(config.quote_ms / 1000)
                fair[b] *= math.exp(sigma * rngs[b].normal() - sigma * sigma / 2)
                if config.makers:
                    quotes(b, time)
                if config.value_traders:
                    value(b, time)
        excess = sum(position.values())
        if what == 1 and config.hedging and len(books) > 1 and abs(excess) > config.hedge_threshold:
            send(0, MARKET, -1 if excess > 0 else 1, int(abs(excess) * config.hedge_share), 0, 0, MAKER, time)


def run_markets(runs: DataFrame, config: MarketConfig, varied: tuple[str, ...] = (), chunk: int = 5000) -> DataFrame:
    """Samples of each run (run_id, seed, and a column for each varied field of the configuration or of its point process)."""
    columns = [c.split()[0] for c in SAMPLE_SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SAMPLE_SCHEMA.split(", ")])
    process = set(asdict(config.hawkes))

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                inner, outer = ({k: row[k] for k in varied if (k in process) == yes} for yes in (True, False))
                market = replace(config, hawkes=replace(config.hawkes, **inner), **outer) if varied else config
                yield from simulate(row["run_id"], row["seed"], market, range(row["first_book"], row["first_book"] + row["n_books"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Batches hold the samples of many runs, as a batch for each run costs more than the run.
        rows = samples(batches)
        while part := list(islice(rows, chunk)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*part), schema.types, strict=True)], names=columns)

    # A run is a unit of work, or each of its books where no hedge couples them.
    apart = F.sequence(F.lit(0), F.lit(config.books - 1)) if not config.hedging else F.array(F.lit(0))
    units = runs.select("run_id", "seed", *varied, F.explode(apart).alias("first_book"), F.lit(1 if not config.hedging else config.books).alias("n_books"))
    return dealt(units, "run_id", "first_book").mapInArrow(run, SAMPLE_SCHEMA)


def with_volume(samples: DataFrame) -> DataFrame:
    """Volume since the sample before, not below 0, in place of the running one."""
    return samples.withColumn("volume", F.greatest(F.lit(0), F.col("volume") - F.coalesce(F.lag("volume").over(flow.Window.partitionBy("run_id", "book_id").orderBy("time_ns")), F.lit(0))))


def run_moments(samples: DataFrame, config: MarketConfig) -> DataFrame:
    """(run_id, book_id, name, value) of all moments of each book of each run."""
    # Written once, as each pass over the samples would run the markets again.
    samples, keys = keep(samples), ["run_id", "book_id"]
    wide = stats.market_moments(with_volume(samples), keys, ["time_ns"], config.sample_ms / 1000)
    seconds = max(1e-9, config.seconds)
    n = {k: F.max(f"n_{k}") / seconds for k in ("limit_buy", "limit_sell", "market_buy", "market_sell", "cancel_bid", "cancel_ask")}
    rate = lambda top, a, b: F.coalesce(F.try_divide(F.max(top).cast("double"), (F.max(a) + F.max(b)).cast("double")), F.lit(0.0))
    rates = samples.groupBy(*keys).agg(
        *[v.alias(f"{k}_rate") for k, v in n.items()],
        rate("market_best_removals", "n_market_buy", "n_market_sell").alias("market_order_best_removal_rate"), rate("cancel_best_removals", "n_cancel_bid", "n_cancel_ask").alias("cancel_best_removal_rate"),
        (n["limit_buy"] + n["limit_sell"]).alias("limit_order_rate"), (n["market_buy"] + n["market_sell"]).alias("market_order_rate"), (n["cancel_bid"] + n["cancel_ask"]).alias("cancel_rate"),
    )
    wide = wide.join(rates, keys)
    names = [c for c in wide.columns if c not in keys]
    return wide.unpivot(keys, names, "name", "value").withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(0.0)))


def calibrate(spark: SparkSession, candidates: DataFrame, targets: DataFrame, config: MarketConfig, varied: tuple[str, ...], repeats: int = 2) -> DataFrame:
    """Loss of each candidate (candidate_id and the varied fields): repeats with own seeds are averaged by moment first."""
    runs = candidates.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("run_id", (F.col("candidate_id") * repeats + F.col("repeat")).cast("long")).withColumn("seed", F.col("run_id") * 104729 + 1)
    moments = run_moments(run_markets(runs, config, varied), config)
    averaged = moments.withColumn("candidate_id", F.floor(F.col("run_id") / repeats).cast("long")).groupBy("candidate_id", "name").agg(F.avg("value").alias("value"))
    return flow.weighted_loss(averaged, targets, ["candidate_id"])


def shock_metrics(samples: DataFrame, shocked: tuple) -> DataFrame:
    """For each run and time the books' state against that at time 0, what the shock order filled, and the makers' exposure."""
    samples = keep(samples)  # else each pass runs the markets again
    first = samples.where("time_ns = 0").select("run_id", "book_id", F.col("spread").alias("spread_0"), (F.col("bid_depth") + F.col("ask_depth")).alias("depth_0"))
    rows = samples.join(first, ["run_id", "book_id"]).withColumns({"depth": F.col("bid_depth") + F.col("ask_depth"), "sided": (F.col("best_bid") > 0) & (F.col("best_ask") > F.col("best_bid")), "hit": F.col("book_id").isin(*shocked) if shocked else F.lit(False)})
    filled = rows.groupBy("run_id", "time_ns").agg(F.sum("shock_filled").alias("shock_filled"), F.sum("shock_by_maker").alias("shock_by_maker"), flow.fixed_sum(F.abs(F.col("maker_inventory").cast("double"))).alias("maker_exposure"))
    return results.contagion_sums(rows, ["run_id", "time_ns"]).join(filled, ["run_id", "time_ns"])


__all__ = ["HawkesConfig", "MarketConfig", "calibrate", "hawkes_events", "run_markets", "run_moments", "shock_metrics", "simulate", "with_volume"]
