"""What runs and flows come to: ledgers, counters, checks and summaries, as aggregations over tables of orders, trades, reports and samples."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import market, stats
from ..functions.windows import carried, decayed_means, framed, has_long, lagged, last_of, running_totals, total_of
from . import flow, merging


def combined_stages(stages: DataFrame) -> DataFrame:
    """(rank, stage, total_seconds, calls, mean_seconds) of timed calls (rank, stage, seconds); negative times count as none."""
    out = stages.groupBy("rank", "stage").agg(F.sum(F.greatest(F.lit(0.0), "seconds")).alias("total_seconds"), F.count(F.lit(1)).alias("calls"))
    return out.withColumn("mean_seconds", F.coalesce(F.try_divide("total_seconds", "calls"), F.lit(0.0)))


def run_rollup(stages: DataFrame, communication: list[str], agents: str) -> DataFrame:
    """Of all ranks: largest agent time, largest and mean communication time, and the calls of the agent stage."""
    talk = F.col("stage").isin(communication)
    ranks = stages.groupBy("rank").agg(F.sum(F.when(talk, F.greatest(F.lit(0.0), "seconds")).otherwise(0.0)).alias("c"), F.sum(F.when(F.col("stage") == agents, F.greatest(F.lit(0.0), "seconds")).otherwise(0.0)).alias("a"), F.count_if(F.col("stage") == agents).alias("n"))
    return ranks.agg(F.max("a").alias("max_agent_seconds"), F.max("c").alias("max_communication_seconds"), F.avg("c").alias("mean_communication_seconds"), F.sum("n").alias("generated"))


def removal_rates(done: DataFrame, keys: list[str], action: str, removed: str, markets, cancels) -> DataFrame:
    """Shares of market orders and of cancels that took the best level away."""
    share = lambda kind: F.coalesce(F.try_divide(F.count_if(kind & F.col(removed)).cast("double"), F.count_if(kind).cast("double")), F.lit(0.0))
    return done.groupBy(*keys).agg(share(F.col(action).isin(*markets)).alias("market_order_best_removal_rate"), share(F.col(action).isin(*cancels)).alias("cancel_best_removal_rate"))


def report_counts(reports: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    return reports.groupBy(*keys).agg(F.count(F.lit(1)).alias("reports"), F.count_if(F.col(kind) == "FILL").alias("fill_reports"), F.count_if(F.col(kind) != "FILL").alias("order_result_reports"))


def conservation(messages: DataFrame, keys: list[str], arrival: str, end: int) -> DataFrame:
    """Generated, processed (arrived before the end) and pending messages, and whether none is lost."""
    out = messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("generated"), F.count_if(F.col(arrival) < end).alias("processed"), F.count_if(F.col(arrival) >= end).alias("pending_end"))
    return out.withColumn("conserved", F.col("generated") == F.col("processed") + F.col("pending_end"))


def structural_validity(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """For each key whether all rows keep every rule, and how many break each."""
    sound = F.lit(True)
    for rule in rules.values():
        sound = sound & F.coalesce(rule, F.lit(False))
    return rows.groupBy(*keys).agg(F.every(sound).alias("structurally_valid"), *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(f"{name}_broken") for name, rule in rules.items()])


def message_total(counters: DataFrame, names: list[str], out: str = "messages") -> DataFrame:
    total = F.lit(0).cast("long")
    for n in names:
        total = total + F.coalesce(F.col(n), F.lit(0))
    return counters.withColumn(out, total)


def admission_faults(events: DataFrame, id_col: str, key: str, known: Column, at: Column, now: int, end: int, quantity: Column, before: Column) -> DataFrame:
    """(id, fault) of events that can't be scheduled: of an unknown book, in the past, after the end, empty, with a key that another one has, or not after the one before."""
    twice = events.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(key).alias("_key"), F.lit(True).alias("_twice"))
    rows = events.join(twice, F.col(key) == F.col("_key"), "left")
    faults = {"book": ~F.coalesce(known, F.lit(False)), "past": at < now, "end": at > end, "quantity": quantity <= 0, "twice": F.col("_twice"), "order": at <= before}
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in faults.items()]), lambda x: x.isNotNull())
    return rows.select(id_col, F.explode(found).alias("fault"))


def at_boundaries(samples: DataFrame, at: str, interval: int) -> DataFrame:
    return samples.where(F.pmod(F.col(at), F.lit(interval)) == 0)


def active_orders(wakes: DataFrame, keys: list[str], order: list[str], wanted: str, start: Column, end: Column, parent: int, width: float | None = None) -> DataFrame:
    """Wakes of institutions inside their active span while some of the parent order remains, with what remained before each (column remaining)."""
    inside = wakes.where(F.col(order[0]).between(start, end))
    upto = running_totals(inside, keys, order, {"_upto": F.col(wanted)}, width)
    return upto.withColumn("remaining", F.greatest(F.lit(0), parent - F.col("_upto") + F.col(wanted))).where("remaining > 0").drop("_upto")


def gated(decisions: DataFrame, keys: list[str], order: list[str], side: str, quantity: str, limit: int, width: float | None = None) -> DataFrame:
    """Decisions with the inventory before each (column inventory) and whether the risk limit allows its side."""
    signed = F.col(side) * F.col(quantity)
    rows = running_totals(decisions, keys, order, {"_upto": signed}, width).withColumn("inventory", F.col("_upto") - signed).drop("_upto")
    return rows.withColumn("allowed", F.when(F.col(side) > 0, F.col("inventory") < limit).when(F.col(side) < 0, F.col("inventory") > -limit).otherwise(False))


def ledger(trades: DataFrame, keys: list[str], order: list[str], side: str, quantity: str, price: str, width: float | None = None) -> DataFrame:
    """Inventory and cash after each trade."""
    q = F.col(side) * F.col(quantity)
    return running_totals(trades, keys, order, {"inventory": q, "cash": -q * F.col(price)}, width)


def matched_hedges(pending: DataFrame, fills: DataFrame) -> DataFrame:
    """Pending hedges (sequence, quantity with a sign) with the fills (sequence, filled with a sign) that go their way, and what is left of each."""
    same = fills.join(pending.select("sequence", F.signum("quantity").alias("_s")), "sequence").where(F.signum("filled") == F.col("_s"))
    done = same.groupBy("sequence").agg(F.sum("filled").alias("filled"))
    out = pending.join(done, "sequence", "left").withColumn("filled", F.coalesce("filled", F.lit(0).cast("long")))
    return out.withColumn("left", F.signum("quantity").cast("long") * F.greatest(F.lit(0), F.abs("quantity") - F.abs("filled")))


def trades_of_makers(trades: DataFrame, makers: DataFrame, buyer: str = "buyer", seller: str = "seller") -> DataFrame:
    """Trades with a maker as buyer or seller, once each: two semi joins by equality, so neither is a nested loop."""
    m = makers.select("owner").distinct()
    as_buyer = trades.join(m, trades[buyer] == m["owner"], "left_semi")
    others = trades.join(m, trades[buyer] == m["owner"], "left_anti")
    return as_buyer.unionByName(others.join(m, others[seller] == m["owner"], "left_semi"))


def first_trade(trades: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    return trades.groupBy(*keys).agg(F.min_by(F.struct(*payload), F.struct(*order)).alias("f")).select(*keys, "f.*")


def rolling(df: DataFrame, keys: list[str], order: list[str], x: str, samples: int = 30, share: float = 0.2, width: float | None = None) -> DataFrame:
    """Sample deviation of the last samples (0 for fewer than two), and the exponentially weighted mean of all values so far, the first of them as it is."""
    long = has_long(df, keys)
    value = F.col(x).cast("double")
    wide = framed(df, keys, order, samples, lambda w: {"volatility": F.coalesce(F.stddev_samp(value).over(w.rowsBetween(-(samples - 1), 0)), F.lit(0.0))}, width, long=long)
    return decayed_means(wide, keys, order, x, share, "ewma", width, long)


def stale_uses(samples: DataFrame, keys: list[str], order: list[str], valid: Column, value: str, width: float | None = None) -> DataFrame:
    """For each key: samples, those that had to use an older valid value, and those without any."""
    shown = carried(samples.withColumn("_v", F.when(valid, F.col(value))), keys, order, {"_known": last_of(F.col("_v"), order), "_n": total_of(F.lit(1))}, width)
    stale = F.col("_v").isNull()
    return shown.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.count_if(stale & F.col("_known").isNotNull()).alias("stale"), F.count_if(F.col("_known").isNull()).alias("missing"))


def recorder(orders: DataFrame, keys: list[str], kind: str, quantity: str, names: tuple[str, ...], cancel_all: str) -> DataFrame:
    """What a run is calibrated on: counts of each event kind, mean quantity of each, and cancels of all of an owner's orders."""
    per_kind = [c for n in names for c in (F.count_if(F.col(kind) == n).alias(f"{n}_events"), F.coalesce(F.avg(F.when(F.col(kind) == n, F.col(quantity))), F.lit(0.0)).alias(f"{n}_mean_quantity"))]
    return orders.groupBy(*keys).agg(*per_kind, F.count_if(F.col(kind) == cancel_all).alias("owner_cancel_messages"))


def asset_summary(samples: DataFrame, keys: list[str], order: list[str], tick: int, expected: int, seconds: float, events: list[str], width: float | None = None) -> DataFrame:
    """One row for each asset: sample counts, validity, background rate and one-pass moments (population variance, fourth moment about zero, unequal counts)."""
    valid = market.two_sided(F.col("best_bid"), F.col("best_ask"))
    rows = samples.withColumn("_ok", valid).withColumn("_mid", F.when(valid, (F.col("best_bid") + F.col("best_ask")) / 2))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_ok")).alias("bad"), sum((F.max(e) for e in events), F.lit(0)).cast("long").alias("events"), F.avg(F.when(F.col("_ok"), (F.col("best_ask") - F.col("best_bid")) / tick)).alias("spread"), F.avg(F.when(F.col("_ok"), F.col("bid_depth"))).alias("bid"), F.avg(F.when(F.col("_ok"), F.col("ask_depth"))).alias("ask"))
    long = has_long(rows, keys)
    steps = lagged(rows.where("_ok"), keys, order, {"_before": ("_mid", 1)}, width, long).where("_before is not null").withColumn("_r", F.log("_mid") - F.log("_before")).withColumn("_a", F.abs("_r"))
    steps = lagged(steps, keys, order, {"_b": ("_a", 1)}, width, long)
    one = stats.one_pass(F.col("_r"))
    m = steps.groupBy(*keys).agg(one["variance"].alias("v"), one["kurtosis"].alias("q"), stats.one_pass_acf(F.col("_a"), F.col("_b")).alias("c"), F.avg(F.when(F.col("_mid") != F.col("_before"), 1.0).otherwise(0.0)).alias("moved"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return counts.join(m, keys, "left").select(
        *keys, F.col("n").alias("sample_count"), F.lit(expected).alias("expected_sample_count"), F.col("bad").alias("invalid_sample_count"), ((F.col("n") == expected) & (F.col("bad") == 0)).alias("structurally_valid"),
        F.col("events").alias("background_event_count"), (F.col("events") / max(1e-9, seconds)).alias("background_event_rate"), zero(F.col("spread")).alias("mean_spread_ticks"), zero(F.col("bid")).alias("mean_bid_depth"), zero(F.col("ask")).alias("mean_ask_depth"),
        zero(F.col("moved")).alias("mid_move_rate"), zero(F.col("v")).alias("return_variance"), zero(F.col("q")).alias("return_kurtosis"), zero(F.col("c")).alias("absolute_return_acf1"),
    )


def contagion_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Spreads, depths, and shares of affected and of two-sided books, over all, over shocked and over other books (hit, sided, spread, depth and both at the start), in one aggregation."""
    bad = ~F.col("sided") | (F.col("spread") > 2 * F.col("spread_0")) | (F.col("depth") < 0.5 * F.col("depth_0"))
    share = lambda x: F.when(x, 1.0).otherwise(0.0)
    hit, sided = F.col("hit"), F.col("sided")
    return rows.groupBy(*keys).agg(
        F.avg(F.when(sided, F.col("spread"))).alias("mean_spread"), F.avg("depth").alias("mean_top_depth"), F.avg(share(bad)).alias("affected"), F.avg(share(sided)).alias("two_sided"),
        F.avg(F.when(hit, share(bad))).alias("affected_shocked"), F.avg(F.when(~hit, share(bad))).alias("affected_unshocked"), F.avg(F.when(hit & sided, F.col("spread"))).alias("spread_shocked"), F.avg(F.when(~hit & sided, F.col("spread"))).alias("spread_unshocked"),
        F.avg(F.when(hit, F.col("depth"))).alias("depth_shocked"), F.avg(F.when(~hit, F.col("depth"))).alias("depth_unshocked"),
    )


def boundary_metrics(rows: DataFrame, time: str, risk_limit: float) -> DataFrame:
    """The 13 columns of a shock run's boundaries: contagion_sums() by time, all makers' gross exposure (rows have exposure), and the scale that their shared risk leaves to quotes.

    Quotes shrink once over half of the limit is used and stop at the limit. Shares and means over no book are 0.
    """
    sums = contagion_sums(rows, [time])
    gross = rows.groupBy(time).agg(flow.fixed_sum(F.abs(F.col("exposure").cast("double"))).alias("shared_gross_exposure"))
    scale = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (1 - F.col("shared_gross_exposure") / risk_limit)))
    shown = {
        "mean_spread": "mean_spread_bps", "mean_top_depth": "mean_top_depth", "affected": "affected_asset_fraction", "two_sided": "two_sided_book_fraction", "affected_shocked": "affected_shocked_fraction", "affected_unshocked": "affected_unshocked_fraction",
        "spread_shocked": "shocked_mean_spread_bps", "spread_unshocked": "unshocked_mean_spread_bps", "depth_shocked": "shocked_mean_top_depth", "depth_unshocked": "unshocked_mean_top_depth",
    }
    return sums.join(gross, time).select(F.col(time).alias("time_seconds"), *[F.coalesce(F.col(c), F.lit(0.0)).alias(name) for c, name in shown.items()], "shared_gross_exposure", scale.alias("shared_quote_scale"))


def shock_targets(books: DataFrame, share: float, seed: int, multiple: float, fixed: int | None = None, enabled: bool = True) -> DataFrame:
    """Each asset (book_id, symbol, bid_depth) with whether it is shocked (the share of lowest draws, one at least) and what is sold there."""
    from ..functions import rng

    n = books.count()
    drawn = rng.draw(F.col("book_id") + seed, F.lit(1))
    chosen = flow.lowest(books, drawn, "book_id", max(1, round(share * n)) if n else 0).select("book_id", F.lit(1).alias("_hit"))
    size = F.lit(fixed) if fixed is not None else market.scaled_quantity(F.col("bid_depth"), multiple)
    hit = F.coalesce("_hit", F.lit(0))
    return books.join(chosen, "book_id", "left").select(F.col("book_id").alias("asset_id"), "symbol", hit.alias("is_shock_target"), F.lit(int(enabled)).alias("shock_enabled"), F.when(hit == 1, size).otherwise(0).cast("long").alias("counterfactual_sell_quantity"))


def simulation_summary(summary: DataFrame, rollup: DataFrame, ranks: int, wall_seconds: float) -> DataFrame:
    """The one-row summary of a windowed run: its counters and market means, with the times of its stages (run_rollup()) and its throughput."""
    total = (F.col("processed_strategic") + F.col("processed_background")).cast("double")
    times = rollup.select(*[F.col(c).alias(f"_{c}") for c in ("max_agent_seconds", "max_communication_seconds", "mean_communication_seconds")])
    # One row of times, joined to a row for each run.
    out = summary.join(F.broadcast(times))
    return out.select(
        "profile", F.lit(ranks).alias("ranks"), F.lit(max(1, ranks - 1)).alias("agent_workers"), "duration_seconds", "sync_window_us", "population_scale", "market_makers", "momentum", "informed", "institutional", "total_agents",
        "generated_strategic", "processed_strategic", "processed_background", "fill_reports", "order_result_reports", "pending_end", "peak_pending", F.lit(wall_seconds).alias("wall_seconds"),
        (total / wall_seconds if wall_seconds > 0 else F.lit(0.0)).alias("throughput_events_per_second"), *[F.col(f"_{c}").alias(c) for c in ("max_agent_seconds", "max_communication_seconds", "mean_communication_seconds")],
        "mean_spread", "mean_best_bid_depth", "mean_best_ask_depth",
    )


def distributed_summary(summary: DataFrame, moments: DataFrame, ranks: int, wall_seconds: float, activations: int, mode: str = "windowed", ended: str = "completed", final_ns: int = 0) -> DataFrame:
    """The summary of a run with the moments of its states (asset_summary() by run_id), how it ended and whether it is structurally valid."""
    m = moments.select("run_id", F.col("structurally_valid").alias("_valid"), *[F.col(c).alias(f"_{c}") for c in ("mean_spread_ticks", "mean_bid_depth", "mean_ask_depth", "mid_move_rate", "return_variance", "return_kurtosis", "absolute_return_acf1")])
    return summary.join(m, "run_id").select(
        F.lit(ranks).alias("ranks"), "duration_seconds", F.lit(mode).alias("communication_mode"), "sync_window_us", F.lit(0).alias("shared_snapshot"), F.lit(1.0).alias("fixed_hawkes_activity_scale"), "market_makers", "momentum", "informed", "institutional", "total_agents",
        "generated_strategic", "processed_strategic", "processed_background", "pending_end", "peak_pending", F.lit(activations).alias("activations"), F.lit(wall_seconds).alias("wall_seconds"), F.lit(int(ended != "completed")).alias("terminated_early"),
        F.lit(final_ns).alias("final_simulated_time_ns"), F.lit(ended).alias("termination_reason"), (F.col("_valid") & F.col("conserved")).cast("int").alias("structurally_valid"),
        *[F.col(f"_{c}").alias(c) for c in ("mean_spread_ticks", "mean_bid_depth", "mean_ask_depth", "mid_move_rate", "return_variance", "return_kurtosis", "absolute_return_acf1")],
    )


def book_summary(samples: DataFrame, tapes: DataFrame, symbols: DataFrame, tick: int, expected: int, seconds: float, ranks: int | None = None) -> DataFrame:
    """A row for each book of a run: final state, moments, event counts, inventories, its tape's length and hash, and those of all tapes together.

    samples: of run_markets(); tapes: of tape_hash() (book_id, trades, tape_hash); symbols: book_id and symbol. With ranks, also who holds a book.
    """
    kinds = [f"n_{n}" for n in market.EVENT_NAMES]
    last = samples.groupBy("book_id").agg(F.max_by(F.struct("best_bid", "best_ask", "bid_depth", "ask_depth", "last_trade", "maker_inventory", *kinds), F.col("time_ns")).alias("s"), F.max("time_ns").alias("final_time_ns")).select("book_id", "s.*", "final_time_ns")
    moments = asset_summary(samples, ["book_id"], ["time_ns"], tick, expected, seconds, kinds).drop("background_event_count", "background_event_rate", "invalid_sample_count")
    whole = combined_tape(tapes)
    owner = [F.pmod(F.col("book_id"), F.lit(ranks)).alias("owner_rank"), F.lit(ranks).alias("mpi_ranks")] if ranks else []
    events = sum((F.col(k) for k in kinds), F.lit(0))
    return symbols.join(last, "book_id").join(moments, "book_id").join(tapes, "book_id", "left").join(F.broadcast(whole)).select(
        "book_id", "symbol", *owner, events.alias("processed_events"), F.coalesce("trades", F.lit(0)).alias("trade_count"), "tape_hash",
        *[F.col(c).alias(f"{c}_ticks" if "depth" not in c else f"best_{c}") for c in ("best_bid", "best_ask", "bid_depth", "ask_depth")], F.col("last_trade").alias("last_trade_price_ticks"), F.col("maker_inventory").alias("market_maker_inventory"),
        "sample_count", "expected_sample_count", "structurally_valid", "mean_spread_ticks", "mean_bid_depth", "mean_ask_depth", "mid_move_rate", "return_variance", "return_kurtosis", "absolute_return_acf1",
        *[F.col(f"n_{n}").alias(f"{n}_events") for n in market.EVENT_NAMES], "combined_trade_count", "combined_trade_hash", "final_time_ns",
    )


def combined_tape(tapes: DataFrame) -> DataFrame:
    """Length and hash of all books' tapes together: a digest of the books, their lengths and their hashes in order of book, joined from parts; one row."""
    half = lambda at: F.coalesce(F.conv(F.substring("tape_hash", at, 8), 16, 10).cast("long"), F.lit(0))
    rows = tapes.select("book_id", F.col("trades").cast("long").alias("trades"), half(1).alias("_high"), half(9).alias("_low"))
    digest = merging.tape_digests(rows, [], ["book_id"], ["book_id", "trades", "_high", "_low"], "_n", "_d").select(F.lpad(F.lower(F.hex(F.coalesce("_d", F.lit(0)))), 16, "0").alias("combined_trade_hash"))
    total = rows.agg(F.coalesce(F.sum("trades"), F.lit(0)).alias("combined_trade_count"))
    return total.join(F.broadcast(digest))  # one row each


@dataclass
class StageClock:
    """Wall time of named stages of a driver program, as rows for combined_stages()."""

    rank: int = 0
    host: str = ""
    taken: list[tuple[int, str, str, float]] = field(default_factory=list)

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.taken.append((self.rank, self.host, name, time.perf_counter() - began))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.taken, "rank int, host string, stage string, seconds double")


def gathered(clocks: list[DataFrame]) -> DataFrame:
    """The rows of several clocks as one table."""
    out = clocks[0]
    for more in clocks[1:]:
        out = out.unionByName(more)
    return out
