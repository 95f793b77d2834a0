"""Order-flow operators: as-of lookups, carrying forward, merging flows, sampling grids, set-based matching, ladders and accounts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import market
from ..functions.kept import keep
from ..functions.windows import carried, extreme_of, has_long, last_known, row_numbers, running_totals, total_of


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, payload: list[str], lookback: int = 0, tolerance: int | None = None, width: int | None = None, long: bool | None = None) -> DataFrame:
    """left with the payload of the last right row of its key at or before time - lookback; null if there is none, or if it is older than the tolerance.

    Both sides are united and the last right row is carried forward, over slices of time, so a hot key isn't one task; equal times see the right row.
    Of right rows with one time, the one with the largest payload counts.
    """
    carried = F.struct(F.col(time).alias("_at"), *[F.col(c) for c in payload])
    asked = left.withColumn("_t", F.col(time) - lookback).withColumn("_side", F.lit(1)).withColumn("_given", F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType))
    given = right.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), carried.alias("_given"))
    both = last_known(asked.unionByName(given, allowMissingColumns=True), keys, ["_t", "_side", "_given"], F.col("_given"), "_found", width, long).where("_side = 1")
    if tolerance is not None:
        both = both.withColumn("_found", F.when(F.col("_t") - F.col("_found._at") <= tolerance, F.col("_found")))
    return both.select(*left.columns, *[F.col(f"_found.{c}").alias(f"asof_{c}") for c in payload])


def own_past(df: DataFrame, keys: list[str], time: str, payload: list[str], lookback: int, width: int | None = None, long: bool | None = None) -> DataFrame:
    """asof() of a flow with itself: df with the payload of the last row of its key at or before time - lookback. One window, so that df is read once."""
    if has_long(df, keys) if long is None else long:
        df = keep(df)
        return asof(df, df, keys, time, payload, lookback, width=width, long=True)
    latest = F.max(F.struct(F.col(time), *[F.col(c) for c in payload])).over(Window.partitionBy(*keys).orderBy(time).rangeBetween(Window.unboundedPreceding, -lookback))
    return df.withColumn("_past", latest).select(*df.columns, *[F.col(f"_past.{c}").alias(f"asof_{c}") for c in payload])


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, width: int | None = None, long: bool | None = None) -> DataFrame:
    """The last value that isn't null, up to and including the row."""
    return last_known(df, keys, order, value, out, width, long)


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, minima: dict[str, Column] | None = None, width: int | None = None, long: bool | None = None) -> DataFrame:
    """Sums, maxima and minima up to and including the row, by name. width: of the slices of the order's first column, if known."""
    values = {n: total_of(v) for n, v in (sums or {}).items()} | {n: extreme_of(v, True) for n, v in (maxima or {}).items()} | {n: extreme_of(v, False) for n, v in (minima or {}).items()}
    return carried(df, keys, order, values, width, long)


def trailing(df: DataFrame, keys: list[str], time: str, span: int, value: Column, out: str) -> DataFrame:
    """The sum over the span of time that ends at the row: the window of a bin of one span and of the one before it, so a hot key is spread over its bins."""
    rows = df.withColumn("_bin", F.floor(F.col(time) / span).cast("long")).withColumn("_x", value).withColumn("_own", F.lit(True))
    # Of the bin before, what the window needs: a row for each time.
    guests = rows.groupBy(*keys, time, "_bin").agg(F.sum("_x").alias("_x")).withColumn("_bin", F.col("_bin") + 1)
    w = Window.partitionBy(*keys, "_bin").orderBy(time).rangeBetween(-span, 0)
    both = rows.unionByName(guests, allowMissingColumns=True).withColumn(out, F.sum("_x").over(w))
    return both.where("_own").drop("_bin", "_x", "_own")


def merge_flows(flows: list[DataFrame], keys: list[str], order: list[str], out: str = "position", width: int | None = None) -> DataFrame:
    """Several flows as one, numbered within each key; of rows with equal order the earlier flow's come first."""
    both = None
    for i, flow in enumerate(flows):
        flow = flow.withColumn("flow", F.lit(i))
        both = flow if both is None else both.unionByName(flow)
    first, *rest = order
    return row_numbers(both, keys, [first, "flow", *rest], out, width)


def grid(df: DataFrame, keys: list[str], time: str, step: int, end: int) -> DataFrame:
    """keys with each multiple of step from 0 to end, both included."""
    return df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(end).cast("long"), F.lit(step).cast("long"))).alias(time))


def union_of_clocks(spark, steps: list[int], end: int) -> DataFrame:
    """Each boundary of any clock once, with how many clocks tick there."""
    ticks = None
    for step in steps:
        clock = spark.range(0, end + 1, step).select(F.col("id").alias("boundary"))
        ticks = clock if ticks is None else ticks.union(clock)
    return ticks.groupBy("boundary").agg(F.count(F.lit(1)).alias("clocks"))


def union_of_ticks(ticks: DataFrame, clock: str, boundary: str) -> DataFrame:
    """Each boundary of any clock once, with how many clocks tick there, however often each does."""
    return ticks.select(clock, boundary).distinct().groupBy(boundary).agg(F.count(F.lit(1)).alias("clocks"))


def fifo_match(takers: DataFrame, makers: DataFrame, keys: list[str], taker_order: list[str], maker_order: list[str], quantity: str, lots: int = 64, width: int | None = None) -> DataFrame:
    """Fills (taker, maker, quantity) of takers that sweep makers in order, without cancels between: the overlaps of running quantities.

    Both sides are cut at multiples of a lot of running quantity, so the join has the lot as an equality besides the key and a
    hot key is spread over its lots. taker and maker are row numbers within the key.
    """

    def spans(df: DataFrame, order: list[str], name: str) -> DataFrame:
        df = running_totals(df, keys, order, {"_high": F.col(quantity), name: F.lit(1)}, width)
        df = df.select(*keys, name, (F.col("_high") - F.col(quantity)).cast("long").alias(f"{name}_low"), F.col("_high").cast("long").alias(f"{name}_high"))
        last = F.floor((F.col(f"{name}_high") - 1) / lot).cast("long")
        return df.where(F.col(f"{name}_high") > F.col(f"{name}_low")).withColumn("lot", F.explode(F.sequence(F.floor(F.col(f"{name}_low") / lot).cast("long"), last)))

    lot = lots * 64
    both = spans(takers, taker_order, "taker").join(spans(makers, maker_order, "maker"), [*keys, "lot"])
    low, high = F.greatest("taker_low", "maker_low", F.col("lot") * lot), F.least("taker_high", "maker_high", (F.col("lot") + 1) * lot)
    return both.withColumn("filled", high - low).where("filled > 0").groupBy(*keys, "taker", "maker").agg(F.sum("filled").alias("filled"))


def best_levels(levels: DataFrame, keys: list[str], side: str, price: str, quantity: str) -> DataFrame:
    """Best bid and ask of each book with the depth there; levels without quantity don't count."""
    at_price = levels.groupBy(*keys, side, price).agg(F.sum(F.greatest(F.lit(0), F.col(quantity))).alias("_q")).where("_q > 0")
    bid, ask = F.col(side) > 0, F.col(side) < 0
    return at_price.groupBy(*keys).agg(
        F.max(F.when(bid, F.col(price))).alias("best_bid"),
        F.min(F.when(ask, F.col(price))).alias("best_ask"),
        F.max_by(F.when(bid, F.col("_q")), F.when(bid, F.col(price))).alias("bid_depth"),
        F.min_by(F.when(ask, F.col("_q")), F.when(ask, F.col(price))).alias("ask_depth"),
    )


def positions(trades: DataFrame, buyer: str, seller: str, quantity: str, price: str) -> DataFrame:
    """Inventory, cash and number of trades of each owner: a trade counts for both its parties."""
    signed = F.explode(F.array(F.struct(F.col(buyer).alias("owner"), F.col(quantity).alias("q")), F.struct(F.col(seller).alias("owner"), (-F.col(quantity)).alias("q")))).alias("leg")
    legs = trades.select(signed, F.col(price).alias("p")).where("leg.owner is not null")
    return legs.groupBy("leg.owner").agg(F.sum("leg.q").alias("inventory"), F.sum(-F.col("leg.q") * F.col("p")).alias("cash"), F.count(F.lit(1)).alias("trades"))


def fixed_sum(x: Column, scale: int = 1_000_000) -> Column:
    """A sum that doesn't depend on the order of its terms: each is rounded to a fixed point first."""
    return F.sum(F.round(x * scale).cast("long")) / scale


def quote_ladder(states: DataFrame, keep: list[str], tick: int, target: Column, quantity: Column, levels: int, growth: int, most: int) -> DataFrame:
    """Quotes of a maker around best_bid, best_ask, last_trade and fundamental (null or 0: none), a row for each side and level.

    A spread two ticks wider than the target is bracketed around the last trade (or the middle) inside it, a narrower one joined; a missing
    side is rebuilt a tick around the last trade (or the side left); an empty book around the last trade or the fundamental.
    """
    bid, ask, last, fair = (F.coalesce(F.col(c), F.lit(0)) for c in ("best_bid", "best_ask", "last_trade", "fundamental"))
    wide = target * tick
    reference = F.when(last > 0, last.cast("double")).otherwise((bid + ask) / 2)
    preferred = F.round((reference - wide / 2) / tick).cast("long") * tick
    bracket = F.least(F.greatest(preferred, bid), ask - wide)
    both, recover = (bid > 0) & (ask > bid), F.when(last > 2 * tick, last.cast("double")).when(fair > 2 * tick, fair.cast("double"))
    centre = F.when(bid > 0, F.when(last > 0, last).otherwise(bid + tick)).when(ask > 0, F.when(last > 0, last).otherwise(ask - tick)).otherwise(F.round(recover / tick).cast("long") * tick)
    inside = ask - bid >= wide + 2 * tick
    primary_bid = F.when(both, F.when(inside, bracket).otherwise(bid)).otherwise(centre - tick)
    primary_ask = F.when(both, F.when(inside, bracket + wide).otherwise(ask)).otherwise(centre + tick)
    df = states.select(*keep, primary_bid.cast("long").alias("_bid"), primary_ask.cast("long").alias("_ask"), quantity.cast("long").alias("_q")).where("_bid > 0 and _ask > _bid")
    df = df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    price = F.when(F.col("side") > 0, F.col("_bid") - F.col("level") * tick).otherwise(F.col("_ask") + F.col("level") * tick)
    size = F.when(F.col("level") == 0, F.col("_q")).otherwise(F.least(F.lit(most), (F.col("_q") * F.pow(F.lit(growth), F.col("level"))).cast("long")))
    return df.select(*keep, "level", "side", price.alias("price"), size.alias("quantity"), F.col("_bid").alias("_floor")).where(F.col("_floor") - F.col("level") * tick > 0).drop("_floor")


def hedge_routes(books: DataFrame, book: str, weight: str, basket: int = 0) -> DataFrame:
    """Routes of a basket book to its components by weight (equal if all are 0), and of each component back to it with weight 1."""
    parts = books.where(F.col(book) != basket)
    total = parts.agg(F.coalesce(F.sum(weight), F.lit(0.0))).scalar()
    out = parts.select(F.lit(basket).cast("long").alias("source"), F.col(book).cast("long").alias("target"), F.when(total == 0, 1.0).otherwise(F.col(weight)).alias("weight"))
    return out.union(parts.select(F.col(book).cast("long"), F.lit(basket).cast("long"), F.lit(1.0)))


def intensity(events: DataFrame, at: DataFrame, keys: list[str], time: str, alpha: float, beta: float, mu: float, cutoff: float = 1e-6) -> DataFrame:
    """Intensity mu + sum of alpha exp(-beta (t - s)) over earlier events s, at each distinct time t; terms below the cutoff are left out.

    Decay sums are differences of running sums: in a bin of the time that a term lasts, with the events of the bin before it, events weigh
    exp(beta (s - the bin's start)), and a time t takes what lies between t less the bin's length and t. So the work is linear in the rows, and bursts cost no pairs.
    """
    reach = math.log(1 / cutoff) / beta
    bin_of = lambda c: F.floor(c / reach).cast("long")
    place = lambda b, pos, rank, n: F.struct(b.cast("long").alias("bin"), pos.cast("double").alias("pos"), F.lit(rank).alias("rank"), n.cast("long").alias("n"))
    t, none = F.col("_t"), F.lit(0)
    given = events.groupBy(*keys, F.col(time).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    given = given.select(*keys, F.lit(None).cast("double").alias("_t"), F.explode(F.array(place(bin_of(t), t, 2, F.col("_n")), place(bin_of(t) + 1, t, 2, F.col("_n")))).alias("p"))
    # Both stand before events of their time: what a time sees, and what is too old for it.
    asked = at.select(*keys, F.col(time).cast("double").alias("_t")).distinct()
    asked = asked.select(*keys, "_t", F.explode(F.array(place(bin_of(t), t, 1, none), place(bin_of(t), t - reach, 0, none))).alias("p"))
    both = given.unionByName(asked).select(*keys, "_t", "p.*")
    weight = F.col("n") * F.exp(beta * (F.col("pos") - F.col("bin") * reach))
    upto = F.sum(weight).over(Window.partitionBy(*keys, "bin").orderBy("pos", "rank").rowsBetween(Window.unboundedPreceding, 0))
    seen = both.withColumn("_upto", upto).where("rank < 2").groupBy(*keys, "bin", "_t").agg(F.max(F.when(F.col("rank") == 1, F.col("_upto"))).alias("_new"), F.max(F.when(F.col("rank") == 0, F.col("_upto"))).alias("_old"))
    value = mu + alpha * (F.col("_new") - F.col("_old")) * F.exp(-beta * (F.col("_t") - F.col("bin") * reach))
    return seen.select(*keys, F.col("_t").alias(time), value.alias("intensity"))


def lowest(df: DataFrame, key: Column, id_col: str, k: int, bits: int = 16) -> DataFrame:
    """The k rows with the smallest key (a long), ties by id, as a filter of df: no task takes k rows.

    Keys are counted by their highest bits, then by the next ones within the bin that holds rank k, until that bin is one key; ids decide among its rows the same way. Each count is
    one aggregation of at most 2^bits groups. A null key or id comes first.
    """
    n = df.count()
    if k >= n:
        return df
    if k <= 0:
        return df.limit(0)
    first, second = F.coalesce(key, F.lit(-(1 << 63))), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = df.withColumns({"_key": first, "_id": second})
    edge, before = _rank_edge(rows, F.col("_key"), k, bits)
    inside = rows.where(F.col("_key") == edge)
    last, under = _rank_edge(inside, F.col("_id"), k - before, bits)
    out = rows.where((F.col("_key") < edge) | ((F.col("_key") == edge) & (F.col("_id") < last)))
    # Rows that agree in key and id are one row many times.
    same = inside.where(F.col("_id") == last).limit(k - before - under)
    return out.unionByName(same).drop("_key", "_id")


def _rank_edge(rows: DataFrame, value: Column, k: int, bits: int) -> tuple[int, int]:
    """The value (a long) of the row of rank k (from 1), and how many rows lie below that value."""
    low, shift, before = -(1 << 63), 64, 0
    while shift > 0:
        step = min(bits, shift)
        shift -= step
        high = low + (1 << (shift + step)) - 1
        part = rows.where(value.between(F.lit(low), F.lit(high)))
        counts = sorted(part.groupBy(F.shiftright(value, shift).alias("bin")).count().collect())
        for bin_, n in counts:
            if before + n >= k:
                low = bin_ << shift
                break
            before += n
    return low, before


def seeded_top(df: DataFrame, key: Column, id_col: str, k: int) -> DataFrame:
    """The k rows with the smallest key, ties by id: a report of few rows. lowest() takes a share of a table."""
    return df.withColumn("_key", key).orderBy("_key", id_col).limit(k).drop("_key")


def slices(df: DataFrame, keys: list[str], order: list[str], wanted: Column, parent: int, out: str = "executed", width: int | None = None) -> DataFrame:
    """What each wanted slice gets while a parent quantity lasts."""
    rows = running_totals(df.withColumn("_wanted", wanted), keys, order, {"_upto": F.col("_wanted")}, width)
    return rows.withColumn(out, market.clamp(parent - F.col("_upto") + F.col("_wanted"), 0, F.col("_wanted"))).drop("_wanted", "_upto")


def distribution(df: DataFrame, keys: list[str], value: str, long: bool | None = None) -> DataFrame:
    """Empirical distribution: count, probability and cumulative probability of each value.

    Values are counted first; where a key (or all rows, without one) has too many distinct values for one task, running sums go over slices of them.
    """
    counts = df.groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    if long is None and has_long(df, keys):
        counts = keep(counts)
        long = has_long(counts, keys)
    if not long:
        group = Window.partitionBy(*keys)
        ranked = counts.withColumns({"_total": F.sum("count").over(group), "_upto": F.sum("count").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))})
    else:
        totals = counts.groupBy(*keys).agg(F.sum("count").alias("_total")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_total")
        upto = running_totals(counts, keys, ["value"], {"_upto": F.col("count")}, long=True)
        # Without keys the totals are one row; with them, AQE splits the partition of a long one.
        ranked = upto.join(totals, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]) if keys else upto.join(F.broadcast(totals))
    return ranked.select(*keys, "value", "count", (F.col("count") / F.col("_total")).alias("probability"), (F.col("_upto") / F.col("_total")).alias("cumulative_probability"))


def weighted_loss(simulated: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Loss of each candidate: weighted mean of squared relative errors over all targets; a moment it lacks counts as 0."""
    # Each candidate gets an array of all targets, which are as many as there are names of moments.
    listed = targets.limit(1001).collect()
    if len(listed) > 1000:
        raise ValueError("more than 1000 targets")
    each = F.array(*[F.struct(*[F.lit(r[c]).cast(kind).alias(c) for c, kind in targets.dtypes]) for r in listed])
    wanted = simulated.select(*keys).distinct().select(*keys, F.inline(each))
    joined = wanted.join(simulated, [*keys, "name"], "left")
    error = (F.coalesce("value", F.lit(0.0)) - F.col("target")) / F.greatest(F.abs("target"), F.col("scale_floor"), F.lit(1e-12))
    return joined.groupBy(*keys).agg((F.sum(F.col("weight") * error * error) / F.sum("weight")).alias("loss"), F.count_if(F.col("value").isNull()).alias("missing"))


def first_best(losses: DataFrame, id_col: str) -> DataFrame:
    """The row of the smallest loss, the lowest id on ties."""
    return losses.orderBy("loss", id_col).limit(1)


def stage_summary(df: DataFrame, stage: str, rank: str, seconds: str) -> DataFrame:
    """Minimum, mean, maximum and sum for each stage, and its slowest rank (the lowest on ties)."""
    s = F.col(seconds)
    return df.groupBy(stage).agg(F.min(s).alias("min_seconds"), F.avg(s).alias("mean_seconds"), F.max(s).alias("max_seconds"), F.sum(s).alias("sum_seconds"), F.max_by(F.col(rank), F.struct(s, -F.col(rank))).alias("slowest_rank"))
