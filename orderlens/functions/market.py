"""Scalar rules of books, flows and quotes, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX = 2**31 - 1
LONG_MAX = 2**63 - 1
EVENT_NAMES = ("limit_buy", "limit_sell", "market_buy", "market_sell", "cancel_bid", "cancel_ask")
#: Latency base and jitter in ns by kind of agent.
LATENCY_NS = {"market_maker": (5_000, 5_000), "informed": (20_000, 20_000), "momentum": (50_000, 50_000), "institutional": (100_000, 100_000), "background": (0, 0)}


def two_sided(bid: Column, ask: Column) -> Column:
    return F.coalesce((bid > 0) & (ask > bid), F.lit(False))


def mid(bid: Column, ask: Column) -> Column:
    """The middle, or null if a side is missing (null or 0)."""
    return F.when((bid > 0) & (ask > 0), (bid + ask) / 2)


def spread_ticks(bid: Column, ask: Column, tick: int) -> Column:
    return F.when(two_sided(bid, ask), (ask - bid) / tick)


def divided(a: Column, b: Column) -> Column:
    """a / b as doubles are divided, also in ANSI mode: by 0 infinite with the sign of a, NaN for 0 / 0; null if either is null."""
    by_zero = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).when(a.isNotNull(), F.lit(math.nan))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def spread_bps(bid: Column, ask: Column, fundamental: Column) -> Column:
    return F.when(two_sided(bid, ask), divided((ask - bid) * 10_000.0, fundamental))


def mispricing_ticks(signal: Column, mid_price: Column, tick: int) -> Column:
    return (signal - mid_price) / max(1, tick)


def mispricing_bps(mid_price: Column, fundamental: Column) -> Column:
    return 10_000.0 * (F.try_divide(mid_price, fundamental) - 1)


def sign_at(x: Column, threshold: float) -> Column:
    """1 above the threshold, -1 below its negative, else 0."""
    return F.when(x > threshold, 1).when(x < -threshold, -1).otherwise(0)


def imbalance(plus: Column, minus: Column) -> Column:
    return F.try_divide((plus - minus).cast("double"), (plus + minus).cast("double"))


def gated_imbalance(plus: Column, minus: Column, quantity: int) -> Column:
    """Imbalance of flows (each at least 0), null below max(1, quantity/2) in total."""
    plus, minus = F.greatest(F.lit(0), plus), F.greatest(F.lit(0), minus)
    return F.when(plus + minus >= max(1, quantity // 2), imbalance(plus, minus))


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """Null stays null; least and greatest alone would skip it."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def floor_to_tick(price: Column, tick: int) -> Column:
    return (price - price % tick).cast("long")


def ceil_to_tick(price: Column, tick: int) -> Column:
    up = price + (tick - 1)
    return (up - up % tick).cast("long")


def scaled_quantity(quantity: Column, scale: Column | float) -> Column:
    return F.greatest(F.lit(1), F.round(F.least(quantity * scale, F.lit(float(INT_MAX)))).cast("long"))


def owner_id(rank: Column, index: Column) -> Column:
    return rank * 1_000_000 + index + 1


def owner_rank(owner: Column) -> Column:
    return F.floor(owner / 1_000_000).cast("long")


def owner_index(owner: Column) -> Column:
    return (owner % 1_000_000 - 1).cast("long")


def add_time(a: Column, b: Column) -> Column:
    """Saturates at the largest time; the plain + raises instead."""
    return F.coalesce(F.try_add(a, b), F.lit(LONG_MAX))


def quote_scale(utilisation: Column) -> Column:
    return F.when(utilisation <= 0.5, 1.0).otherwise(F.greatest(F.lit(0.0), 2 * (1 - utilisation)))


def inventory_scale(inventory: Column, limit: Column) -> Column:
    return F.least(F.lit(0.75), F.abs(inventory) / F.greatest(F.lit(1), limit))


def inventory_scales(inventory: Column, limit: Column) -> tuple[Column, Column]:
    """Factors of bid and ask quantities: the side that adds to the inventory shrinks, the other grows."""
    x = inventory_scale(inventory, limit)
    return F.when(inventory > 0, 1 - x).otherwise(1 + x), F.when(inventory < 0, 1 - x).otherwise(1 + x)


def notional(price: Column, quantity: Column) -> Column:
    """Raises where the product leaves 64 bits (in ANSI mode)."""
    return price.cast("long") * quantity.cast("long")


def event_name(code: Column) -> Column:
    """The name of an event's code, or null."""
    return F.get(F.array(*[F.lit(n) for n in EVENT_NAMES]), code)


# Names of timed stages, by code.
STAGE_NAMES = (
    "initialization", "start_barrier", "hawkes_generation", "market_state_build", "broadcast_market_state", "agent_observe_and_generate", "gather_order_counts", "gather_order_payload",
    "queue_partition", "event_sort", "matching_engine", "report_packing", "scatter_report_counts", "scatter_report_payload", "apply_reports", "end_barrier", "total_wall",
)


def stage_name(code: Column) -> Column:
    """The name of a timed stage's code; "unknown" for any other."""
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in STAGE_NAMES]), code), F.lit("unknown"))


def checked_later(time: Column, delay: Column) -> Column:
    """time + delay; raises for a negative delay or a sum beyond 64 bits, where the saturating form stops at the largest time."""
    fault = F.raise_error(F.concat(F.lit("time out of range: "), time.cast("string"), F.lit(" + "), delay.cast("string")))
    return F.when((delay < 0) | (time > F.lit((1 << 63) - 1) - F.greatest(delay, F.lit(0))), fault.cast("long")).otherwise(F.try_add(time, delay))


def seconds_to_ns(seconds: Column) -> Column:
    """Rounded half away from zero; raises where it leaves 64 bits (in ANSI mode)."""
    return F.round(seconds * 1e9).cast("long")


def shock_size(depth: Column, multiple: float, fixed: int | None = None) -> Column:
    """A fixed quantity, or a multiple of the depth, at least 1."""
    return F.lit(fixed).cast("long") if fixed is not None else scaled_quantity(depth.cast("double"), multiple)


def passes(x: Column, threshold: float, inclusive: bool) -> Column:
    """Whether |x| is over the threshold, or on it where that counts."""
    return F.abs(x) >= threshold if inclusive else F.abs(x) > threshold


def rank_sequence(rank: Column, counter: Column) -> Column:
    """A sequence number that no other rank has: the rank in the top byte."""
    return F.shiftleft(rank.cast("long"), 56).bitwiseOR(counter.cast("long"))


def owner_sequence(owner: Column, counter: Column) -> Column:
    return F.shiftleft(owner.cast("long"), 32).bitwiseOR(counter.cast("long"))


def inventory_skew(inventory: Column, quantity: int, most: int = 3) -> Column:
    return clamp(F.round(0.25 * inventory / max(1, quantity)), -most, most).cast("int")


def latency_ns(kind: Column, uniform: Column) -> Column:
    out = F.lit(None).cast("long")
    for name, (base, jitter) in LATENCY_NS.items():
        out = F.when(kind == name, (base + F.floor(uniform * jitter)).cast("long")).otherwise(out)
    return out


def role(is_exchange: Column, is_agent: Column) -> Column:
    return F.when(is_exchange & is_agent, "exchange+agents").when(is_exchange, "exchange").when(is_agent, "agents").otherwise("idle")


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def value_order_quantity(bps: Column, threshold: float, step: float, base: int, most: int, capacity: Column) -> Column:
    """Signed quantity of a value trader: buys below the fundamental, more the further off; none within the threshold (equality included)."""
    excess = F.abs(bps) - threshold
    asked = F.least(F.lit(most), base * (1 + F.floor(excess / step)))
    return F.when(excess <= 0, F.lit(0)).otherwise(-F.signum(bps) * F.greatest(F.lit(0), F.least(asked, capacity))).cast("long")


def informed_quantity(ticks: Column, threshold: float, base: int, uniform: Column) -> Column:
    strength = F.least(F.lit(3.0), F.abs(ticks) / max(1e-9, threshold))
    size = F.greatest(F.lit(1), F.round(base * (0.5 + 0.5 * strength) * (0.75 + 0.5 * uniform)))
    return F.when(F.abs(ticks) > threshold, F.signum(ticks) * size).otherwise(0).cast("long")


def momentum_direction(mid_signal: Column, flow_signal: Column, depth_signal: Column) -> Column:
    """The mid decides unless the flow contradicts it; then flow, then depth."""
    return F.when((mid_signal != 0) & (flow_signal != 0) & (mid_signal != flow_signal), 0).when(mid_signal != 0, mid_signal).when(flow_signal != 0, flow_signal).otherwise(depth_signal)


def momentum_quantity(mid_signal: Column, flow_signal: Column, depth_signal: Column, quantity: int) -> Column:
    """Signed; half if depth alone speaks."""
    size = F.when((mid_signal == 0) & (flow_signal == 0), max(1, quantity // 2)).otherwise(quantity)
    return momentum_direction(mid_signal, flow_signal, depth_signal) * size


def canonical(name: Column, aliases: dict[str, str]) -> Column:
    """Trimmed, lower-cased and put for its alias; names without one stay, those whose alias is empty become null."""
    low = F.lower(F.trim(name))
    out = low
    for alias, known in aliases.items():
        out = F.when(low == alias, F.lit(known) if known else F.lit(None).cast("string")).otherwise(out)
    return out
