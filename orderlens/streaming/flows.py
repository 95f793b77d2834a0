"""Streaming twins: tumbling flow, late and future messages, and books with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.book import LIMIT, MARKET, STATE, Book
from .timers import MESSAGE, MESSAGE_STRUCT, MILLION, due_order, rows_of, wake_at


def event_time(df: DataFrame, time_ns: str, delay: str) -> DataFrame:
    """Event time from nanoseconds, and a watermark. A delay not below the largest latency drops nothing; time 0 counts as a microsecond, as a new stream's watermark stands at 0."""
    return df.withColumn("event_time", F.timestamp_micros(F.greatest(F.lit(1), F.floor(F.col(time_ns) / 1000)).cast("long"))).withWatermark("event_time", delay)


def tumbling_flow(orders: DataFrame, length: str) -> DataFrame:
    """Orders, bought and sold quantity of each book in each window [start, end); works on a batch as well."""
    bought = F.sum(F.when(F.col("side") > 0, F.col("quantity")).otherwise(0))
    sold = F.sum(F.when(F.col("side") < 0, F.col("quantity")).otherwise(0))
    out = orders.groupBy("book_id", F.window("event_time", length)).agg(F.count(F.lit(1)).alias("orders"), bought.alias("bought"), sold.alias("sold"))
    return out.select("book_id", "window.start", "window.end", "orders", "bought", "sold")


def split_due(messages: DataFrame, arrival: str, window_end: int) -> tuple[DataFrame, DataFrame]:
    """What arrives before a window's end, and what waits (an arrival at the end waits)."""
    return messages.where(F.col(arrival) < window_end), messages.where(F.col(arrival) >= window_end)


def clamp_late(messages: DataFrame, arrival: str, window_start: int) -> DataFrame:
    """What arrived before the window starts counts at its start."""
    return messages.withColumn(arrival, F.greatest(F.col(arrival), F.lit(window_start)))


def run_for(query: StreamingQuery, seconds: float) -> str:
    """Let a query run up to a wall-clock limit and stop it there; how it ended: completed, limit or failed."""
    try:
        done = query.awaitTermination(seconds)
    except StreamingQueryException:
        return "failed"
    if not done:
        query.stop()
    return "completed" if done else "limit"


def batch_horizon(horizons: dict[str, float], kinds: list[str]) -> str:
    """The trigger interval of a stream that serves several kinds of agents: the shortest of theirs."""
    return f"{max(0, int(1000 * min(horizons[k] for k in kinds)))} milliseconds"


RESTING = "array<struct<price:long,owner:long,quantity:long,sequence:long>>"
STATE_SCHEMA = f"bids {RESTING}, asks {RESTING}, last_trade long, bought long, sold long, pending array<{MESSAGE_STRUCT}>"


def _load(book: Book, saved: tuple) -> None:
    for side, orders, sign in ((book.bids, saved[0], 1), (book.asks, saved[1], -1)):
        for o in orders:
            order = side.add(o["price"], o["owner"], o["quantity"], o["sequence"])
            if o["owner"] > 0:
                book.owned.setdefault(o["owner"], []).append((order, sign))
    book.last_trade, book.bought, book.sold = saved[2:5]


def _save(book: Book) -> tuple:
    sides = [[{"price": p, "owner": o[0], "quantity": o[1], "sequence": o[2]} for p, queue in side.levels.items() for o in queue if o[1]] for side in (book.bids, book.asks)]
    return sides[0], sides[1], book.last_trade, book.bought, book.sold


def stateful_books(orders: DataFrame, seeded: bool = True) -> DataFrame:
    """Top of the book of each book after the orders that a micro-batch makes due; resting orders and waiting ones are the state.

    With a watermark on the stream, orders wait until event time has passed them and apply in the order of the batch kernel (one key for both), so micro-batches
    don't show in the result; an order later than the watermark applies when it comes. Without a watermark each micro-batch applies its own orders in that order.
    """
    columns = [f.split()[0] for f in MESSAGE.split(", ")]
    default = {"generated_ns": F.col("arrival_ns"), "tie_breaker": F.col("sequence"), "source_rank": F.lit(0), "agent_kind": F.lit(0)}
    timed = "event_time" in orders.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = Book(seeded=seeded and not state.exists)
        waiting = []
        if state.exists:
            _load(book, state.get)
            waiting = [tuple(m[c] for c in columns) for m in state.get[5]]
        if not state.hasTimedOut:
            waiting += [tuple(int(x) for x in r) for r in rows_of(batches, columns)]
        due, waiting = due_order(waiting, state.getCurrentWatermarkMs() * MILLION if timed else 1 << 62)
        for at, _, owner, action, sequence, _, _, _, side, quantity, price, distance in due:
            book.apply(action, side, quantity, price, distance, owner, sequence, at)
        book.trades.clear()
        state.update((*_save(book), [dict(zip(columns, w)) for w in waiting]))
        if timed and waiting:
            wake_at(state, min(w[0] for w in waiting) + MILLION)
        if due:
            yield pd.DataFrame([{"book_id": key[0], "arrival_ns": due[-1][0]} | book.state()])

    given = [F.coalesce(F.col(c), default[c]) if c in default and c in orders.columns else default.get(c, F.col(c)) for c in columns]
    rows = orders.select("book_id", *(["event_time"] if timed else []), *[g.cast("long").alias(c) for g, c in zip(given, columns)])
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy("book_id").applyInPandasWithState(step, f"book_id long, arrival_ns long, {STATE}", STATE_SCHEMA, "append", timeout)


def dual_clock_flow(orders: DataFrame, decision: str, refresh: str) -> tuple[DataFrame, DataFrame]:
    """The same flow on two clocks: windows of decisions, and the shorter ones of refreshes."""
    return tumbling_flow(orders, decision), tumbling_flow(orders, refresh)


__all__ = ["LIMIT", "MARKET", "batch_horizon", "clamp_late", "dual_clock_flow", "event_time", "run_for", "split_due", "stateful_books", "tumbling_flow"]
