"""Keyed streams with memory and timers: messages held until they are due, states sampled on a clock, looked back at for a while, and checked for order.

Each keeps its state per key and asks to be woken when event time (the watermark) reaches the next moment at which it has something to do.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.book import in_order

MILLION = 1_000_000
#: What a message carries; the first six are its place in the order of one arrival time.
PLACE = ["generated_ns", "owner", "action", "sequence", "tie_breaker", "source_rank"]
ORDER = ["agent_kind", "side", "quantity", "price", "distance"]
MESSAGE = f"arrival_ns long, {', '.join(f'{c} long' for c in [*PLACE, *ORDER])}"
MESSAGE_STRUCT = f"struct<{', '.join(f'{f.split()[0]}: long' for f in MESSAGE.split(', '))}>"


def rows_of(batches: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    return [tuple(r) for batch in batches for r in batch[columns].itertuples(index=False)]


def wake_at(state: GroupState, time_ns: int | None) -> None:
    """A timer has to lie behind the watermark, in milliseconds."""
    if time_ns is not None:
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, -(-time_ns // MILLION)))


def due_order(pending: list[tuple], until_ns: int) -> tuple[list[tuple], list[tuple]]:
    """Of (arrival, place..., order...) rows those that arrive before a time, in the order in which they apply, and the rest."""
    due, later = [p for p in pending if p[0] < until_ns], [p for p in pending if p[0] >= until_ns]
    by_time: dict[int, list[tuple]] = {}
    for p in due:
        by_time.setdefault(p[0], []).append(p[1:])
    return [(at, *p) for at in sorted(by_time) for p in in_order(by_time[at])], later


def hold_until_due(messages: DataFrame, window_ns: int) -> DataFrame:
    """Messages (book_id and MESSAGE, with a watermark) released window by window as event time passes, in the order of books: a message of the future stays in the state.

    None is dropped: one that comes after its window was released counts at the start of the next one (column late). A micro-batch's size doesn't
    show in what is released, only when.
    """
    columns = [f.split()[0] for f in MESSAGE.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, horizon = state.get if state.exists else ([], -(1 << 62))
        pending = [tuple(m[c] for c in columns) for m in held]
        late: set[int] = set()
        for row in [] if state.hasTimedOut else rows_of(batches, columns):
            row = tuple(int(x) for x in row)
            if row[0] < horizon:
                late.add(row[4])
                row = (horizon, *row[1:])
            pending.append(row)
        mark = state.getCurrentWatermarkMs() * MILLION
        end = mark - mark % window_ns if mark > 0 else horizon
        due, pending = due_order(pending, max(end, horizon))
        state.update(([dict(zip(columns, p)) for p in pending], max(end, horizon)))
        if pending:
            first = min(p[0] for p in pending)
            wake_at(state, first - first % window_ns + window_ns)
        if due:
            yield pd.DataFrame([(key[0], *d, d[4] in late) for d in due], columns=["book_id", *columns, "late"])

    return messages.groupBy("book_id").applyInPandasWithState(step, f"book_id long, {MESSAGE}, late boolean", f"pending array<{MESSAGE_STRUCT}>, horizon long", "append", GroupStateTimeout.EventTimeTimeout)


def sampled(states: DataFrame, interval_ns: int, value: str) -> DataFrame:
    """The last value of each key (book_id, time_ns and the value) at every multiple of an interval that event time has passed; the clock goes on by itself where no rows come."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values, next_at = state.get if state.exists else ([], [], None)
        seen = sorted([*zip(times, values), *([] if state.hasTimedOut else ((int(t), float(v)) for t, v in rows_of(batches, ["time_ns", value])))])
        if next_at is None and seen:
            next_at = -(-seen[0][0] // interval_ns) * interval_ns
        mark, out, i = state.getCurrentWatermarkMs() * MILLION, [], 0
        while next_at is not None and next_at < mark:
            i = bisect_right(seen, (next_at, float("inf"))) - 1
            if i >= 0:
                out.append((key[0], next_at, seen[i][1]))
            next_at += interval_ns
        # The last row before the next sample, and all after it, are needed still.
        seen = seen[max(0, bisect_right(seen, (next_at - interval_ns, float("inf"))) - 1) :] if seen else seen
        state.update(([t for t, _ in seen], [v for _, v in seen], next_at))
        wake_at(state, next_at)
        if out:
            yield pd.DataFrame(out, columns=["book_id", "time_ns", value])

    return states.groupBy("book_id").applyInPandasWithState(step, f"book_id long, time_ns long, {value} double", "times array<long>, held array<double>, next_at long", "append", GroupStateTimeout.EventTimeTimeout)


def looked_back(states: DataFrame, lookback_ns: int, retention_ns: int, value: str) -> DataFrame:
    """Each row (book_id, time_ns and the value) with the value a lookback before, if one that old is retained; what is older than the retention is forgotten."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values = map(list, state.get) if state.exists else ([], [])
        out = []
        for t, v in sorted((int(t), float(v)) for t, v in rows_of(batches, ["time_ns", value])):
            times.append(t), values.append(v)
            first = bisect_right(times, t - retention_ns - 1)
            del times[:first], values[:first]
            at = bisect_right(times, t - lookback_ns) - 1
            out.append((key[0], t, v, values[at] if at >= 0 else None))
        state.update((times, values))
        yield pd.DataFrame(out, columns=["book_id", "time_ns", value, "past"])

    return states.groupBy("book_id").applyInPandasWithState(step, f"book_id long, time_ns long, {value} double, past double", "times array<long>, held array<double>", "append", GroupStateTimeout.NoTimeout)


def out_of_order(events: DataFrame, key_column: str) -> DataFrame:
    """Events (book_id, key) whose key isn't above all before it, with the largest until then: a guard of exactly-once order over micro-batches.

    Inside a micro-batch rows have no order once they were shuffled, so they count by key: repeats show, and keys that earlier batches have passed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        largest, out = state.get[0] if state.exists else None, []
        for (k,) in sorted(rows_of(batches, [key_column])):
            if largest is not None and k <= largest:
                out.append((key[0], int(k), largest))
            else:
                largest = int(k)
        state.update((largest,))
        if out:
            yield pd.DataFrame(out, columns=["book_id", key_column, "largest"])

    return events.groupBy("book_id").applyInPandasWithState(step, f"book_id long, {key_column} long, largest long", "largest long", "append", GroupStateTimeout.NoTimeout)
