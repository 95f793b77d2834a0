"""The order book: price-time priority as a kernel for one book at a time, run for all books by their key."""

from __future__ import annotations

import heapq
import struct
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

LIMIT, MARKET, CANCEL_OWNER, CANCEL_AT = 0, 1, 2, 3
# The opening book, price to quantity.
OPENING_BIDS = {2203400: 1623, 2203300: 1723, 2203200: 2100, 2203100: 1100, 2203000: 1200, 2202900: 200, 2202800: 564, 2202600: 500, 2202500: 700, 2202400: 200}
OPENING_ASKS = {2203700: 823, 2203800: 823, 2203900: 1823, 2204000: 1923, 2204100: 1923, 2204200: 1223, 2204300: 823, 2204400: 200, 2204500: 823, 2204600: 823}
TICK = 100


class Side:
    """One side's levels: a queue of [owner, quantity, sequence] for each price, and a heap of prices, best first."""

    def __init__(self, sign: int):
        self.sign, self.levels, self.heap, self.depth = sign, {}, [], {}

    def add(self, price: int, owner: int, quantity: int, sequence: int) -> list:
        if price not in self.levels:
            self.levels[price] = deque()
            self.depth[price] = 0
            heapq.heappush(self.heap, -self.sign * price)
        order = [owner, quantity, sequence, price]
        self.levels[price].append(order)
        self.depth[price] += quantity
        return order

    def best(self) -> int:
        """0 if there is none. Levels that ran dry are dropped here."""
        while self.heap:
            price = -self.sign * self.heap[0]
            if self.depth.get(price):
                return price
            heapq.heappop(self.heap)
            self.levels.pop(price, None)
            self.depth.pop(price, None)
        return 0


class Book:
    """Orders of owner 0 are background flow: they are matched like others, never reported, and no owner cancel takes them."""

    def __init__(self, tick: int = TICK, seeded: bool = True, depth_scale: float = 1.0):
        self.tick, self.bids, self.asks = tick, Side(1), Side(-1)
        self.last_trade = self.bought = self.sold = self.n_trades = 0
        self.owned: dict[int, list] = {}
        self.trades: list[tuple] = []
        for side, levels in ((self.bids, OPENING_BIDS), (self.asks, OPENING_ASKS)) if seeded else ():
            for price, quantity in levels.items():
                side.add(price, 0, max(1, int(quantity * depth_scale + 0.5)), 0)

    def state(self) -> dict:
        bid, ask = self.bids.best(), self.asks.best()
        return {
            "best_bid": bid, "best_ask": ask, "bid_depth": self.bids.depth.get(bid, 0), "ask_depth": self.asks.depth.get(ask, 0),
            "last_trade": self.last_trade, "mid": (bid + ask) / 2 if bid and ask else 0.0, "bought": self.bought, "sold": self.sold,
        }

    def touched(self, action: int, side: int) -> int:
        """The best price that an order of this kind can take away: the other side's for a market order, its own side's for a cancel at a distance, else none."""
        if action == MARKET:
            return (self.asks if side > 0 else self.bids).best()
        return (self.bids if side > 0 else self.asks).best() if action == CANCEL_AT else 0

    def sweep(self, side: int, quantity: int, owner: int, sequence: int, time: int, limit: int | None) -> int:
        """Match an aggressor against the other side, best price first and oldest order first."""
        other, left = (self.asks if side > 0 else self.bids), quantity
        while left and (price := other.best()):
            if limit is not None and (price - limit) * side > 0:
                break
            queue = other.levels[price]
            while left and queue:
                maker = queue[0]
                filled = min(left, maker[1])
                maker[1] -= filled
                left -= filled
                other.depth[price] -= filled
                self.last_trade = price
                self.n_trades += 1
                buyer, seller = (owner, maker[0]) if side > 0 else (maker[0], owner)
                self.trades.append((time, self.n_trades, price, filled, buyer, seller, sequence if side > 0 else maker[2], maker[2] if side > 0 else sequence, side))
                if not maker[1]:
                    queue.popleft()
        return quantity - left

    def apply(self, action: int, side: int, quantity: int, price: int, distance: int, owner: int, sequence: int, time: int) -> tuple[int, int, int]:
        """Executed, resting and cancelled quantity."""
        if action == CANCEL_OWNER:
            return 0, 0, self.cancel_owner(owner)
        if quantity <= 0:
            return 0, 0, 0
        if action == CANCEL_AT:
            return 0, 0, self.cancel_at(side, distance, quantity)
        if action == LIMIT and price <= 0:
            return 0, 0, 0
        done = self.sweep(side, quantity, owner, sequence, time, price if action == LIMIT else None)
        if side > 0:
            self.bought += done
        else:
            self.sold += done
        rest = quantity - done if action == LIMIT else 0
        if rest:
            order = (self.bids if side > 0 else self.asks).add(price, owner, rest, sequence)
            if owner > 0:
                self.owned.setdefault(owner, []).append((order, side))
        return done, rest, 0

    def cancel_owner(self, owner: int) -> int:
        gone = 0
        for order, side in self.owned.pop(owner, []) if owner > 0 else ():
            book = self.bids if side > 0 else self.asks
            queue = book.levels.get(order[3])
            if order[1] and queue is not None:
                gone += order[1]
                book.depth[order[3]] -= order[1]
                order[1] = 0
                book.levels[order[3]] = deque(o for o in queue if o[1])
        return gone

    def cancel_at(self, side: int, distance: int, quantity: int) -> int:
        """From the back of the queue at a distance in ticks from the best price."""
        book = self.bids if side > 0 else self.asks
        best = book.best()
        price = best - side * max(0, distance) * self.tick
        queue, left = book.levels.get(price) if best else None, quantity
        while queue and left:
            taken = min(left, queue[-1][1])
            queue[-1][1] -= taken
            book.depth[price] -= taken
            left -= taken
            if not queue[-1][1]:
                queue.pop()
        return quantity - left


STATE = "best_bid long, best_ask long, bid_depth long, ask_depth long, last_trade long, mid double, bought long, sold long"
TRADE_SCHEMA = "book_id long, time_ns long, trade_sequence long, price long, quantity long, buyer long, seller long, buyer_sequence long, seller_sequence long, aggressor_side int"
DONE_SCHEMA = f"book_id long, sequence long, arrival_ns long, owner long, agent_kind int, action int, side int, requested long, executed long, resting long, cancelled long, best_removed boolean, {STATE}"
INSTITUTIONAL = 4


def action_priority(action):
    """Of orders pending at one time, cancels of an owner come before limits, these before markets, these before cancels at a distance."""
    return F.when(action == CANCEL_OWNER, 0).when(action == LIMIT, 1).when(action == MARKET, 2).otherwise(3)


def pending_order(with_book: bool = False) -> list:
    """The total order of pending orders as sort columns: arrival, action, book if several share a queue, kind of agent, sequence, tie-breaker."""
    return [F.col("arrival_ns"), action_priority(F.col("action")), *([F.col("book_id")] if with_book else []), F.col("agent_kind"), F.col("sequence"), F.col("tie_breaker")]


def pending_positions(orders: DataFrame, keys: list[str], with_book: bool = False, width: float | None = None) -> DataFrame:
    """orders with their place in the queue of each key (from 1), by pending_order()."""
    from ..functions.windows import row_numbers

    names = [f"_p{i}" for i in range(len(pending_order(with_book)))]
    ranked = orders.withColumns(dict(zip(names, pending_order(with_book))))
    return row_numbers(ranked, keys, names, "position", width).drop(*names)


def in_order(rows: list[tuple]) -> list[tuple]:
    """Orders (generated, owner, action, sequence, tie, rank, ...) of one arrival time in the order in which they apply.

    What an owner generated at one time stays together, its cancel of all before the rest, then by sequence; such batches and orders of no owner
    follow each other by their smallest tie-breaker, then source rank and sequence. Unlike a comparison by pairs, this has no cycles.
    """
    if len(rows) < 2:
        return rows
    batches: dict[tuple, list[tuple]] = {}
    for r in rows:
        batches.setdefault((r[1], r[0]) if r[1] > 0 else (0, r[3], r[4], r[5]), []).append(r)
    for batch in batches.values():
        batch.sort(key=lambda r: (r[2] != CANCEL_OWNER, r[3], r[4], r[5]))
    first = sorted(batches.values(), key=lambda b: min((r[4], r[5], r[3]) for r in b))
    return [r for batch in first for r in batch]


def run_books(orders: DataFrame, seeded: bool = True, depth_scale: float = 1.0) -> DataFrame:
    """One pass over all books: a row for each order (what it did, the top of the book after it), with its trades.

    Orders need book_id, arrival_ns, action, side, quantity, price, distance, owner and sequence; generated_ns, tie_breaker, source_rank and
    agent_kind count where they are there. Rows stream: a task holds one book, one batch and the orders of one arrival time.
    """
    optional = {"generated_ns": F.col("arrival_ns"), "tie_breaker": F.col("sequence"), "source_rank": F.lit(0), "agent_kind": F.lit(0)}
    columns = ["book_id", "arrival_ns", "generated_ns", "owner", "action", "sequence", "tie_breaker", "source_rank", "agent_kind", "side", "quantity", "price", "distance"]
    names = [c.split()[0] for c in DONE_SCHEMA.split(", ")]
    trade = [c.split() for c in TRADE_SCHEMA.split(", ")[1:]]
    schema = f"{DONE_SCHEMA}, trades array<struct<{', '.join(f'{n}: {k}' for n, k in trade)}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, book, instant, waiting = None, None, None, []
        out: list[tuple] = []
        told: list[list[dict]] = []

        def settle() -> None:
            for _, owner, action, sequence, _, _, kind, side, quantity, price, distance in in_order(waiting):
                before = book.touched(action, side)
                done = book.apply(action, side, quantity, price, distance, owner, sequence, instant)
                removed = before > 0 and book.touched(action, side) != before and (action == CANCEL_AT or done[0] > 0)
                told.append([dict(zip((n for n, _ in trade), t)) for t in book.trades])
                book.trades.clear()
                out.append((current, sequence, instant, owner, kind, action, side, quantity, *done, removed, *book.state().values()))
            waiting.clear()

        def batch_of() -> pa.RecordBatch:
            table = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] + [pa.array(told, pa.list_(pa.struct([(n, pa.int32() if k == "int" else pa.int64()) for n, k in trade])))], [*names, "trades"])
            out.clear(), told.clear()
            return table.cast(wanted)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if row[0] != current or row[1] != instant:
                    settle()
                    if row[0] != current:
                        current, book = row[0], Book(seeded=seeded, depth_scale=depth_scale)
                    instant = row[1]
                waiting.append(row[2:])
            if out:
                yield batch_of()
        settle()
        if out:
            yield batch_of()

    wanted = to_arrow_schema(StructType.fromDDL(schema))
    given = [F.coalesce(F.col(c), optional[c]) if c in optional and c in orders.columns else optional.get(c, F.col(c)) for c in columns]
    ordered = orders.select(*[g.cast("long").alias(c) for g, c in zip(given, columns)]).repartition("book_id").sortWithinPartitions("book_id", "arrival_ns")
    return ordered.mapInArrow(run, schema)


def match_orders(orders: DataFrame, seeded: bool = True, depth_scale: float = 1.0) -> DataFrame:
    """Each order with what it did and the top of the book after it."""
    return run_books(orders, seeded, depth_scale).drop("trades")


def trades_of(done: DataFrame) -> DataFrame:
    """The trades of orders that run_books() applied."""
    return done.select("book_id", F.explode("trades").alias("t")).select("book_id", "t.*")


def match_trades(orders: DataFrame, seeded: bool = True, depth_scale: float = 1.0) -> DataFrame:
    """The trades of all books."""
    return trades_of(run_books(orders, seeded, depth_scale))


def reports(trades: DataFrame) -> DataFrame:
    """Fills as each owner sees them: two rows for a trade, none for background flow."""
    legs = F.explode(F.array(F.struct(F.col("buyer").alias("owner"), F.col("buyer_sequence").alias("sequence"), F.lit(1).alias("side")), F.struct(F.col("seller").alias("owner"), F.col("seller_sequence").alias("sequence"), F.lit(-1).alias("side"))))
    return trades.select("book_id", "time_ns", legs.alias("leg"), F.col("quantity").alias("fill_quantity"), F.col("price").alias("fill_price")).where("leg.owner > 0 and fill_quantity > 0").select("book_id", "time_ns", "leg.*", "fill_quantity", "fill_price")


def routed_reports(done: DataFrame) -> DataFrame:
    """All reports of orders that run_books() applied: fills of both owners, and the result of each institutional order; columns that a kind lacks are null."""
    fills = reports(trades_of(done)).withColumn("kind", F.lit("FILL"))
    results = done.where((F.col("owner") > 0) & (F.col("agent_kind") == INSTITUTIONAL)).select("book_id", F.col("arrival_ns").alias("time_ns"), "owner", "sequence", "side", F.lit("ORDER_RESULT").alias("kind"), "action", "requested", "executed", "resting", "cancelled")
    return fills.unionByName(results, allowMissingColumns=True)


BASIS, PRIME = 14695981039346656037, 1099511628211


def fnv(state: int, data: bytes) -> int:
    """FNV-1a, carried on from a state."""
    for byte in data:
        state = (state ^ byte) * PRIME & 0xFFFFFFFFFFFFFFFF
    return state


def record_bytes(values) -> bytes:
    """Big-endian: whole numbers as 64 bits, others by their bit pattern as doubles."""
    return b"".join(struct.pack(">d", v) if isinstance(v, float) else int(v).to_bytes(8, "big", signed=True) for v in values)


def ordered_hash(rows: DataFrame, key: str, order: list[str], columns: list[str], n: str, out: str) -> DataFrame:
    """For each key the hash of its rows' columns in order, and how many there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, seen = None, BASIS, 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row[0] != current:
                    if current is not None:
                        yield pd.DataFrame({key: [current], n: [seen], out: [f"{state:016x}"]})
                    current, state, seen = row[0], BASIS, 0
                state, seen = fnv(state, record_bytes(row[1:])), seen + 1
        if current is not None:
            yield pd.DataFrame({key: [current], n: [seen], out: [f"{state:016x}"]})

    sorted_ = rows.repartition(key).sortWithinPartitions(key, *order)
    return sorted_.select(F.col(key).alias("_key"), *columns).mapInPandas(run, f"{key} long, {n} long, {out} string")


def tape_hash(trades: DataFrame) -> DataFrame:
    """For each book the FNV-1a hash of its tape, in the order of its trades, and how many there are."""
    columns = [c.split()[0] for c in TRADE_SCHEMA.split(", ")]
    return ordered_hash(trades, "book_id", ["time_ns", "trade_sequence"], columns, "trades", "tape_hash")
