"""Set-based matching with cancels against the book, order by order."""

import random
from collections import Counter

import pytest

from orderlens.functions import windows
from orderlens.operators import fifo
from orderlens.operators.book import CANCEL_AT, LIMIT, MARKET, Book

SCHEMA = "book_id long, t long, id long, action string, side int, price long, distance long, quantity long"


def played(rows):
    """Fills and what rests, by the book that applies one order after another. A cancel at a price is one at its distance from the best."""
    books, fills, rest = {}, Counter(), {}
    for b, _, i, action, side, price, distance, quantity in sorted(rows, key=lambda r: (r[1], r[2])):
        book = books.setdefault(b, Book(tick=1, seeded=False))
        if action == "add":
            book.apply(LIMIT, side, quantity, price, 0, i + 1, i + 1, 0)
        elif action == "take":
            book.apply(MARKET, -side, quantity, 0, 0, 0, -i - 1, 0)
        else:
            levels = book.bids if side > 0 else book.asks
            best = levels.best()
            if price is not None:
                distance = (best - price) * side if best else 0
            if distance >= 0 or price is None:
                book.apply(CANCEL_AT, side, quantity, 0, distance, 0, 0, 0)
        for t in book.trades:
            maker, taker = max(t[6], t[7]), -min(t[6], t[7])
            fills[b, taker - 1, maker - 1, t[2]] += t[3]
        book.trades.clear()
    for b, book in books.items():
        for levels in (book.bids, book.asks):
            for queue in levels.levels.values():
                for order in queue:
                    if order[1]:
                        rest[b, order[0] - 1] = order[1]
    return fills, rest


def flow_of(seed, n, books=2, absolute=0.5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        side = rng.choice([1, -1])
        action = rng.choices(["add", "take", "cancel"], [5, 3, 3])[0]
        level = rng.randrange(7)
        price = 100 - level if side > 0 else 101 + level
        at_price = action == "add" or action == "cancel" and rng.random() < absolute
        rows.append((rng.randrange(books), i // 3, i, action, side, price if at_price else None, rng.randrange(-1, 5) if action == "cancel" and not at_price else None, rng.choice([0, 1, 5, 20, 60, 200])))
    return rows


@pytest.mark.parametrize(("seed", "n", "limit"), [(1, 60, 2_000_000), (2, 300, 2_000_000), (3, 120, 15)])
def test_equals_the_book(spark, seed, n, limit, monkeypatch):
    monkeypatch.setattr(windows, "LONG", limit)
    rows = flow_of(seed, n)
    fills, became = fifo.match_with_cancels(spark.createDataFrame(rows, SCHEMA).repartition(3), ["book_id"], ["t", "id"], lot=16)
    want, rest = played(rows)
    got = Counter()
    for r in fills.collect():
        got[r["book_id"], r["taker"], r["maker"], r["price"]] += r["filled"]
    assert got == want
    told = became.collect()
    assert {(r["book_id"], r["id"]): r["resting"] for r in told if r["resting"]} == rest
    assert len(told) == sum(r[3] == "add" and r[7] > 0 for r in rows) and all(r["filled"] + r["cancelled"] + r["resting"] == r["quantity"] for r in told)


def test_hand_cases(spark):
    """A cancel takes from the back and never what was filled; orders behind it join where it left the back."""
    rows = [(1, 1, 1, "add", -1, 10, None, 5), (1, 2, 2, "add", -1, 10, None, 5), (1, 3, 3, "take", -1, None, None, 3), (1, 4, 4, "cancel", -1, 10, None, 6), (1, 5, 5, "add", -1, 10, None, 4), (1, 6, 6, "cancel", -1, None, 0, 1), (1, 7, 7, "take", -1, None, None, 9)]
    fills, became = fifo.match_with_cancels(spark.createDataFrame(rows, SCHEMA), ["book_id"], ["t", "id"])
    assert {(r["taker"], r["maker"]): r["filled"] for r in fills.collect()} == {(3, 1): 3, (7, 1): 1, (7, 5): 3}
    assert {r["id"]: (r["filled"], r["cancelled"], r["resting"]) for r in became.collect()} == {1: (4, 1, 0), 2: (0, 5, 0), 5: (3, 1, 0)}
    none = fifo.match_with_cancels(spark.createDataFrame(rows[2:4], SCHEMA), ["book_id"], ["t", "id"])
    assert none[0].count() == none[1].count() == 0


def test_settled_books_leave_the_passes(spark, monkeypatch):
    """A book with a chain of cancels on both sides among many that settle at once: the last passes read that book alone."""
    quiet = [(b, 3 * b + i, 3 * b + i, action, -1, 10, None, 5) for b in range(20) for i, action in enumerate(["add", "cancel"])]
    chain = [(1000 + b, *r[1:]) for b, r in ((r[0], r) for r in flow_of(2, 60, books=1, absolute=0.2))]
    rows = quiet + chain
    read, passes = fifo._at_levels, []

    def counted(events, *how):
        passes.append(events.select("book_id").distinct().count())
        return read(events, *how)

    monkeypatch.setattr(fifo, "_at_levels", counted)
    fills, became = fifo.match_with_cancels(spark.createDataFrame(rows, SCHEMA), ["book_id"], ["t", "id"], lot=16)
    assert len(passes) > 2 and passes[0] == 21 and passes[-1] == 1
    want, rest = played(rows)
    assert Counter({(r["book_id"], r["taker"], r["maker"], r["price"]): r["filled"] for r in fills.collect()}) == want
    assert {(r["book_id"], r["id"]): r["resting"] for r in became.collect() if r["resting"]} == rest
