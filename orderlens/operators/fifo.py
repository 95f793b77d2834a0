"""Price-time matching with cancels as relational plans: no row-by-row book, for flows whose limits rest (cross nothing).

One side of a book is a row of price levels, best first. A sweep takes from the best levels first, so what it takes from any prefix of levels depends on the prefix's total quantity alone, and that total is a
running sum that is held at 0: its sum so far less the least sum so far. Levels are halved again and again: in each round every order's demand is split, by one window, into what the better half
of its node gives and what is left for the other half. After log2(levels) rounds demands stand at single levels.

In a level the places of a queue are coordinates. An order joins at the back (all quantity added less all cancelled before it), sweeps move the front, and an anonymous cancel moves
the back towards the front, so that an order keeps the places below the lowest back that comes after it. Fills are overlaps of sweeps' places and orders' kept places.

What a cancel can take depends on its level's quantity, and, if it names a distance, on the best level of its time. Both are guessed and corrected until they stay: with right guesses before a time, what follows
from them there is right, so each pass settles the earliest wrong one at least, mostly all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kept import keep
from ..functions.windows import carried, extreme_of, has_long, row_numbers, running_totals

#: A probe looks before its own cancel acts.
PROBE, ADD, TAKE, CANCEL = 0, 1, 2, 3


def _held_at_zero(rows: DataFrame, keys: list[str], delta: Column, long: bool) -> DataFrame:
    """rows with _before and _after: the quantity around each row, that steps by delta and never falls below 0."""
    rows = running_totals(rows.withColumn("_delta", delta), keys, ["_seq", "_kind"], {"_sum": F.col("_delta")}, long=long)
    rows = carried(rows, keys, ["_seq", "_kind"], {"_least": extreme_of(F.col("_sum"), False)}, long=long)
    after = F.col("_sum") - F.least(F.lit(0), F.col("_least"))
    # A row's own step, undone where it was cut: the quantity before is what the sum without it gives, with the least sum before it.
    earlier = Window.partitionBy(*keys).orderBy("_seq", "_kind")
    if not long:
        return rows.withColumn("_after", after).withColumn("_before", F.coalesce(F.lag("_after").over(earlier), F.lit(0))).drop("_delta", "_sum", "_least")
    from ..functions.windows import lagged

    rows = lagged(rows.withColumn("_after", after), keys, ["_seq", "_kind"], {"_before": ("_after", 1)}, long=True)
    return rows.withColumn("_before", F.coalesce("_before", F.lit(0))).drop("_delta", "_sum", "_least")


def _at_levels(events: DataFrame, keys: list[str], depth: int, long: bool) -> DataFrame:
    """Events (keys, _seq, _kind, _x, _rank) with each demand split over the levels (_node) that give it; a probe stands at the best level of its time that holds anything."""
    kind, x = F.col("_kind"), F.col("_x")
    rows = events.withColumn("_node", F.lit(0).cast("long"))
    for round_ in range(depth):
        place = F.shiftright("_rank", depth - 1 - round_)
        better = place == 2 * F.col("_node")
        stays = kind.isin(ADD, CANCEL)
        delta = F.when((kind == ADD) & better, x).when((kind == CANCEL) & better, -x).when(kind == TAKE, -x).otherwise(0)
        rows = _held_at_zero(rows, [*keys, "_node"], delta, long)
        given = F.least(x, F.col("_before"))
        left, right = 2 * F.col("_node"), 2 * F.col("_node") + 1
        at = lambda node, amount: F.struct(node.cast("long").alias("node"), amount.cast("long").alias("x"))
        split = F.filter(F.array(at(left, given), at(right, x - given)), lambda s: s["x"] > 0)
        parts = F.when(stays, F.array(at(place, x))).when(kind == TAKE, split).otherwise(F.array(at(F.when(F.col("_before") > 0, left).otherwise(right), x)))
        rows = rows.withColumn("_part", F.explode(parts)).withColumns({"_node": F.col("_part.node"), "_x": F.col("_part.x")}).drop("_part", "_before", "_after")
    return rows


def match_with_cancels(orders: DataFrame, keys: list[str], order: list[str], tick: int = 1, lot: int = 4096, most_passes: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Fills and what became of each resting order.

    orders: keys (a book, say), the order's columns, id, action (add, take, cancel), side (that the order rests on, or takes or cancels from: 1 bids, -1 asks), price (of an add; of a cancel,
    or null), distance (of a cancel without price: ticks from the best price of its time) and quantity. Limits must not cross. Orders without a positive quantity do nothing.
    Fills: keys, side, taker, maker (ids), price, filled. Orders: keys, side, id, price, quantity, filled, cancelled, resting.
    """
    sided = [*keys, "side"]
    long = has_long(orders, sided)
    rows = row_numbers(orders.where("quantity > 0"), sided, order, "_seq", long=long)
    rows = rows.select(*sided, F.col("_seq").cast("long").alias("_seq"), "id", "action", F.col("price").cast("long").alias("price"), F.col("distance").cast("long").alias("distance"), F.col("quantity").cast("long").alias("quantity"))
    rows = keep(rows)
    # Levels best first: bids fall, asks rise.
    levels = rows.where("action = 'add'").select(*sided, "price").distinct()
    best_first = levels.withColumn("_p", -F.col("side") * F.col("price"))
    levels = keep(row_numbers(best_first, sided, ["_p"], "_rank").select(*sided, "price", (F.col("_rank") - 1).cast("long").alias("_rank")))
    depth = max(1, ((levels.agg(F.max("_rank")).first()[0] or 0)).bit_length())
    known = levels.select(*[F.col(c).alias(f"_l_{c}") for c in sided], F.col("price").alias("_l_price"), "_rank")
    same = [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in sided]
    ranked = lambda df: df.join(known, [*same, F.col("price") == F.col("_l_price")], "left").drop(*[f"_l_{c}" for c in sided], "_l_price")
    adds = ranked(rows.where("action = 'add'")).select(*sided, "_seq", F.lit(ADD).alias("_kind"), F.col("quantity").alias("_x"), "_rank")
    takes = rows.where("action = 'take'").select(*sided, "_seq", F.lit(TAKE).alias("_kind"), F.col("quantity").alias("_x"), F.lit(None).cast("long").alias("_rank"))
    cancels = rows.where("action = 'cancel'")
    floating = cancels.where("price is null")
    probes = floating.select(*sided, "_seq", F.lit(PROBE).alias("_kind"), F.lit(1).cast("long").alias("_x"), F.lit(None).cast("long").alias("_rank"))
    fixed = keep(adds.unionByName(takes).unionByName(probes))
    # A guess is a level and what the cancel takes there: all it asks for at its price; nothing yet without one.
    guess = keep(ranked(cancels).select(*sided, "_seq", "quantity", "distance", F.col("price").isNull().alias("_floats"), "_rank", F.when(F.col("_rank").isNotNull(), F.col("quantity")).otherwise(0).cast("long").alias("_take")))
    # Sides of books don't touch each other: one whose guesses all stay is done. Whenever half of those at hand are, later passes read only the others.
    done, at_hand = [], rows.select(*sided).distinct().count()

    def of_sides(df: DataFrame, sides: DataFrame, how: str) -> DataFrame:
        few = sides.select(*[F.col(c).alias(f"_l_{c}") for c in sided])
        return df.join(few, [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in sided], how)

    for _ in range(most_passes):
        acting = guess.where("_take > 0").select(*sided, "_seq", F.lit(CANCEL).alias("_kind"), F.col("_take").alias("_x"), "_rank")
        # Each cancel also looks at its level, with whatever it takes, to see what it could take.
        looking = guess.where("_rank is not null").select(*sided, "_seq", F.lit(CANCEL).alias("_kind"), F.lit(0).cast("long").alias("_x"), "_rank").join(acting.select(*sided, "_seq"), [*sided, "_seq"], "left_anti")
        at_levels = keep(_at_levels(fixed.unionByName(acting).unionByName(looking), sided, depth, long))
        queued = keep(_held_at_zero(at_levels, [*sided, "_node"], F.when(F.col("_kind") == ADD, F.col("_x")).when(F.col("_kind") == PROBE, 0).otherwise(-F.col("_x")), long))
        could = queued.where(F.col("_kind") == CANCEL).select(*sided, "_seq", F.col("_before").alias("_could"))
        best = queued.where((F.col("_kind") == PROBE) & (F.col("_before") > 0)).select(*sided, "_seq", F.col("_node").alias("_rank")).join(levels.select(*sided, "_rank", F.col("price").alias("_best")), [*sided, "_rank"]).drop("_rank")
        told = guess.join(could, [*sided, "_seq"], "left").join(best, [*sided, "_seq"], "left")
        aimed = F.when(F.col("_floats"), F.col("_best") - F.col("side") * F.greatest(F.lit(0), "distance") * tick)
        new = told.withColumn("price", aimed).withColumnRenamed("_rank", "_was")
        new = ranked(new)
        level = F.when(F.col("_floats"), F.col("_rank")).otherwise(F.col("_was"))
        stays = level.eqNullSafe(F.col("_was"))
        # At a level not looked at yet, all that is asked for is the next guess.
        take = F.when(level.isNull(), 0).when(stays, F.least("quantity", F.coalesce("_could", F.lit(0)))).otherwise(F.col("quantity")).cast("long")
        new = new.select(*sided, "_seq", "quantity", "distance", "_floats", level.alias("_new"), take.alias("_t"), (~stays | (take != F.col("_take"))).alias("_moved"))
        new = keep(new.select(*sided, "_seq", "quantity", "distance", "_floats", F.col("_new").alias("_rank"), F.col("_t").alias("_take"), "_moved"))
        moved = new.where("_moved").select(*sided).distinct()
        left = moved.count()
        if not left:
            done.append(at_levels)
            break
        guess = new.drop("_moved")
        if 2 * left <= at_hand:
            moved, at_hand = keep(moved), left
            done.append(of_sides(at_levels, moved, "left_anti"))
            guess, fixed = keep(of_sides(guess, moved, "left_semi")), keep(of_sides(fixed, moved, "left_semi"))
    else:
        raise RuntimeError("cancels didn't settle")
    at_levels = keep(reduce(DataFrame.unionByName, done)) if len(done) > 1 else at_levels

    place = [*sided, "_node"]
    signed = F.when(F.col("_kind") == ADD, F.col("_x")).when(F.col("_kind") == CANCEL, -F.col("_x")).otherwise(0)
    level_rows = at_levels.where(F.col("_kind") != PROBE).withColumns({"_b": signed, "_f": F.when(F.col("_kind") == TAKE, F.col("_x")).otherwise(0)})
    level_rows = running_totals(level_rows, place, ["_seq", "_kind"], {"_back": F.col("_b"), "_front": F.col("_f")}, long=long)
    # The lowest back from a row on, the last rows first.
    turned = level_rows.withColumn("_turn", -F.col("_seq"))
    turned = keep(carried(turned, place, ["_turn", "_kind"], {"_lowest": extreme_of(F.col("_back"), False)}, long=long))
    low, high = F.col("_back") - F.col("_x"), F.least(F.col("_back"), F.col("_lowest"))
    makers = turned.where(F.col("_kind") == ADD).select(*place, F.col("_seq").alias("maker"), low.alias("_low"), F.greatest(low, high).alias("_high"), F.col("_x").alias("_size"))
    takers = turned.where(F.col("_kind") == TAKE).select(*place, F.col("_seq").alias("taker"), (F.col("_front") - F.col("_x")).alias("_from"), F.col("_front").alias("_to"))
    lots = lambda df, a, b: df.where(F.col(b) > F.col(a)).withColumn("_lot", F.explode(F.sequence(F.floor(F.col(a) / lot).cast("long"), F.floor((F.col(b) - 1) / lot).cast("long"))))
    met = lots(takers, "_from", "_to").join(lots(makers, "_low", "_high"), [*place, "_lot"])
    overlap = F.least("_to", "_high", (F.col("_lot") + 1) * lot) - F.greatest("_from", "_low", F.col("_lot") * lot)
    fills = met.withColumn("filled", overlap).where("filled > 0").groupBy(*place, "taker", "maker").agg(F.sum("filled").alias("filled"))
    fills = keep(fills.withColumnRenamed("_node", "_rank").join(levels, [*sided, "_rank"]).drop("_rank"))
    names = rows.select(*sided, F.col("_seq"), "id")
    by_maker = fills.groupBy(*sided, "maker").agg(F.sum("filled").alias("_filled"))
    became = makers.withColumnRenamed("_node", "_rank").join(levels, [*sided, "_rank"]).join(by_maker, [*sided, "maker"], "left").join(names.withColumnRenamed("_seq", "maker"), [*sided, "maker"])
    filled = F.coalesce("_filled", F.lit(0))
    became = became.select(*sided, "id", "price", F.col("_size").alias("quantity"), filled.alias("filled"), (F.col("_size") - F.col("_high") + F.col("_low")).alias("cancelled"), (F.col("_high") - F.col("_low") - filled).alias("resting"))
    fills = fills.join(names.select(*sided, F.col("_seq").alias("taker"), F.col("id").alias("_taker")), [*sided, "taker"]).join(names.select(*sided, F.col("_seq").alias("maker"), F.col("id").alias("_maker")), [*sided, "maker"])
    return fills.select(*sided, F.col("_taker").alias("taker"), F.col("_maker").alias("maker"), "price", "filled"), became
