"""States that merge: samples, moments and digests of parts of a flow, from which those of the whole follow, over slices, batches and replicas alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng, windows
from ..functions.kept import keep
from ..functions.windows import has_long, running_totals, with_slice

# --- bottom-k samples


def bottom_k(df: DataFrame, keys: list[str], id_col: str, k: int, seed: int, most: int = 100_000) -> DataFrame:
    """k rows of each key, those whose draw is smallest (ties by id): a sample that depends on ids alone, not on partitions or batches.

    The rows of a key are dealt to parts of about `most` rows by a hash of their ids; of each part its k smallest go on to fewer parts, until one is left. So a
    task takes about max(most, 2k) rows of a key, however many it has. The sample of a union is bottom_k() of the samples' union.
    """
    fan = max(2, most // max(1, k))
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-largest // max(most, 2 * k)))
    out = df.withColumn("_draw", rng.draw(F.col(id_col) + seed, F.lit(1)))
    place = F.xxhash64(id_col)
    while True:
        part = [F.pmod(place, F.lit(parts))] if parts > 1 else []
        ranked = Window.partitionBy(*keys, *part).orderBy("_draw", id_col)
        out = out.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= k).drop("_n")
        if parts == 1:
            return out.drop("_draw")
        parts = max(1, parts // fan)


# --- moments

#: at: the place of the first value in the order; cross: products of neighbours, both about the mean.
MOMENT_FIELDS = ("n", "mean", "m2", "m3", "m4", "cross", "first", "last")


def moment_states(df: DataFrame, keys: list[str], order: list[str], x: str, part: Column | None = None, long: bool | None = None) -> DataFrame:
    """keys, at and MOMENT_FIELDS of the series' values, or of each part of it (part grows with the order). Nulls are passed over."""
    rows = df.where(F.col(x).isNotNull()).withColumns({"_x": F.col(x).cast("double"), "_part": part if part is not None else F.lit(0)})
    series = [*keys, "_part"]
    rows = windows.lagged(rows, series, order, {"_b": ("_x", 1)}, long=long)
    v, b, n = F.col("_x"), F.col("_b"), F.count("_x").cast("double")
    later, mid, m2 = F.when(b.isNotNull(), v), F.avg("_x"), F.var_pop("_x") * F.count("_x")
    spread = F.sqrt(F.var_pop("_x"))
    finite = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    cross = F.count(b) * (F.covar_pop(later, b) + (F.avg(later) - mid) * (F.avg(b) - mid))
    place = F.struct(*order)
    return rows.groupBy(*series).agg(
        F.min(place).alias("at"), F.count("_x").alias("n"), mid.alias("mean"), m2.alias("m2"), finite(F.skewness("_x") * n * F.pow(spread, F.lit(3.0))).alias("m3"),
        finite((F.kurtosis("_x") + 3) * n * F.pow(spread, F.lit(4.0))).alias("m4"), F.coalesce(cross, F.lit(0.0)).alias("cross"), F.min_by("_x", place).alias("first"), F.max_by("_x", place).alias("last"),
    ).drop("_part")


def _joined(a: Column, b: Column) -> Column:
    """The state of two neighbouring parts. Sums about the common mean come from sums about each part's own."""
    na, nb = a["n"].cast("double"), b["n"].cast("double")
    n = na + nb
    gap = b["mean"] - a["mean"]
    mean = a["mean"] + gap * nb / n
    share, da, db = na * nb / n, a["mean"] - mean, b["mean"] - mean
    m2 = a["m2"] + b["m2"] + gap * gap * share
    m3 = a["m3"] + b["m3"] + gap * gap * gap * share * (na - nb) / n + 3 * gap * (na * b["m2"] - nb * a["m2"]) / n
    m4 = a["m4"] + b["m4"] + gap * gap * gap * gap * share * (na * na - na * nb + nb * nb) / (n * n) + 6 * gap * gap * (na * na * b["m2"] + nb * nb * a["m2"]) / (n * n) + 4 * gap * (na * b["m3"] - nb * a["m3"]) / n

    def moved(s: Column, d: Column) -> Column:
        """Neighbours' products about a mean that lies d below the part's own: a part's values sum to 0 about it, but for its ends."""
        return s["cross"] - d * ((s["first"] - s["mean"]) + (s["last"] - s["mean"])) + (s["n"] - 1) * d * d

    cross = moved(a, da) + moved(b, db) + (a["last"] - mean) * (b["first"] - mean)
    values = (a["at"], a["n"] + b["n"], mean, m2, m3, m4, cross, a["first"], b["last"])
    return F.struct(*[c.alias(name) for c, name in zip(values, ("at", *MOMENT_FIELDS))])


def merged_moments(states: DataFrame, keys: list[str], fan: int = 4096) -> DataFrame:
    """One state for each key from those of its parts, in order; parts must not overlap. Up to `fan` neighbours meet in a task, then their results."""
    fields = ["at", *MOMENT_FIELDS]
    while True:
        counted = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        group = []
        if counted > fan:
            states = windows.row_numbers(states, keys, ["at"], "_row").withColumn("_row", F.floor((F.col("_row") - 1) / fan))
            group = ["_row"]
        listed = F.array_sort(F.collect_list(F.struct(*fields)))
        folded = states.groupBy(*keys, *group).agg(listed.alias("_s"))
        # The fold starts at the first state, so that no empty state is needed.
        whole = F.aggregate(F.slice("_s", 2, fan), F.get("_s", F.lit(0)), _joined)
        states = folded.select(*keys, whole.alias("_w")).select(*keys, "_w.*")
        if counted <= fan:
            return states


def finished_moments(states: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean, population variance, central kurtosis and first autocorrelation; 0 where there is no spread."""
    n, m2 = F.col("n"), F.col("m2")
    spread = lambda c: F.when(m2 > 0, c).otherwise(0.0)
    return states.select(*keys, "n", "mean", (m2 / n).alias("variance"), spread(n * F.col("m4") / (m2 * m2)).alias("kurtosis"), spread(F.col("cross") / m2).alias("acf1"))


# --- digests of tapes

#: Two primes under 2^31, and for each a base of the columns and one of the rows.
MODULI = ((2147483647, 1_000_003, 48_271), (2147483629, 1_000_033, 69_621))
DIGITS = 6  # of a row's distance from the end, base 256


def _power(base: int, prime: int, exponent: Column) -> Column:
    """base^exponent mod prime, from a table of 256 powers for each digit of the exponent."""
    out = None
    for digit in range(DIGITS):
        step = pow(base, 1 << (8 * digit), prime)
        table = F.expr(f"array({', '.join(f'{pow(step, i, prime)}L' for i in range(256))})")
        factor = F.get(table, F.shiftright(exponent, 8 * digit).bitwiseAND(F.lit(255)).cast("int"))
        out = factor if out is None else out * factor % prime
    return out


def _row_value(columns: list[str], base: int, prime: int) -> Column:
    return reduce(lambda h, c: (h * base + F.pmod(F.col(c).cast("long"), F.lit(prime))) % prime, columns, F.lit(0).cast("long"))


def tape_parts(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], width: float | None = None, long: bool | None = None) -> DataFrame:
    """keys, _slice, n, h0, h1: for each part of a tape its length and its polynomials' values, sum of value times base^(rows behind it)."""
    if has_long(rows, keys) if long is None else long:
        rows = with_slice(rows if width is not None else keep(rows), order[0], width)
    else:
        rows = rows.withColumn("_slice", F.lit(0).cast("long"))
    part = Window.partitionBy(*keys, "_slice")
    behind = (F.count(F.lit(1)).over(part) - F.row_number().over(part.orderBy(*order))).cast("long")
    values = {f"_v{i}": _row_value(columns, a, p) for i, (p, a, _) in enumerate(MODULI)}
    rows = rows.withColumns({"_behind": behind, **values})
    sums = [(F.sum(F.col(f"_v{i}") * _power(b, p, F.col("_behind")) % p) % p).alias(f"h{i}") for i, (p, _, b) in enumerate(MODULI)]
    return rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("n"), *sums)


def joined_tapes(parts: DataFrame, keys: list[str], order: str, long: bool | None = None) -> DataFrame:
    """keys, n, h0, h1 of the parts' tape in order: (length, value) pairs compose, (n, h) then (m, g) being (n + m, h base^m + g).

    So a part is shifted by the rows behind it. Tapes of all books in order of book are joined the same way, without keys; no row of a tape moves for it.
    """
    upto = running_totals(parts, keys, [order], {"_upto": F.col("n")}, long=long)
    totals = parts.groupBy(*keys).agg(F.sum("n").alias("_total")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_total")
    both = upto.join(totals, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]) if keys else upto.join(F.broadcast(totals))  # without keys: one row
    behind = (F.col("_total") - F.col("_upto")).cast("long")
    sums = [(F.sum(F.col(f"h{i}") * _power(b, p, behind) % p) % p).alias(f"h{i}") for i, (p, _, b) in enumerate(MODULI)]
    return both.groupBy(*keys).agg(F.sum("n").alias("n"), *sums)


def tape_digest(tape: DataFrame) -> Column:
    """62 bits of a tape that joined_tapes() gave."""
    return F.shiftleft(F.col("h0"), 31).bitwiseOR(F.col("h1"))


def tape_digests(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], n: str, out: str, width: float | None = None, long: bool | None = None) -> DataFrame:
    """For each key how many rows its tape has and a digest of their columns in order. No task holds a tape."""
    whole = joined_tapes(tape_parts(rows, keys, order, columns, width, long), keys, "_slice")
    return whole.select(*keys, F.col("n").alias(n), tape_digest(whole).alias(out))


# --- replicas


def replica_difference(left: DataFrame, right: DataFrame, columns: list[str], rows_each: int = 10_000) -> DataFrame:
    """Rows of either side that the other lacks (as often as it does), with column side: ranges whose digests agree are never shuffled.

    Rows fall into ranges by a hash of all columns, about so many rows to a range; each side's ranges are counted and summed up (two hashes, whose sums don't depend on order) in
    one aggregation. Only rows of ranges that differ are compared. Ranges are at most 2^20.
    """
    size = left.count()
    n = min(1 << 20, max(64, -(-size // rows_each)))
    ranged = lambda df: df.select(*columns, F.pmod(F.xxhash64(*columns), F.lit(n)).alias("_range"))
    wide = "decimal(38,0)"
    digest = lambda df: ranged(df).groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(F.lit(1), *columns).cast(wide)).alias("a"), F.sum(F.hash(F.lit(2), *columns).cast("long")).alias("b"))
    mine, theirs = digest(left), digest(right)
    differ = keep(mine.exceptAll(theirs).unionByName(theirs.exceptAll(mine)).select("_range").distinct())
    # A range for each of at most 2^20 numbers.
    some = lambda df: ranged(df).join(F.broadcast(differ), "_range", "left_semi").select(*columns)
    a, b = some(left), some(right)
    balance = a.withColumn("_d", F.lit(1)).unionByName(b.withColumn("_d", F.lit(-1))).groupBy(*columns).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    side = F.when(F.col("_d") > 0, "left").otherwise("right")
    return balance.withColumn("side", side).withColumn("_d", F.explode(F.array_repeat(F.lit(0), F.abs("_d").cast("int")))).drop("_d")

