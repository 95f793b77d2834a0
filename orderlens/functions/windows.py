"""Running sums, extremes, row numbers, last values and lags over series, so that no task holds a long one.

The rows of each series are counted first (one aggregation of the keys). While no series is LONG, a window is a series: one exchange serves all windows over
the same keys and order, and one sort. Else the rows are cut into slices by the order's first column, each slice a window, and written once; what its
predecessors carry into a slice comes from one row for each slice. So a nest of calls reads its source once, however deep it is. A caller that knows
whether there are long series says so (long), so that derived series aren't counted again: filters make them no longer.

Slices are ranges of a width where the caller knows one, else between quantiles of the column over all series, so that the slices of a series that
holds a share of all rows hold equal shares of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .kept import keep

#: Rows of a series that one task takes as one window.
LONG = 2_000_000
#: Slices of all series up to which their carried values go to every task.
FEW_SLICES = 200_000
#: Slices between quantiles for each shuffle partition.
PER_PARTITION = 4


@dataclass
class Carry:
    """inside: the value up to a row, over a window of its slice; whole: the value of a slice, as an aggregate; total: that over the slices before; combine: of total and inside."""

    inside: Callable[[WindowSpec], Column]
    whole: Column
    total: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]


def with_slice(df: DataFrame, first: str, width: float | None) -> DataFrame:
    """df with column _slice, which grows with the order's first column; nulls come first."""
    if width is not None:
        return df.withColumn("_slice", F.coalesce(F.floor(F.col(first) / width).cast("long"), F.lit(-(1 << 62))))
    n = PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(df.dtypes)[first]
    value = F.col(first).cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else F.col(first).cast("double")
    shares = [(i + 1) / n for i in range(n - 1)]
    df = df.withColumn("_value", value).withColumn("_bounds", df.agg(F.percentile_approx(value, shares, max(10_000, 20 * n))).scalar())

    def halve(s: Column, _: Column) -> Column:
        """How many of the sorted bounds are below the value."""
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        open_, below = s["low"] < s["high"], F.coalesce(F.get(F.col("_bounds"), middle) < F.col("_value"), F.lit(False))
        return F.struct(F.when(open_ & below, middle + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~below, middle).otherwise(s["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(len(shares).bit_length() + 1))
    at = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(shares)).alias("high")), halve)["low"].cast("long")
    return df.withColumn("_slice", F.when(F.col("_value").isNull(), F.lit(-1)).otherwise(at)).drop("_value", "_bounds")


def has_long(df: DataFrame, keys: list[str]) -> bool:
    """Whether a series has more rows than one task takes."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > LONG


def carried(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Carry], width: float | None = None, long: bool | None = None) -> DataFrame:
    """df with a column more for each of the values: over all rows of a series up to and including the row."""
    rest = [F.col(c) for c in df.columns if c not in values]
    if not (has_long(df, keys) if long is None else long):
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*rest, *[v.inside(whole).alias(name) for name, v in values.items()])
    # Two hashes name a series' slice, as keys can be null.
    rows = with_slice(df if width is not None else keep(df), order[0], width)
    names = [*keys, "_slice"]
    rows = rows.withColumns({"_part": F.xxhash64(*names), "_check": F.hash(*names)})
    within = Window.partitionBy("_part", "_check").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = keep(rows.repartition("_part", "_check").withColumns({f"_a{i}": v.inside(within) for i, v in enumerate(values.values())}))
    firsts = [F.first(c).alias(f"_n{i}") for i, c in enumerate(names)]
    slices = keep(rows.groupBy("_part", "_check").agg(*firsts, *[v.whole.alias(f"_b{i}") for i, v in enumerate(values.values())]))
    # A row for each series and slice, so this window is short.
    before = Window.partitionBy(*[f"_n{i}" for i in range(len(keys))]).orderBy(f"_n{len(keys)}").rowsBetween(Window.unboundedPreceding, -1)
    few = slices.count() <= FEW_SLICES
    slices = slices.select("_part", "_check", *[v.total(F.col(f"_b{i}")).over(before).alias(f"_b{i}") for i, v in enumerate(values.values())])
    out = rows.join(F.broadcast(slices) if few else slices, ["_part", "_check"])
    return out.select(*rest, *[v.combine(F.col(f"_b{i}"), F.col(f"_a{i}")).alias(name) for i, (name, v) in enumerate(values.items())])


def total_of(value: Column) -> Carry:
    add = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return Carry(lambda w: F.sum(value).over(w), F.sum(value), F.sum, add)


def extreme_of(value: Column, largest: bool) -> Carry:
    of, best = (F.max, F.greatest) if largest else (F.min, F.least)
    return Carry(lambda w: of(value).over(w), of(value), of, best)


def last_of(value: Column, order: list[str]) -> Carry:
    """The last value that isn't null."""
    latest = F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    return Carry(lambda w: F.last(value, ignorenulls=True).over(w), latest, lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a))


def running_totals(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], width: float | None = None, long: bool | None = None) -> DataFrame:
    """Sums up to and including the row."""
    return carried(df, keys, order, {name: total_of(v) for name, v in values.items()}, width, long)


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str, width: float | None = None, long: bool | None = None) -> DataFrame:
    """From 1, in order."""
    return running_totals(df, keys, order, {out: F.lit(1)}, width, long).withColumn(out, F.col(out).cast("int"))


def last_known(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, width: float | None = None, long: bool | None = None) -> DataFrame:
    """The last value that isn't null, up to and including the row."""
    return carried(df, keys, order, {out: last_of(value, order)}, width, long)


def framed(df: DataFrame, keys: list[str], order: list[str], reach: int, values: Callable[[WindowSpec], dict[str, Column]], width: float | None = None, block: int = 4096, long: bool | None = None) -> DataFrame:
    """df with columns more that look at most reach rows back in the series: values gets a window ordered by row.

    Of long series the rows are numbered over slices first; then a window is a block of numbers, with the last rows of the block before it as guests.
    """
    if not (has_long(df, keys) if long is None else long):
        return df.withColumns(values(Window.partitionBy(*keys).orderBy(*order)))
    block = max(block, 16 * reach)
    rows = row_numbers(df, keys, order, "_number", width, True).withColumn("_block", F.floor((F.col("_number") - 1) / block))
    home = F.struct(F.col("_block").alias("at"), F.lit(False).alias("guest"))
    visit = F.struct((F.col("_block") + 1).alias("at"), F.lit(True).alias("guest"))
    late = (F.col("_number") - 1) % block >= block - reach
    rows = rows.withColumn("_place", F.explode(F.when(late, F.array(home, visit)).otherwise(F.array(home))))
    out = rows.withColumns(values(Window.partitionBy(*keys, "_place.at").orderBy("_number")))
    return out.where("not _place.guest").drop("_number", "_block", "_place")


def lagged(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, int]], width: float | None = None, long: bool | None = None) -> DataFrame:
    """df with, for each name, a column as it was so many rows before in the series."""
    reach = max(k for _, k in values.values())
    return framed(df, keys, order, reach, lambda w: {name: F.lag(column, k).over(w) for name, (column, k) in values.items()}, width, long=long)


def decayed_means(df: DataFrame, keys: list[str], order: list[str], x: str, share: float, out: str, width: float | None = None, long: bool | None = None) -> DataFrame:
    """df with the exponentially weighted mean a = (1 - share) a + share x over all values so far, the first of them as it is; nulls are passed over.

    Values are numbered and cut into blocks of so many that a value's weight falls by a factor of 1e-250 over one. Within a block the mean is a running sum of values over powers of
    the decay; what lies before comes in as the end of the block before, times the decay since. What lies two blocks back weighs nothing that a double could show.
    """
    keep_share = 1.0 - share
    if not 0 < keep_share < 1:
        raise ValueError("share must lie between 0 and 1")
    size = max(1, min(1 << 20, int(250 * math.log(10) / -math.log(keep_share))))
    long = has_long(df, keys) if long is None else long
    value = F.col(x).cast("double")
    rows = running_totals(df, keys, order, {"_seen": F.when(value.isNotNull(), 1).otherwise(0)}, width, long)
    rows = rows.withColumns({"_block": F.floor((F.col("_seen") - 1) / size), "_at": F.pmod(F.col("_seen") - 1, F.lit(size))})
    place, absent = Window.partitionBy(*keys, "_block").orderBy("_seen", "_absent"), value.isNull()
    scale = F.pow(F.lit(keep_share), F.col("_at"))
    weight = F.when(F.col("_seen") == 1, 1.0).otherwise(share)
    inside = F.sum(F.when(absent, None).otherwise(weight * value / scale)).over(place.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_absent", absent).withColumn("_inside", inside * scale)
    if not long:
        end = F.max_by("_inside", "_seen").over(Window.partitionBy(*keys).orderBy("_block").rangeBetween(-1, -1))
        rows = rows.withColumn("_before", end)
    else:
        rows = keep(rows)
        ends = rows.groupBy(*keys, (F.col("_block") + 1).alias("_block")).agg(F.max_by("_inside", "_seen").alias("_before"))
        names = [*keys, "_block"]
        ends = ends.select(*[F.col(c).alias(f"_e_{c}") for c in names], "_before")
        rows = rows.join(ends, [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in names], "left").drop(*[f"_e_{c}" for c in names])
    mean = F.col("_inside") + F.coalesce("_before", F.lit(0.0)) * scale * keep_share
    return rows.withColumn(out, mean).drop("_seen", "_block", "_at", "_absent", "_inside", "_before")
