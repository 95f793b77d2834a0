"""Statistics of return and depth series, as aggregate Column expressions. Where a series is too short or constant, the value is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows
from .kept import keep
from .windows import has_long, lagged, running_totals


def mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def variance(x: Column) -> Column:
    """Over n-1."""
    return F.coalesce(F.var_samp(x), F.lit(0.0))


def percentile(x: Column, p: float) -> Column:
    """Linear between neighbours, at p (n-1). A group's distinct values are one task's: for groups that aren't long; percentiles() has no such bound."""
    return F.coalesce(F.percentile(x, F.lit(p)), F.lit(0.0))


def percentiles(df: DataFrame, keys: list[str], x: str, wanted: dict[str, float], mean_as: str | None = None, long: bool | None = None) -> DataFrame:
    """keys with a column for each name and p, linear between neighbours at p (n-1), and the mean if it has a name; 0 where a group has no values.

    Values are counted first. A group of few distinct values is a window over its counts; those of a long group are summed up over ranges of values, and only the
    two neighbours of each rank are picked, so no task holds a group's values, however many are distinct.
    """
    v, c = F.col("_v"), F.col("_c")
    counts = df.groupBy(*keys, F.col(x).cast("double").alias("_v")).agg(F.count(x).alias("_c"))
    in_ranks = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - c <= rank)
    at = {name: p * (F.col("_n") - 1) for name, p in wanted.items()}
    low = {name: F.floor(a).cast("long") for name, a in at.items()}
    sides = [e for name in wanted for e in (F.max(F.when(in_ranks(F.least(low[name], F.col("_n") - 1)), v)).alias(f"_a_{name}"), F.max(F.when(in_ranks(F.least(low[name] + 1, F.col("_n") - 1)), v)).alias(f"_b_{name}"))]
    between = [F.coalesce(F.col(f"_a_{name}") + (F.col(f"_b_{name}") - F.col(f"_a_{name}")) * (at[name] - low[name]), F.lit(0.0)).alias(name) for name in wanted]
    mean_of = [F.coalesce(F.try_divide("_total", "_n"), F.lit(0.0)).alias(mean_as)] if mean_as else []

    def picked(ranked: DataFrame) -> DataFrame:
        """From values with how many are up to each and in all."""
        return ranked.groupBy(*keys).agg(*sides, F.max("_n").alias("_n"), F.sum(v * c).alias("_total")).select(*keys, *between, *mean_of)

    def in_windows(some: DataFrame) -> DataFrame:
        group = Window.partitionBy(*keys)
        return picked(some.withColumns({"_upto": F.sum(c).over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum(c).over(group)}))

    if not (has_long(df, keys) if long is None else long):
        return in_windows(counts)
    counts = keep(counts)
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum("_c").alias("_n"))
    large = keep(sizes.where(F.col("_rows") > windows.LONG).drop("_rows"))  # each has LONG values, so there are few
    if large.isEmpty():
        return in_windows(counts)
    if not keys:
        return picked(running_totals(counts, keys, ["_v"], {"_upto": c}, long=True).join(F.broadcast(large)))  # one row
    large = large.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_n")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    upto = running_totals(counts.join(F.broadcast(large), same, "left_semi"), keys, ["_v"], {"_upto": c}, long=True)
    rest = counts.join(F.broadcast(large), same, "left_anti")
    return picked(upto.join(F.broadcast(large), same)).unionByName(in_windows(rest))


def with_percentiles(df: DataFrame, keys: list[str], x: str, aggregates: list[Column], wanted: dict[str, float], long: bool) -> DataFrame:
    """Aggregates and percentiles of each group: in one pass while no group is long, else from df kept."""
    if not long:
        return df.groupBy(*keys).agg(*aggregates, *[percentile(F.col(x), p).alias(name) for name, p in wanted.items()])
    df = keep(df)
    ranks = percentiles(df, keys, x, wanted, long=True).select(*[F.col(k).alias(f"_p_{k}") for k in keys], *wanted)
    return df.groupBy(*keys).agg(*aggregates).join(ranks, [F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in keys]).drop(*[f"_p_{k}" for k in keys])


def skewness(x: Column) -> Column:
    """The third moment in units of the sample deviation."""
    n, v = F.count(x), F.var_samp(x)
    return F.when((n < 3) | (F.coalesce(v, F.lit(0.0)) <= 1e-30), 0.0).otherwise(F.skewness(x) * F.pow((n - 1) / n, F.lit(1.5)))


def kurtosis(x: Column) -> Column:
    """The fourth moment in units of the sample deviation; 3 for a normal series."""
    n, v = F.count(x), F.var_samp(x)
    return F.when((n < 4) | (F.coalesce(v, F.lit(0.0)) <= 1e-30), 0.0).otherwise((F.kurtosis(x) + 3) * F.pow((n - 1) / n, F.lit(2)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's; 0 if either is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    scale = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.when(scale > 0, scale)), F.lit(0.0))


def autocorrelations(df: DataFrame, keys: list[str], order: list[str], x: str, lags: list[int], prefix: str, width: float | None = None, long: bool | None = None) -> DataFrame:
    """keys with one column for each lag: mean and denominator over the whole series; 0 where it isn't longer than the lag.

    The sum over pairs is about the pairs' own means first, then moved to the series' mean, so that one pass serves and nothing cancels.
    """
    rows = df.where(F.col(x).isNotNull()).select(*keys, *[c for c in order if c not in keys], F.col(x).cast("double").alias("_x"))
    shifted = lagged(rows, keys, order, {f"_x{k}": ("_x", k) for k in lags}, width, long)
    later, mid, n = F.col("_x"), F.avg("_x"), F.count("_x")
    below = F.var_pop("_x") * n

    def above(k: int) -> Column:
        earlier = F.col(f"_x{k}")
        paired = F.when(earlier.isNotNull(), later)
        return F.count(earlier) * (F.covar_pop(paired, earlier) + (F.avg(paired) - mid) * (F.avg(earlier) - mid))

    return shifted.groupBy(*keys).agg(*[F.coalesce(F.try_divide(above(k), F.when(below > 0, below)), F.lit(0.0)).alias(f"{prefix}{k}") for k in lags])


def log_returns(df: DataFrame, keys: list[str], order: list[str], price: str, out: str = "r", width: float | None = None, long: bool | None = None) -> DataFrame:
    """Rows with a positive price and one before it in the same series, with the log return; rows that aren't positive break the pair."""
    df = lagged(df, keys, order, {"_before": (price, 1)}, width, long)
    r = F.when((F.col(price) > 0) & (F.col("_before") > 0), F.log(price) - F.log("_before"))
    return df.withColumn(out, r).where(F.col(out).isNotNull()).drop("_before")


def one_pass(x: Column) -> dict[str, Column]:
    """Count, population variance and fourth moment about zero over its square, as a run reports them."""
    v = F.coalesce(F.var_pop(x), F.lit(0.0))
    return {"n": F.count(x), "variance": v, "kurtosis": F.when(v > 2.2e-16, F.try_divide(F.avg(F.pow(x, F.lit(4.0))), v * v)).otherwise(0.0)}


def one_pass_acf(x: Column, before: Column) -> Column:
    """The mean of the products with the value before, less the squared mean of all, over the variance: means over unequal counts."""
    paired, v, mid = F.when(before.isNotNull(), x), F.var_pop(x), F.avg(x)
    above = F.covar_pop(paired, before) + (F.avg(paired) - mid) * F.avg(before) + mid * (F.avg(before) - mid)
    return F.when(v > 2.2e-16, F.coalesce(F.try_divide(above, v), F.lit(0.0))).otherwise(0.0)


#: Name, default weight and scale floor of each moment, and where it comes from.
MOMENTS = {
    "return_mean": (0.5, 1e-6), "return_variance": (3.0, 1e-8), "return_skewness": (0.5, 0.05), "return_kurtosis": (1.5, 1.0),
    "return_acf_lag1": (2.0, 0.01), "abs_return_acf_lag1": (1.5, 0.02), "abs_return_acf_lag2": (1.0, 0.02), "abs_return_acf_lag5": (1.0, 0.02),
    "abs_return_acf_lag10": (1.0, 0.02), "abs_return_acf_lag25": (0.75, 0.02), "abs_return_acf_lag50": (0.75, 0.02), "abs_return_acf_lag100": (0.5, 0.02),
    "mean_spread": (2.5, 100.0), "spread_p90": (1.5, 100.0), "spread_p95": (1.0, 100.0), "volume_volatility_corr": (1.0, 0.05),
    "price_diffusion_10s": (3.0, 1000.0), "mean_best_bid_depth": (2.0, 100.0), "mean_best_ask_depth": (2.0, 100.0), "mid_move_rate": (3.0, 0.02),
    "zero_mid_change_ratio": (2.0, 0.02), "market_order_best_removal_rate": (2.0, 0.002), "cancel_best_removal_rate": (2.0, 0.002),
    "limit_order_rate": (1.0, 1.0), "limit_buy_rate": (0.5, 0.5), "limit_sell_rate": (0.5, 0.5), "market_order_rate": (1.0, 0.5),
    "market_buy_rate": (0.5, 0.25), "market_sell_rate": (0.5, 0.25), "cancel_rate": (1.0, 1.0), "cancel_bid_rate": (0.5, 0.5), "cancel_ask_rate": (0.5, 0.5),
}


def market_moments(samples: DataFrame, keys: list[str], order: list[str], interval_s: float) -> DataFrame:
    """The moments of sampled market states (mid, spread, bid_depth, ask_depth, volume) of each series, one row for each key."""
    long = has_long(samples, keys)
    steps = max(1, round(10 / interval_s))
    df = lagged(samples, keys, order, {"_before": ("mid", 1), "_earlier": ("mid", steps)}, long=long)
    df = df.withColumn("r", F.when((F.col("mid") > 0) & (F.col("_before") > 0), F.log("mid") - F.log("_before")))
    df = df.withColumn("_ar", F.abs("r")).withColumn("_step", F.col("mid") - F.col("_before")).withColumn("_far", F.col("mid") - F.col("_earlier"))
    still = F.coalesce(F.avg(F.when(F.col("_step").isNotNull(), F.when(F.abs("_step") < 1e-12, 1.0).otherwise(0.0))), F.lit(0.0))
    r = F.col("r")
    out = df.groupBy(*keys).agg(
        mean(r).alias("return_mean"), variance(r).alias("return_variance"), skewness(r).alias("return_skewness"), kurtosis(r).alias("return_kurtosis"),
        mean(F.col("spread")).alias("mean_spread"),
        correlation(F.col("volume").cast("double"), F.col("_ar")).alias("volume_volatility_corr"), variance(F.col("_far")).alias("price_diffusion_10s"),
        mean(F.col("bid_depth")).alias("mean_best_bid_depth"), mean(F.col("ask_depth")).alias("mean_best_ask_depth"),
        still.alias("zero_mid_change_ratio"), (1 - still).alias("mid_move_rate"),
    )
    out = out.join(percentiles(df, keys, "spread", {"spread_p90": 0.9, "spread_p95": 0.95}, long=long), keys)
    first = autocorrelations(df, keys, order, "r", [1], "return_acf_lag", long=long)
    later = autocorrelations(df, keys, order, "_ar", [1, 2, 5, 10, 25, 50, 100], "abs_return_acf_lag", long=long)
    return out.join(first, keys, "left").join(later, keys, "left").fillna(0.0)
