"""Sources: empirical distributions, loss targets, book configurations, intensity tables and the opening book, all with fixed schemas."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.market import EVENT_NAMES, canonical, scaled_quantity
from ..functions.stats import MOMENTS
from ..operators.book import OPENING_ASKS, OPENING_BIDS

#: Other names of target columns and of moments; an empty one is dropped.
TARGET_COLUMNS = {"name": ("moment_name", "moment", "metric", "name"), "target": ("target", "value", "empirical"), "weight": ("weight", "w"), "scale_floor": ("scale_floor", "floor", "scale")}
#: Fixed values.
MOMENT_ALIASES = {
    "moment": "", "mean_return": "return_mean", "var_return": "return_variance", "variance_return": "return_variance", "skew_return": "return_skewness", "skewness_return": "return_skewness",
    "kurt_return": "return_kurtosis", "kurtosis_return": "return_kurtosis", "acf_return_lag1": "return_acf_lag1", "acf_abs_return_lag1": "abs_return_acf_lag1", "acf_abs_return_lag2": "abs_return_acf_lag2",
    "acf_abs_return_lag5": "abs_return_acf_lag5", "acf_abs_return_lag10": "abs_return_acf_lag10", "acf_abs_return_lag25": "abs_return_acf_lag25", "acf_abs_return_lag50": "abs_return_acf_lag50",
    "acf_abs_return_lag100": "abs_return_acf_lag100", "diffusion_10s": "price_diffusion_10s", "price_diffusion_coefficient": "price_diffusion_10s", "average_bid_ask_spread": "mean_spread",
    "avg_spread": "mean_spread", "p90_spread": "spread_p90", "p95_spread": "spread_p95",
}


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, trimmed; blank lines and # comments skipped. No inference."""
    df = spark.read.option("header", True).option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def number(c: str | Column, kind: str = "double") -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast(kind)


def distribution(spark: SparkSession, path: str, column: str, least: int) -> DataFrame:
    """Values of a named column (the first if there is no such one), rounded half away from zero; rows that don't parse or are below the least are dropped."""
    df = csv(spark, path)
    name = column if column in df.columns else df.columns[0]
    return df.select(F.round(number(F.col(f"`{name}`"))).cast("long").alias("value")).where(F.col("value") >= least)


def loss_targets(spark: SparkSession, path: str) -> DataFrame:
    """(name, target, weight, scale_floor): headers by alias, names made canonical, empty weights and floors by name, weights of 0 or less dropped."""
    df = csv(spark, path)
    low = {c.lower(): c for c in df.columns}
    found = {k: next((low[a] for a in names if a in low), None) for k, names in TARGET_COLUMNS.items()}
    if not found["name"] or not found["target"]:
        raise ValueError("a table of loss targets needs a name and a target column")
    name = canonical(F.col(found["name"]), MOMENT_ALIASES)
    given = lambda k: number(found[k]) if found[k] else F.lit(None).cast("double")
    default = spark.createDataFrame([(k, *v) for k, v in MOMENTS.items()], "name string, default_weight double, default_floor double")
    df = df.select(name.alias("name"), given("target").alias("target"), given("weight").alias("weight"), given("scale_floor").alias("scale_floor")).where("name is not null and target is not null")
    df = df.join(F.broadcast(default), "name", "left")  # one row for each name of a moment
    out = df.select("name", "target", F.coalesce("weight", "default_weight", F.lit(1.0)).alias("weight"), F.coalesce("scale_floor", "default_floor", F.lit(1e-6)).alias("scale_floor")).where("weight > 0")
    if out.isEmpty():
        raise ValueError("a table of loss targets needs a row that parses and has a weight above 0")
    return out


BOOK_FIELDS = "book_id int, symbol string, data_dir string, hawkes_rates_file string, fundamental_price_ticks double, initial_best_bid_ticks int, initial_best_ask_ticks int, initial_best_bid_depth int, initial_best_ask_depth int, beta double, basket_weight double, market_maker_quote_quantity int, target_spread_ticks int"


def book_configs(spark: SparkSession, path: str) -> DataFrame:
    """Strict: every field has to parse."""
    df = csv(spark, path)
    wanted = [f.split() for f in BOOK_FIELDS.split(", ")]
    if missing := [n for n, _ in wanted if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    improve = number("quote_improvement_probability") if "quote_improvement_probability" in df.columns else F.lit(0.05)
    return df.select(*[F.col(n).cast(k).alias(n) for n, k in wanted], improve.alias("quote_improvement_probability"))


def book_violations(books: DataFrame) -> DataFrame:
    """(rule, book_id) for each rule that a configuration breaks; none is valid."""
    opening = [F.col(c) > 0 for c in ("initial_best_bid_ticks", "initial_best_ask_ticks", "initial_best_bid_depth", "initial_best_ask_depth")]
    some = sum((o.cast("int") for o in opening), F.lit(0))
    rules = {
        "fundamental": ~(F.col("fundamental_price_ticks") > 0), "beta": ~(F.col("beta") != 0), "weight": ~(F.col("basket_weight") >= 0), "probability": ~F.col("quote_improvement_probability").between(0, 1),
        "opening": (some > 0) & ((some < 4) | (F.col("initial_best_ask_ticks") <= F.col("initial_best_bid_ticks"))), "spread": ~(F.col("target_spread_ticks") > 0),
    }
    found = books.select("book_id", F.explode(F.filter(F.array(*[F.when(bad | bad.isNull(), F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())).alias("rule"))
    twice = books.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("book_id").alias("book_id")).where("n > 1").select("book_id", F.lit("symbol").alias("rule"))
    ids = books.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("book_id").alias("d"), F.min("book_id").alias("low"), F.max("book_id").alias("high"))
    gaps = ids.where("n > 0 and (n <> d or low <> 0 or high <> n - 1)").select(F.lit(None).cast("int").alias("book_id"), F.lit("ids").alias("rule"))
    return found.unionByName(twice).unionByName(gaps)


def hawkes_rates(spark: SparkSession, path: str) -> tuple[float, ...]:
    """Base rates of the six event types; each has to be there once and not below 0."""
    df = csv(spark, path).select(F.col("event_type"), number("configured_mu").alias("mu")).where(F.col("event_type").isin(*EVENT_NAMES))
    # At most a handful of rows pass for valid.
    rows = df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("mu").alias("mu"), F.count_if(F.col("mu").isNull()).alias("bad")).collect()
    found = {r["event_type"]: r for r in rows}
    if set(found) != set(EVENT_NAMES) or any(r["n"] > 1 or r["bad"] or r["mu"] < 0 for r in rows):
        raise ValueError("a rate table needs each of the six event types once, with a rate of 0 or more")
    return tuple(found[n]["mu"] for n in EVENT_NAMES)


def opening_book(spark: SparkSession, depth_scale: float = 1.0) -> DataFrame:
    """(side, price, quantity) of the opening book."""
    rows = [(1, p, q) for p, q in OPENING_BIDS.items()] + [(-1, p, q) for p, q in OPENING_ASKS.items()]
    return spark.createDataFrame(rows, "side int, price long, quantity long").withColumn("quantity", scaled_quantity(F.col("quantity").cast("double"), depth_scale))


def calibrated_book(books: DataFrame, tick: int, levels: int = 10) -> DataFrame:
    """Levels around each book's opening quotes, with the opening depth at each."""
    side = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("initial_best_bid_ticks").alias("best"), F.col("initial_best_bid_depth").alias("depth")), F.struct(F.lit(-1).alias("side"), F.col("initial_best_ask_ticks").alias("best"), F.col("initial_best_ask_depth").alias("depth"))))
    df = books.select("book_id", side.alias("s")).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    return df.select("book_id", "s.side", (F.col("s.best") - F.col("s.side") * F.col("level") * tick).alias("price"), F.col("s.depth").alias("quantity")).where("price > 0 and quantity > 0")


#: What each type of event draws, and the file that says how it is distributed.
DISTRIBUTIONS = {
    "limit_buy_quantity": ("quantity", 25), "limit_sell_quantity": ("quantity", 25), "market_buy_quantity": ("quantity", 25), "market_sell_quantity": ("quantity", 25), "cancel_bid_quantity": ("quantity", 25),
    "cancel_ask_quantity": ("quantity", 25), "limit_buy_distance": ("distance_ticks", 0), "limit_sell_distance": ("distance_ticks", 0), "cancel_bid_distance": ("distance_ticks", 0), "cancel_ask_distance": ("distance_ticks", 0),
}


def data_paths(folder: str) -> dict[str, str]:
    """The ten distribution files of a folder."""
    return {name: f"{folder}/{name}_distribution.csv" for name in DISTRIBUTIONS}


def drawn_values(spark: SparkSession, folder: str) -> dict[str, tuple[tuple[int, ...], ...]]:
    """quantities and distances of a run, from a folder's files: the distinct values, each as likely as the others. A file without any is an error."""
    found = {}
    for name, path in data_paths(folder).items():
        column, least = DISTRIBUTIONS[name]
        # A distribution has as many rows as there are distinct values in ticks or shares.
        values = tuple(r["value"] for r in distribution(spark, path, column, least).distinct().orderBy("value").collect())
        if not values:
            raise ValueError(f"no values in {path}")
        found[name] = values if len(values) != 2 else (*values, *values)
    names = list(DISTRIBUTIONS)
    return {"quantities": tuple(found[n] for n in names[:6]), "distances": tuple(found[n] for n in names[6:])}


def resolved_books(spark: SparkSession, path: str | None, count: int, fundamental: float = 2203550.0, beta: float = 1.0, quantity: int = 100, spread: int = 2) -> DataFrame:
    """Books of a configuration file, checked; or, without one, as many clones of a default book as asked for."""
    if path is not None:
        books = book_configs(spark, path)
        faults = [f"{r['rule']} of book {r['book_id']}" for r in book_violations(books).limit(20).collect()]
        if faults:
            raise ValueError("book configuration: " + ", ".join(faults))
        return books
    if count < 1:
        raise ValueError("a run needs one book at least")
    ids = spark.range(count).select(F.col("id").cast("int").alias("book_id"))
    plain = {"data_dir": "", "hawkes_rates_file": "", "fundamental_price_ticks": fundamental, "initial_best_bid_ticks": 0, "initial_best_ask_ticks": 0, "initial_best_bid_depth": 0, "initial_best_ask_depth": 0, "beta": beta, "basket_weight": 1.0, "market_maker_quote_quantity": quantity, "target_spread_ticks": spread}
    kinds = dict(f.split() for f in BOOK_FIELDS.split(", "))
    out = ids.select("book_id", F.concat(F.lit("BOOK"), F.col("book_id")).alias("symbol"), *[F.lit(v).cast(kinds[k]).alias(k) for k, v in plain.items()], F.lit(0.05).alias("quote_improvement_probability"))
    return out.select(*kinds, "quote_improvement_probability")


def process_of(spark: SparkSession, book_id: int, seed: int, rates: str | None):
    """The point process of a book: base rates from its file if there is one, and a seed of its own."""
    from ..functions.rng import MASK, Stream
    from ..operators.hawkes import HawkesConfig

    config = HawkesConfig(mu=hawkes_rates(spark, rates)) if rates else HawkesConfig()
    return config, Stream((seed ^ (book_id + 1) * 0x9E3779B97F4A7C15) & MASK).next()


@dataclass
class RunConfig:
    profile: str = "debug"
    seconds: float = 5.0
    window_ms: int = 10
    makers: int = 3
    momentum: int = 600
    informed: int = 290
    institutional: int = 10
    scale: float = 1.0
    seed: int = 1
    output: str = "results"


PROFILES = {
    "debug": {},
    "baseline": {"seconds": 600.0, "momentum": 6000, "informed": 2900, "institutional": 100},
    "scale10": {"seconds": 600.0, "momentum": 60_000, "informed": 29_000, "institutional": 1000, "scale": 10.0},
}


def run_config(args: list[str]) -> RunConfig:
    """A named profile, then overrides, in any order."""
    parser = argparse.ArgumentParser(prog="orderlens")
    parser.add_argument("--profile", choices=sorted(PROFILES), default="debug")
    for f in fields(RunConfig):
        if f.name != "profile":
            parser.add_argument(f"--{f.name.replace('_', '-')}", type={"int": int, "float": float, "str": str}[f.type], default=None)
    given = {k: v for k, v in vars(parser.parse_args(args)).items() if v is not None}
    config = RunConfig(**(PROFILES[given["profile"]] | given))
    faults = {
        "seconds and window_ms have to be positive": config.seconds <= 0 or config.window_ms <= 0, "seconds has to be finite and under 10^9": not config.seconds < 1e9, "a window has to fit into the run": config.window_ms / 1000 > config.seconds,
        "counts can't be below 0": min(config.makers, config.momentum, config.informed, config.institutional) < 0, "the scale has to be positive": not config.scale > 0, "the seed has to fit into 64 bits": not 0 <= config.seed < 1 << 64, "the output needs a name": not config.output,
    }
    if wrong := [text for text, bad in faults.items() if bad]:
        parser.error("; ".join(wrong))
    return config


@dataclass(frozen=True)
class WindowSettings:
    """What a run in fixed windows goes by: whole microseconds, and agents before the scale multiplies them."""

    seconds: float
    window_us: int
    makers: int
    momentum: int
    informed: int
    institutional: int
    scale: int


def windowed_of(config: RunConfig) -> WindowSettings:
    """Milliseconds become microseconds, whole numbers stay whole."""
    unscaled = lambda n: max(0, round(n / max(1.0, config.scale)))
    return WindowSettings(config.seconds, config.window_ms * 1000, max(0, config.makers), unscaled(config.momentum), unscaled(config.informed), unscaled(config.institutional), max(1, round(config.scale)))
