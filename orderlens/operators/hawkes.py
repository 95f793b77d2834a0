"""A mutually exciting point process of six event types with exponential decay: as whole runs by cluster, event by event, and its intensities."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.rng import MASK, Stream

TYPES = 6
NANO = 1_000_000_000


@dataclass
class HawkesConfig:
    """alpha[i][j] is what an event j adds to intensity i; it decays at rate beta."""

    mu: tuple = (18.0, 18.0, 3.5, 3.5, 28.0, 28.0)
    beta: float = 10.0
    own: float = 0.20
    limit_to_market: float = 0.04
    limit_to_cancel: float = 0.10
    scale: float = 1.0

    def alpha(self) -> np.ndarray:
        out = np.eye(TYPES) * self.own
        for side in (0, 1):
            out[2 + side, side] = self.limit_to_market
            out[4 + side, side] = self.limit_to_cancel
        return out


def clusters(config: HawkesConfig, seed: int, end_s: float) -> tuple[np.ndarray, np.ndarray]:
    """Times in ns and types of all events before the end, by generations.

    Such a process is a cloud of clusters: immigrants of each type come at its base rate, and each event of type j has a Poisson number (mean
    alpha[i][j] / beta) of children of type i, each an exponential time of rate beta later. A generation is drawn at once.
    """
    rng = np.random.default_rng(seed & MASK)
    per_event = np.maximum(config.alpha(), 0.0) / max(1e-6, config.beta)
    base = np.maximum(0.0, config.scale * np.array(config.mu, float)) * end_s
    kinds = np.repeat(np.arange(TYPES), rng.poisson(base))
    times = rng.uniform(0.0, end_s, len(kinds))
    found = [(times, kinds)]
    while len(times):
        children = rng.poisson(per_event[:, kinds])
        of = np.repeat(np.tile(np.arange(len(times)), TYPES), children.ravel())
        kinds = np.repeat(np.arange(TYPES), children.sum(axis=1))
        times = times[of] + rng.exponential(1 / max(1e-6, config.beta), len(of))
        times, kinds = times[times < end_s], kinds[times < end_s]
        found.append((times, kinds))
    times, kinds = np.concatenate([t for t, _ in found]), np.concatenate([k for _, k in found])
    nanos = np.floor(times * NANO + 0.5).astype(np.int64)
    order = np.lexsort((kinds, nanos))
    return nanos[order], kinds[order]


class Arrivals:
    """The same process event by event, for runs in which the state of a market scales the intensities.

    Between events an intensity is a constant base and a decaying rest, so the time to its next event is the earlier of two independent
    clocks, which are drawn by inversion; the rest's clock may never ring. The first clock of all types is the next event, so nothing is rejected.
    Steps are whole nanoseconds, one at least.
    """

    def __init__(self, config: HawkesConfig, seed: int, start_ns: int = 0):
        self.config, self.rng, self.now = config, Stream(seed), start_ns
        self.gain, self.excited = np.maximum(config.alpha(), 0.0), np.zeros(TYPES)

    def next(self, end_ns: int, multipliers: tuple[float, ...] = (1.0,) * TYPES, inclusive: bool = True) -> tuple[int, int] | None:
        """Time and type of the next event up to the end, or none (time stays then)."""
        beta = max(1e-6, self.config.beta)
        first, kind = math.inf, -1
        for i, scale in enumerate(multipliers):
            scale = max(0.0, scale)
            base, rest = scale * max(0.0, self.config.scale * self.config.mu[i]), scale * self.excited[i]
            if base > 0:
                first, kind = min((first, kind), (-math.log(self.rng.uniform()) / base, i))
            if rest > 0 and (left := 1 + beta * math.log(self.rng.uniform()) / rest) > 0:
                first, kind = min((first, kind), (-math.log(left) / beta, i))
        if kind < 0 or first * NANO > end_ns - self.now + 1:
            return None
        at = self.now + max(1, math.floor(first * NANO + 0.5))
        if at > end_ns or at == end_ns and not inclusive:
            return None
        self.excited = self.excited * math.exp(-beta * (at - self.now) / NANO) + self.gain[:, kind]
        self.now = at
        return at, kind

    def until(self, end_ns: int) -> Iterator[tuple[int, int]]:
        while (event := self.next(end_ns)) is not None:
            yield event


def dealt(units: DataFrame, *keys: str, most: int = 1000) -> DataFrame:
    """Units of work by their keys over as many tasks as the session has shuffle partitions, or as hold most units each.

    The number is given, since Spark else joins partitions by their bytes: units are a few numbers each, so that thousands of runs would be one task.
    """
    n = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), units.sparkSession.sparkContext.defaultParallelism, math.ceil(units.count() / most))
    return units.repartition(n, *keys)


def hawkes_events(runs: DataFrame, config: HawkesConfig, end_s: float, chunk: int = 50_000) -> DataFrame:
    """Events of each row (run_id, book_id, seed): a row is a run of its own, and comes in chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                times, kinds = clusters(config, int(row.seed), end_s)
                for start in range(0, len(times), chunk):
                    part = slice(start, start + chunk)
                    n = len(times[part])
                    yield pd.DataFrame({"run_id": row.run_id, "book_id": row.book_id, "sequence": np.arange(start + 1, start + n + 1), "time_ns": times[part], "type": kinds[part]})

    return dealt(runs.select("run_id", "book_id", "seed"), "run_id", "book_id").mapInPandas(run, "run_id long, book_id long, sequence long, time_ns long, type int")
