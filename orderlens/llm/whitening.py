"""Embedding whitening: principal components of the whole table by merged covariances, one projection per row and component.

Each partition turns its rows into a state (count, sums, mean, scatter about its own mean); Chan's pairwise formula merges states in
a treeReduce, so that nothing but one state of d x d doubles per branch moves; eigh runs on the driver, which holds d x d doubles however
many rows there are. A second pass over the whitened rows merges their states the same way and gives the largest entry of covariance minus identity.

Defined results: null vectors, empty ones and those with null or non-finite entries are dropped; of vectors of several lengths the most frequent
length stays (of ties the longer). Repeated rows and ids count each time. Entries are clipped at +-2^40. A component without variance (one row, copies of one row, fewer rows
than dimensions) has whitened 0.0 and doesn't count in the identity error; an empty table gives no rows. A deviation that no long holds is null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Branches of the merge tree.
FAN = 8

#: count, exact sums, mean and scatter about the mean.
State = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def state_of(x: np.ndarray) -> State:
    """x has a row for each vector; whole numbers are summed exactly."""
    sums = x.sum(axis=0)
    mean = sums / len(x)
    centred = x - mean
    return len(x), sums, mean, centred.T @ centred


def merged(a: State, b: State) -> State:
    """Chan's formula: scatters add up, with the outer product of the means' difference."""
    n = a[0] + b[0]
    gap = b[2] - a[2]
    return n, a[1] + b[1], a[2] + gap * (b[0] / n), a[3] + b[3] + np.outer(gap, gap) * (a[0] * b[0] / n)


def tree_state(df: DataFrame, rows_of: Callable[[pd.DataFrame], np.ndarray]) -> State:
    """The state of all rows of df, of which there are some."""

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = None
        for batch in batches:
            if len(batch):
                part = state_of(rows_of(batch))
                whole = part if whole is None else merged(whole, part)
        if whole is not None:
            n, sums, mean, scatter = whole
            yield pd.DataFrame({"n": [n], "kind": [sums.dtype.str], "sums": [sums.tobytes()], "mean": [mean.tobytes()], "scatter": [scatter.tobytes()]})

    found = df.mapInPandas(states, "n long, kind string, sums binary, mean binary, scatter binary").rdd.map(
        lambda r: (r[0], np.frombuffer(r[2], r[1]), np.frombuffer(r[3]), np.frombuffer(r[4]).reshape(len(r[3]) // 8, -1))
    )
    return found.treeReduce(merged, max(2, math.ceil(math.log(max(2, found.getNumPartitions()), FAN))))


def whole_numbers(vectors: pd.Series) -> np.ndarray:
    """floor(64 c) of each entry; the offset is added where it matters."""
    scaled = np.floor(np.vstack(vectors.to_numpy()).astype(np.float64) * SCALE)
    return np.clip(scaled, -(2.0**40), 2.0**40).astype(np.int64)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame | None:
    """id and vector (doubles) of the rows that take part; None if there are none."""
    vector = df[vector_col].cast("array<double>")
    entries_fit = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(df[id_col].alias("id"), vector.alias("vector")).where(vector.isNotNull() & (F.size(vector) > 0) & entries_fit)
    lengths = {r[0]: r[1] for r in rows.groupBy(F.size("vector")).count().collect()}
    best = max(lengths, key=lambda k: (lengths[k], k), default=None)
    return rows.where(F.size("vector") == best) if lengths else None


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """A row for each usable row and component, by falling share of the variance: id, component, n, deviation, whitened, explained, identity_error."""
    rows = usable(df, id_col, vector_col)
    kind = df.schema[id_col].dataType.simpleString()
    if rows is None:
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    n, sums, _, scatter = tree_state(rows, lambda b: whole_numbers(b["vector"]))
    values, vectors = np.linalg.eigh(scatter / n)
    order = np.argsort(values)[::-1][:components]
    top, trace = values[order], float(values.sum())
    varied = top > max(values.max(), 0.0) * len(values) * np.finfo(float).eps * 4
    weights = np.where(varied, vectors[:, order] / np.sqrt(np.where(varied, top, 1.0)), 0.0)
    centre = sums / n

    def projected(batch: pd.DataFrame) -> np.ndarray:
        return (whole_numbers(batch["vector"]) - centre) @ weights

    def deviations(x: np.ndarray) -> list[int | None]:
        most = max(abs(int(n * v - s)) for v, s in zip((*x.min(axis=0).tolist(), *x.max(axis=0).tolist()), (*sums.tolist(), *sums.tolist())))
        if most * most * x.shape[1] < 1 << 63:
            return ((n * x - sums) ** 2).sum(axis=1).tolist()
        exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist())) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]

    def rows_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = pd.array(deviations(whole_numbers(batch["vector"])), dtype="Int64")
                yield pd.DataFrame({"id": batch["id"], "deviation": far, "whitened": list(projected(batch))})

    check = tree_state(rows, projected)
    off = np.abs(check[3] / n - np.eye(len(order)))[np.ix_(varied, varied)]
    error = float(off.max()) if off.size else 0.0
    shares = F.array(*[F.lit(float(v) / trace if trace > 0 else 0.0) for v in top])
    out = rows.mapInPandas(rows_out, f"id {kind}, deviation long, whitened array<double>").select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
