"""Samples, moments, digests and replica checks that merge: of parts, in any partitioning, what they are of the whole."""

import random

import pytest
from pyspark.sql import functions as F

from orderlens.functions import rng, windows
from orderlens.operators import merging

P = merging.MODULI


def test_bottom_k_of_a_hot_bucket(spark):
    """A million rows in one bucket; every stage keeps k of a part, and no part has many more rows than asked for."""
    df = spark.range(1_000_000, numPartitions=8).select(F.col("id").alias("event_id"), F.when(F.col("id") % 1000 == 0, F.col("id") % 7).otherwise(-1).alias("kind"))
    draw = rng.draw(F.col("event_id") + 3, F.lit(1))
    for most in (10_000, 100_000):
        got = {(r["kind"], r["event_id"]) for r in merging.bottom_k(df, ["kind"], "event_id", 40, 3, most).collect()}
        want = set()
        for kind in (-1, *range(7)):
            want |= {(kind, r["event_id"]) for r in df.where(F.col("kind") == kind).orderBy(draw, "event_id").limit(40).collect()}
        assert got == want
    parts = -(-999_000 // 10_000)
    largest = df.where("kind = -1").groupBy(F.pmod(F.xxhash64("event_id"), F.lit(parts))).count().agg(F.max("count")).first()[0]
    assert largest < 12_000


def test_samples_of_batches_merge(spark):
    df = spark.range(5000).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("kind"))
    whole = sorted(map(tuple, merging.bottom_k(df, ["kind"], "event_id", 17, 9).collect()))
    held = None
    for low, high in ((0, 10), (10, 3000), (3000, 5000)):
        batch = df.where(F.col("event_id").between(low, high - 1))
        held = merging.bottom_k(batch if held is None else held.unionByName(batch), ["kind"], "event_id", 17, 9, most=50)
    assert sorted(map(tuple, held.collect())) == whole


@pytest.mark.parametrize("fan", [4096, 3])
def test_moments_merge(spark, fan):
    """A mean of 10^6 with deviations of 10^-3, parts of 1 to 400 values, against sums about the mean."""
    rng_ = random.Random(6)
    rows, part = [], 0
    for i in range(3000):
        part += rng_.random() < 0.02
        rows.append((i % 2, i, part, 1e6 + rng_.gauss(0, 1e-3) if i % 2 else rng_.expovariate(1)))
    df = spark.createDataFrame([*rows, (5, 0, 0, 4.0), (6, 0, 0, None), (None, 0, 0, 2.0), (None, 1, 1, 3.0)], "book_id long, t long, part long, x double").repartition(6)
    got = {r["book_id"]: r for r in merging.finished_moments(merging.merged_moments(merging.moment_states(df, ["book_id"], ["t"], "x", F.col("part")), ["book_id"], fan), ["book_id"]).collect()}
    for b in (0, 1):
        base = 1e6 if b else 0.0
        x = [r[3] - base for r in rows if r[0] == b]
        n, m = len(x), sum(x) / len(x)
        m2, m4 = (sum((v - m) ** p for v in x) for p in (2, 4))
        c = sum((x[i] - m) * (x[i - 1] - m) for i in range(1, n))
        r = got[b]
        assert r["n"] == n and abs(r["mean"] - base - m) < 1e-8 and abs(r["variance"] / (m2 / n) - 1) < 1e-5 and abs(r["kurtosis"] / (n * m4 / m2**2) - 1) < 1e-4 and abs(r["acf1"] - c / m2) < 1e-5
    assert (got[5]["n"], got[5]["variance"], got[5]["acf1"]) == (1, 0.0, 0.0) and 6 not in got and (got[None]["n"], got[None]["variance"]) == (2, 0.25)


def fold(values):
    out = []
    for p, a, b in P:
        h = 0
        for row in values:
            v = 0
            for c in row:
                v = (v * a + c % p) % p
            h = (h * b + v) % p
        out.append(h)
    return out[0] << 31 | out[1]


@pytest.mark.parametrize("parts", [1, 7, 64])
@pytest.mark.parametrize("limit", [2_000_000, 50])
def test_tapes_in_any_partitioning(spark, parts, limit, monkeypatch):
    monkeypatch.setattr(windows, "LONG", limit)
    rng_ = random.Random(8)
    rows = [(rng_.choice([1, 2, 2, 2, None]), rng_.randrange(300), i, rng_.randrange(-(1 << 40), 1 << 40)) for i in range(1500)]
    df = spark.createDataFrame(rows, "book_id long, t long, id long, q long").repartition(parts)
    got = {r["book_id"]: (r["n"], r["d"]) for r in merging.tape_digests(df, ["book_id"], ["t", "id"], ["id", "q"], "n", "d", 10 if parts == 7 else None).collect()}
    for b in (1, 2, None):
        tape = sorted((r for r in rows if r[0] == b), key=lambda r: r[1:3])
        assert got[b] == (len(tape), fold([(r[2], r[3]) for r in tape]))
    books = merging.joined_tapes(merging.tape_parts(df, ["book_id"], ["t", "id"], ["id", "q"]), ["book_id"], "_slice")
    whole = merging.joined_tapes(books, [], "book_id")
    tape = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:3]))
    assert whole.select(merging.tape_digest(whole)).first()[0] == fold([(r[2], r[3]) for r in tape])
    swapped = df.withColumn("t", F.when(F.col("id") == 3, F.col("t") + 300).otherwise(F.col("t")))
    changed = {r["book_id"]: r["d"] for r in merging.tape_digests(swapped, ["book_id"], ["t", "id"], ["id", "q"], "n", "d").collect()}
    assert sum(changed[b] != got[b][1] for b in got) == 1


def test_replicas(spark):
    rng_ = random.Random(4)
    rows = [(rng_.randrange(400), rng_.choice(["a", None, "b"])) for _ in range(3000)]
    left = spark.createDataFrame(rows, "k long, v string").repartition(5)
    right = spark.createDataFrame([*rows[5:], (1, "new"), (1, "new"), rows[9]], "k long, v string")
    for each in (10_000, 20):
        got = sorted(map(str, merging.replica_difference(left, right, ["k", "v"], each).collect()))
        want = left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))
        assert got == sorted(map(str, want.collect()))
    assert merging.replica_difference(left, left, ["k", "v"]).count() == 0 and merging.replica_difference(left.limit(0), left.limit(0), ["k", "v"]).count() == 0
