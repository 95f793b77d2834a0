"""Exactly-once tables, folds and the hedge join: any cut into micro-batches, failures and repeats included, gives what the batch gives."""

import random

import pytest
from pyspark.sql import functions as F

from orderlens.operators import merging, results
from orderlens.streaming import flows, ledgers


def source(spark, tmp_path, rows, schema, parts, name):
    """A stream of one file a micro-batch, in the order of its parts."""
    for i in range(parts):
        spark.createDataFrame(rows[len(rows) * i // parts : len(rows) * (i + 1) // parts], schema).coalesce(1).write.parquet(str(tmp_path / f"{name}{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}*"))


def drain(writer, tmp_path, name):
    writer.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c_{name}")).start().awaitTermination(180)


def test_batches_count_once(spark, tmp_path):
    rows = [(i, i * i) for i in range(100)]
    stream = source(spark, tmp_path, rows, "k long, v long", 5, "in")
    ledger = ledgers.BatchLedger(spark, str(tmp_path / "out"))
    failures = []

    def sometimes(batch, batch_id):
        if batch_id == 2 and not failures:
            failures.append(batch_id)
            batch.write.mode("overwrite").parquet(ledger._data(batch_id))  # files are there, the entry isn't
            raise RuntimeError("lost before the entry")
        ledger.append(batch, batch_id)
        ledger.append(batch, batch_id)  # a repeat

    with pytest.raises(Exception, match="lost before the entry"):
        drain(stream.writeStream.foreachBatch(sometimes), tmp_path, "once")
    assert ledger.entered() == [0, 1] and ledger.read().count() == 40
    drain(stream.writeStream.foreachBatch(sometimes), tmp_path, "once")
    assert ledger.entered() == [0, 1, 2, 3, 4] and sorted(map(tuple, ledger.read().collect())) == rows
    assert ledgers.BatchLedger(spark, str(tmp_path / "none")).read() is None


@pytest.mark.parametrize("parts", [1, 6])
def test_samples_and_moments_fold(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = [(i % 3, i, 1e6 + rng.gauss(0, 1e-3)) for i in range(600)]
    schema = "book_id long, t long, x double"
    stream, whole = source(spark, tmp_path, rows, schema, parts, "in"), spark.createDataFrame(rows, schema)
    states, samples = (ledgers.BatchLedger(spark, str(tmp_path / n)) for n in ("moments", "samples"))

    def moments(before, batch):
        new = merging.moment_states(batch, ["book_id"], ["t"], "x")
        return merging.merged_moments(new if before is None else before.unionByName(new), ["book_id"])

    def sample(before, batch):
        return merging.bottom_k(batch if before is None else before.unionByName(batch), ["book_id"], "t", 10, 4)

    drain(stream.writeStream.foreachBatch(states.folding(moments)), tmp_path, "m")
    drain(stream.writeStream.foreachBatch(samples.folding(sample)), tmp_path, "s")
    assert sorted(map(tuple, samples.latest().select(*whole.columns).collect())) == sorted(map(tuple, merging.bottom_k(whole, ["book_id"], "t", 10, 4).collect()))
    done = lambda s: {r["book_id"]: r for r in merging.finished_moments(s, ["book_id"]).collect()}
    got, want = done(states.latest()), done(merging.moment_states(whole, ["book_id"], ["t"], "x"))
    assert got.keys() == want.keys() == {0, 1, 2}
    for b in got:
        assert got[b]["n"] == 200 and all(abs(got[b][c] / want[b][c] - 1) < 1e-5 for c in ("variance", "kurtosis")) and abs(got[b]["acf1"] - want[b]["acf1"]) < 1e-5
    assert len(list((tmp_path / "moments").glob("batch=*"))) <= 2


@pytest.mark.parametrize(("n_pending", "n_fills"), [(1, 1), (4, 7), (1, 5)])
def test_hedges_in_any_micro_batching(spark, tmp_path, n_pending, n_fills):
    rng = random.Random(3)
    pending = [(s, rng.choice([-1, 1]) * rng.randrange(1, 100), 1_000_000_000 + s) for s in range(60)] + [(60, 0, 1_000_000_000)]
    fills = [(rng.randrange(70), rng.choice([-1, 1]) * rng.randrange(1, 40), 1_000_000_000 + i) for i in range(300)]
    p = source(spark, tmp_path, pending, "sequence long, quantity long, time_ns long", n_pending, "p")
    f = source(spark, tmp_path, fills, "sequence long, filled long, time_ns long", n_fills, "f")
    out = ledgers.hedge_ledger(p, f, "1 hour")
    ledger = ledgers.BatchLedger(spark, str(tmp_path / "out"))
    # The order of updates is that of the batches.
    drain(out.writeStream.outputMode("update").foreachBatch(lambda batch, i: ledger.append(batch.withColumn("batch", F.lit(i)), i)), tmp_path, "h")
    rows = ledger.read().collect()
    latest = {r["sequence"]: r for r in sorted(rows, key=lambda r: r["batch"])}
    want = results.matched_hedges(spark.createDataFrame(pending, "sequence long, quantity long, time_ns long"), spark.createDataFrame(fills, "sequence long, filled long, time_ns long")).collect()
    assert latest.keys() == {r["sequence"] for r in want}
    for r in want:
        got = latest[r["sequence"]]
        capped = max(-abs(r["quantity"]), min(abs(r["quantity"]), r["filled"]))
        assert (got["quantity"], got["left"], got["filled"]) == (r["quantity"], r["left"], capped if r["quantity"] else 0)
        assert got["status"] == ("filled" if r["left"] == 0 else "open")


def test_old_hedges_expire(spark, tmp_path):
    second = 1_000_000_000
    pending = [(1, 50, second), (2, -50, 2 * second), (3, 10, 500 * second), (4, 10, 900 * second)]
    fills = [(1, 20, 2 * second), (9, 5, 3 * second), (3, 10, 501 * second), (4, 1, 901 * second)]
    p = source(spark, tmp_path, pending, "sequence long, quantity long, time_ns long", 4, "p")
    f = source(spark, tmp_path, fills, "sequence long, filled long, time_ns long", 4, "f")
    rows = []
    drain(ledgers.hedge_ledger(p, f, "60 seconds", "0 seconds").writeStream.outputMode("update").foreachBatch(lambda batch, i: rows.extend((i, *r) for r in batch.collect())), tmp_path, "e")
    last = {r[1]: r[2:] for r in sorted(rows)}
    assert last[1] == (50, 20, 30, "expired") and last[2] == (-50, 0, -50, "expired") and last[3] == (10, 10, 0, "filled") and last[4] == (10, 1, 9, "open") and 9 not in last


def test_event_time_waits_for_the_slowest_source(spark, tmp_path):
    second = 1_000_000_000
    fast = source(spark, tmp_path, [(1, i * 100 * second, 5, 1) for i in range(1, 9)], "book_id long, arrival_ns long, quantity long, side int", 4, "a")
    slow = source(spark, tmp_path, [(1, i * 10 * second, 7, -1) for i in range(1, 9)], "book_id long, arrival_ns long, quantity long, side int", 4, "b")
    rows = []
    both = flows.tumbling_flow(ledgers.several_sources([fast, slow], "arrival_ns", "0 seconds"), "10 seconds")
    drain(both.writeStream.outputMode("append").foreachBatch(lambda batch, i: rows.extend(batch.collect())), tmp_path, "w")
    assert max(r["end"].timestamp() for r in rows) <= 80 and sum(r["sold"] for r in rows) == 7 * 7
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")
    try:
        with pytest.raises(ValueError, match="must be min"):
            ledgers.several_sources([fast, slow], "arrival_ns", "0 seconds")
    finally:
        spark.conf.unset("spark.sql.streaming.multipleWatermarkPolicy")
