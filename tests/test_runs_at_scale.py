"""Runs of markets as units of work: spread over tasks, in few batches, and run once however often their samples are read."""

import pytest
from pyspark.sql import functions as F

from orderlens.operators import hawkes, simulate

CONFIG = simulate.MarketConfig(books=2, seconds=0.1, sample_ms=25, shock_s=0.05, shock_multiple=1.0, shocked=(0,))


def runs(spark, n):
    return spark.range(n).select(F.col("id").alias("run_id"), F.lit(0).cast("long").alias("book_id"), (F.col("id") * 7919 + 17).alias("seed"))


def test_runs_are_dealt_over_tasks(spark):
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks(simulate.run_markets(runs(spark, 60), CONFIG)) > 4
    assert tasks(hawkes.hawkes_events(runs(spark, 60), hawkes.HawkesConfig(), 0.1)) > 4
    assert hawkes.dealt(runs(spark, 100), "run_id", most=2).rdd.getNumPartitions() == 50


def test_rows_are_those_of_each_run(spark):
    """Batches go over runs, also where one ends inside of a chunk."""
    got = sorted(tuple(r) for r in simulate.run_markets(runs(spark, 12), CONFIG, chunk=7).collect())
    want = sorted(row for i in range(12) for b in range(2) for row in simulate.simulate(i, i * 7919 + 17, CONFIG, range(b, b + 1)))
    assert got == want


@pytest.mark.parametrize("summary", [lambda s: simulate.run_moments(s, CONFIG), lambda s: simulate.shock_metrics(s, (0,))], ids=["moments", "shocks"])
def test_samples_are_made_once(spark, summary):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    samples = simulate.run_markets(runs(spark, 3), CONFIG)
    n = samples.count()
    assert summary(samples.mapInArrow(counted, simulate.SAMPLE_SCHEMA)).count() > 0
    assert made.value == n
