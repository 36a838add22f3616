"""Prefix scan by range: the rows of the bucketed and the plain scan, hot groups, plans."""

import random

import pytest
from pyspark.sql import functions as F

from minimus.operators.admission import single_flight
from minimus.operators.asof import preceding_value
from minimus.operators.range_scan import PART, _walk, history_by_range, scan_preceding, single_flight_by_range
from minimus.plans.history import simplify_history
from minimus.session import scratch_path
from minimus.sources.messages import chat_log, read_messages


@pytest.fixture(scope="module")
def log(spark, sf):
    path = scratch_path(spark, "stored-log")
    chat_log(spark, sf).write.parquet(path)
    return read_messages(spark, path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_history_and_admission(log):
    want = simplify_history(log, bucket_turns=None)
    assert rows(history_by_range(log).select(want.columns)) == rows(want)
    want = single_flight(log, bucket_size=None)
    assert rows(single_flight_by_range(log).select(want.columns)) == rows(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_plain_window(spark, seed):
    """Groups over many tasks, tasks of many groups, null groups, null values, few anchors."""
    rng = random.Random(seed)
    data = []
    for g in [None, *range(12)]:
        for o in range(rng.choice([1, 3, 400])):
            data.append((g, o, rng.random() < rng.choice([0.02, 0.5]), rng.choice([None, f"v{o}"])))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g long, o long, a boolean, v string")
    got = scan_preceding(df, "g", "o", F.col("a"), F.col("v"), "out")
    plain = preceding_value(df.withColumn("s", F.struct("v")), "g", "o", F.col("a"), "s", "x").select("g", "o", "a", "v", "x.v")
    assert rows(got) == rows(plain)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # batches within a task
    try:
        assert rows(scan_preceding(df, "g", "o", F.col("a"), F.col("v"), "out")) == rows(plain)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_hot_minute_is_split(spark):
    """One user with all events in one minute: the rows are spread over the tasks."""
    df = spark.range(200_000).select(F.lit(1).cast("long").alias("g"), F.col("id").alias("o"),
                                     (F.col("id") % 50_000 == 7).alias("a"))
    got = scan_preceding(df, "g", "o", F.col("a"), F.col("o"), "last")
    wrong = got.where(~F.col("last").eqNullSafe(F.when(F.col("o") > 7, F.floor((F.col("o") - 8) / 50_000) * 50_000 + 7)))
    assert wrong.count() == 0 and got.count() == 200_000
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = (df.repartitionByRange(n, "g", "o").groupBy(F.spark_partition_id().alias(PART)).count().collect())
    assert len(sizes) == n and max(r["count"] for r in sizes) < 2 * 200_000 / n


def test_exchanges(spark, log):
    """One scan and one exchange write the stage; what reads it only broadcasts the edges."""
    df = log.select("conv_id", "turn", "role", F.lit(True).alias("__flag"), F.col("role").alias("__value"))
    first = df.repartitionByRange(8, "conv_id", "turn").sortWithinPartitions("conv_id", "turn").mapInArrow(
        _walk("conv_id"), "conv_id long, turn long, role string, __flag boolean, __value string, __local string, __has boolean")
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("FileScan") == 1
    plan = history_by_range(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("BroadcastExchange") == 1 and "Sort" not in plan


def test_empty(log):
    assert history_by_range(log.limit(0)).collect() == []
