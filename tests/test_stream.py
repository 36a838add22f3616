"""Batch = stream, with the log arriving in two micro-batches."""
import pytest
from pyspark.sql import functions as F

from minimus.operators.admission import single_flight
from minimus.plans.history import simplify_history
from minimus.session import scratch_path
from minimus.sources.messages import chat_log
from minimus.streaming.jobs import (history_stream, read_message_stream, run_to_table,
                                    sanitize_stream, single_flight_stream)


@pytest.fixture(scope="module")
def two_batches(spark, sf):
    log = chat_log(spark, sf)
    root = scratch_path(spark, "two-batches")
    log.where(F.col("turn") < 2).coalesce(1).write.parquet(root + "/part=0")
    log.where(F.col("turn") >= 2).coalesce(1).write.parquet(root + "/part=1")
    return log, root


def _stream(spark, root):
    return read_message_stream(spark, root + "/*", files_per_trigger=1)


def test_single_flight_stream(spark, two_batches):
    log, root = two_batches
    got = run_to_table(single_flight_stream(_stream(spark, root)), spark, "t-sf")
    want = single_flight(log).select("conv_id", "turn", "content")
    assert sorted(got.collect()) == sorted(want.collect())


def test_history_stream(spark, two_batches):
    log, root = two_batches
    got = run_to_table(history_stream(_stream(spark, root)), spark, "t-hist")
    want = simplify_history(log)
    cols = ["conv_id", "turn", "simplified_message", "display_ts_ms", "clock"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_sanitize_stream(spark, two_batches):
    log, root = two_batches
    got = run_to_table(sanitize_stream(_stream(spark, root)), spark, "t-san")
    want = sanitize_stream(log)  # the same functions on the batch form
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.count() == log.where("role = 'user'").count() and got.where("NOT level_ok").isEmpty()


def _odd_log(spark):
    import datetime as dt

    from minimus.schema import MESSAGE
    t = dt.datetime(2024, 1, 1, 10)
    rows = [(1, 0, "user", "a 123456", t, "HIGH", None), (1, 1, "user", "b", t + dt.timedelta(hours=3), None, None),
            (1, 2, "assistant", "c", t + dt.timedelta(hours=6), None, "s"),
            (2, 0, "assistant", "first", t, None, "own clock"), (2, 1, "assistant", "x", t, None, None),
            (2, 2, "user", "y", t + dt.timedelta(hours=9), "low", None),
            (2, 3, "assistant", "z", t + dt.timedelta(hours=12), None, "")]
    return spark.createDataFrame(rows, MESSAGE)


def test_long_pauses_and_unknown_levels(spark):
    """Micro-batches hours apart, one row each: the stream equals the batch."""
    log = _odd_log(spark)
    root = scratch_path(spark, "pauses")
    for i, r in enumerate(sorted(log.collect(), key=lambda r: (r.turn, r.conv_id))):
        log.where((F.col("conv_id") == r.conv_id) & (F.col("turn") == r.turn)).coalesce(1).write.parquet(f"{root}/part={i}")
    got = run_to_table(single_flight_stream(_stream(spark, root)), spark, "t-sf2")
    assert sorted(got.collect()) == sorted(single_flight(log).select("conv_id", "turn", "content").collect())
    got = run_to_table(history_stream(_stream(spark, root)), spark, "t-hist2")
    cols = ["conv_id", "turn", "simplified_message", "display_ts_ms", "clock"]
    assert sorted(got.select(*cols).collect()) == sorted(simplify_history(log).select(*cols).collect())
    got = run_to_table(sanitize_stream(_stream(spark, root)), spark, "t-san2", partition_by="level_ok")
    rows = {(r.conv_id, r.turn): (r.level, r.level_ok, r.masked) for r in got.collect()}
    assert rows == {(1, 0): ("HIGH", False, "a <NUM>"), (1, 1): ("medium", True, "b"), (2, 2): ("low", True, "y")}


def test_hot_conversation_over_turn_buckets(spark):
    log = spark.range(10_000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 3 == 2, "assistant").otherwise("user").alias("role"), F.lit("t").alias("content"))
    many = single_flight(log, bucket_size=512).select("turn")
    one = single_flight(log, bucket_size=None).select("turn")
    assert sorted(many.collect()) == sorted(one.collect()) and one.count() > 3000


def test_conversations_over_files_out_of_order(spark, sf, monkeypatch):
    """The registered jobs on a log whose files hold later turns first, a file a trigger."""
    from functools import partial

    from minimus.plans import queries_stream as Q
    turn = F.col("id")
    log = spark.range(10_000).select(
        F.lit(1).cast("long").alias("conv_id"), turn.alias("turn"),
        F.when(turn % 3 == 2, "assistant").otherwise("user").alias("role"), F.lit("t").alias("content"),
        F.timestamp_add("SECOND", 7 * turn, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"),
        F.lit(None).cast("string").alias("simplify"), F.lit("s").alias("simplified_message"))
    log = log.unionByName(log.where("turn < 10").withColumn("conv_id", F.lit(2).cast("long")))
    want = single_flight(log).select("conv_id", "turn", "content").collect()
    cols = ["conv_id", "turn", "simplified_message", "display_ts_ms", "clock"]
    history = simplify_history(log).select(*cols).collect()
    monkeypatch.setattr(Q, "chat_log", lambda *_: log.repartitionByRange(16, F.desc("turn")))
    monkeypatch.setattr(Q, "read_message_stream", partial(read_message_stream, files_per_trigger=1))
    assert sorted(Q.q_stream_single_flight(spark, sf).collect()) == sorted(want)
    assert sorted(Q.q_stream_history(spark, sf).select(*cols).collect()) == sorted(history)
