"""Structured Streaming forms of the per-message operators.

O52 sanitize (stateless): the same Column functions as the batch jobs.
O53 single-flight and O54 simplify history (stateful): one state row per
conversation kept by ``applyInPandasWithState`` -- a busy flag, or the last
user prompt's time. State has no timeout: dropping it after a pause would change
the answers, so it holds one number for each conversation of the log (on a cluster
in the RocksDB state store, on disk). Within a micro-batch a conversation's rows are put in
turn order first; across micro-batches the source is expected to deliver turns in order
(``in_turn_order`` does so for a log at rest, whatever its files).
A conversation's rows of one micro-batch are one frame, so ``files_per_trigger`` bounds
what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.pii import mask_pii
from ..functions.text import clean_text, clock, is_blank, js_trim
from ..operators.asof import TURN_BUCKET, turn_bucket
from ..operators.messages import level_checked
from ..schema import MESSAGE
from ..session import scratch_path, ship_package

FILES_PER_TRIGGER = 64

ADMIT_SCHEMA = "conv_id long, turn long, content string"
ADMIT_STATE = "busy boolean"
HISTORY_SCHEMA = "conv_id long, turn long, simplified_message string, display_ts_ms long"
HISTORY_STATE = "last_user_ms long"


def read_message_stream(spark: SparkSession, path: str,
                        files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    return (spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def sanitize_stream(sdf: DataFrame) -> DataFrame:
    """Trim, drop blank, default the level, clean and mask arriving prompts. Rows
    with an unknown level stay, masked like 'high', with ``level_ok`` false: the sink
    puts them in a folder of their own (quarantine)."""
    t = level_checked(sdf.where((F.col("role") == "user") & ~is_blank("content")))
    return t.select("conv_id", "turn", F.col("simplify").alias("level"), "level_ok",
                    mask_pii(clean_text(js_trim("content")), "simplify").alias("masked"))


def _in_order(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(pdfs)).sort_values("turn", kind="stable").reset_index(drop=True)


def _single_flight(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
    rows = _in_order(pdfs)
    if rows.empty:
        return
    # busy before a row: the row before it (or the state) was a prompt
    busy = (rows["role"] == "user").shift(1, fill_value=bool(state.get[0]) if state.exists else False)
    state.update((bool(rows["role"].iloc[-1] == "user"),))
    yield rows.loc[(rows["role"] == "user") & ~busy].assign(conv_id=key[0])[["conv_id", "turn", "content"]]


def single_flight_stream(sdf: DataFrame) -> DataFrame:
    """Admit a prompt only when its conversation is not waiting for a reply."""
    ship_package(sdf.sparkSession)
    msgs = sdf.where(F.col("role").isin("user", "assistant")).select(
        "conv_id", "turn", "role", "content")
    return msgs.groupBy("conv_id").applyInPandasWithState(
        _single_flight, ADMIT_SCHEMA, ADMIT_STATE, "append",
        GroupStateTimeout.NoTimeout)


def _history(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
    rows = _in_order(pdfs)
    if rows.empty:
        return
    asked = rows["ts_ms"].where(rows["role"] == "user").astype("Int64")
    if state.exists:
        asked = pd.concat([pd.Series([state.get[0]], dtype="Int64"), asked], ignore_index=True).ffill()
        last, before = asked.iloc[-1], asked.iloc[:-1]
    else:
        asked = asked.ffill()
        last, before = asked.iloc[-1], asked.shift(1)
    if pd.notna(last):
        state.update((int(last),))
    rows["display_ts_ms"] = before.fillna(rows["ts_ms"].astype("Int64"))
    shown = rows.loc[(rows["role"] == "assistant") & rows["simplified_message"].notna()]
    yield shown.assign(conv_id=key[0])[["conv_id", "turn", "simplified_message", "display_ts_ms"]]


def history_stream(sdf: DataFrame) -> DataFrame:
    """Simplify-history rows with the clock of the preceding user prompt."""
    from ..functions.text import epoch_millis_ntz
    ship_package(sdf.sparkSession)
    msgs = sdf.where(F.col("role").isin("user", "assistant")).select(
        "conv_id", "turn", "role", epoch_millis_ntz("ts").alias("ts_ms"), "simplified_message")
    out = msgs.groupBy("conv_id").applyInPandasWithState(
        _history, HISTORY_SCHEMA, HISTORY_STATE, "append",
        GroupStateTimeout.NoTimeout)
    shown = F.timestamp_add("MILLISECOND", F.col("display_ts_ms"),
                            F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return out.withColumn("clock", clock(shown))


def in_turn_order(log: DataFrame, spark: SparkSession,
                  bucket_turns: int = TURN_BUCKET) -> tuple[str, Iterable]:
    """(path, deliveries): a folder to stream ``log`` from, and an iterable whose steps put
    the next turn bucket of all conversations there, to be drained before the next step.
    A conversation's rows of one bucket are in one file, so its turns reach the state in
    order wherever the trigger cuts the files."""
    b = "__bucket"
    parts = scratch_path(spark, "chat-log-buckets")
    (log.select(MESSAGE.names).withColumn(b, turn_bucket("turn", bucket_turns).cast("long"))
     .repartition("conv_id", b).write.partitionBy(b).option("maxRecordsPerFile", 0).parquet(parts))
    held = spark.read.schema(StructType([*MESSAGE.fields, StructField(b, LongType())])).parquet(parts)
    buckets = sorted((r[0] for r in held.select(b).distinct().collect()), key=lambda x: (x is not None, x or 0))
    if len(buckets) <= 1:
        return parts, [None]
    path = scratch_path(spark, "chat-log")
    held.limit(0).drop(b).write.parquet(path)

    def deliveries():
        for x in buckets:
            (held.where(F.col(b).eqNullSafe(F.lit(x))).drop(b).repartition("conv_id")
             .write.mode("append").option("maxRecordsPerFile", 0).parquet(path))
            yield x

    return path, deliveries()


def run_to_table(sdf: DataFrame, spark: SparkSession, name: str,
                 partition_by: str | None = None, deliveries: Iterable = (None,)) -> DataFrame:
    """Drain a stream (available-now trigger) into Parquet under the shared
    checkpoint folder, once after each delivery, and read the result back as a batch
    DataFrame."""
    out = scratch_path(spark, name)
    writer = sdf.writeStream.format("parquet").option("path", out)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer = (writer.option("checkpointLocation", scratch_path(spark, name + "-ckpt"))
              .outputMode("append").trigger(availableNow=True))
    for _ in deliveries:
        writer.start().awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out)
