"""Registered streaming jobs (O52-O54). Each materialises the chat log derived
from ``conversations`` under the shared checkpoint folder, streams it through
the operator with an available-now trigger into a Parquet sink and returns the
sink as a batch DataFrame. The oracle SQL is the batch form of the operator:
batch and stream must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.pii import sql_mask_pii
from ..functions.text import sql_clean_text, sql_js_trim
from ..session import scratch_path
from ..sources.messages import chat_log
from ..streaming.jobs import (history_stream, in_turn_order, read_message_stream, run_to_table,
                              sanitize_stream, single_flight_stream)
from .catalog import ORACLE, register
from .queries_messages import WITH_LOG


def _log_files(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "chat-log")
    chat_log(spark, sf).write.parquet(path)
    return path


@register("stream_sanitize", WITH_LOG + f"""
SELECT conv_id, turn, coalesce(simplify, 'medium') AS level,
       coalesce(simplify, 'medium') IN ('low', 'medium', 'high') AS level_ok,
       {sql_mask_pii(sql_clean_text(sql_js_trim('content')), "coalesce(simplify, 'medium')")} AS masked
FROM log WHERE role = 'user' AND {sql_js_trim('content')} <> ''""")
def q_stream_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    """O52; prompts with an unknown level are kept apart (level_ok)."""
    src = read_message_stream(spark, _log_files(spark, sf))
    return run_to_table(sanitize_stream(src), spark, "stream-sanitize", partition_by="level_ok")


@register("stream_single_flight")
def q_stream_single_flight(spark: SparkSession, sf: str) -> DataFrame:
    """O53 (must equal the batch ``single_flight``)."""
    path, deliveries = in_turn_order(chat_log(spark, sf), spark)
    src = read_message_stream(spark, path)
    return run_to_table(single_flight_stream(src), spark, "stream-single-flight", deliveries=deliveries)


@register("stream_history")
def q_stream_history(spark: SparkSession, sf: str) -> DataFrame:
    """O54 (must equal the batch ``simplify_history``)."""
    path, deliveries = in_turn_order(chat_log(spark, sf), spark)
    src = read_message_stream(spark, path)
    return run_to_table(history_stream(src), spark, "stream-history", deliveries=deliveries)


# batch and stream share one oracle
ORACLE["stream_single_flight"] = ORACLE["single_flight"]
ORACLE["stream_history"] = ORACLE["simplify_history"]
