"""O50 simplify history (O11 + O18 + O40) and O24 conversation statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clock, epoch_millis_ntz
from ..operators.asof import asof_backward

from ..operators.asof import TURN_BUCKET as HOT_BUCKET


def simplify_history(msgs: DataFrame, bucket_turns: int | None = HOT_BUCKET) -> DataFrame:
    """Assistant rows with a simplified prompt, shown with the clock of the user
    prompt that precedes them (their own clock when none does)."""
    bucket = (F.col("turn") / F.lit(bucket_turns)).cast("bigint") if bucket_turns else None
    t = asof_backward(
        msgs.select("conv_id", "turn", "role", "ts", "simplified_message"),
        group="conv_id", order="turn",
        target=(F.col("role") == "assistant") & F.col("simplified_message").isNotNull(),
        anchor=F.col("role") == "user",
        value="ts", out="display_ts", fallback="ts", bucket=bucket)
    return t.select("conv_id", "turn", "simplified_message",
                    epoch_millis_ntz("display_ts").alias("display_ts_ms"),
                    clock("display_ts").alias("clock"))


def conversation_stats(msgs: DataFrame) -> DataFrame:
    """Size per conversation, split by role, and its history entries.
    One shuffle on conv_id with map-side partial counts (hot conversations are
    pre-aggregated before the shuffle)."""
    return msgs.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(F.col("role") == "user").alias("n_user"),
        F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        F.count_if((F.col("role") == "assistant")
                   & F.col("simplified_message").isNotNull()).alias("n_history"),
    )
