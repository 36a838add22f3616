"""O30 single-flight admission (batch form).

In the chat client a prompt sent while an earlier one is still unanswered is
dropped. Over a log this is: a user row is admitted when the previous
user/assistant row of its conversation is absent or an assistant reply; of a
run of user rows only the first is admitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import TURN_BUCKET, lag_value, turn_bucket


def single_flight(msgs: DataFrame, bucket_size: int | None = TURN_BUCKET) -> DataFrame:
    """Two-level (bucketed) lag, so a huge conversation is split across tasks."""
    b = turn_bucket("turn", bucket_size) if bucket_size else None
    t = lag_value(msgs.where(F.col("role").isin("user", "assistant")),
                  "conv_id", "turn", "role", "__prev", b)
    return (t.where((F.col("role") == "user")
                    & (F.col("__prev").isNull() | (F.col("__prev") == "assistant")))
             .drop("__prev"))
