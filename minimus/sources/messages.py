"""O01 message scan, and the chat log derived from the ``conversations`` table.

The derived log gives every conversation turn the fields of a chat message:
a wall-clock ``ts`` (TIMESTAMP_NTZ, so no session time zone can shift it), the
privacy level picked for user prompts and, on assistant replies, the simplified
prompt that the reply was produced from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pii import mask_pii
from ..functions.text import clean_text
from ..operators.asof import lag_value, turn_bucket
from ..schema import MESSAGE
from .tables import read_table

# The derived clock starts 2024-01-01 00:00:00, one hour per
# conversation, seven seconds per turn.
CLOCK_ORIGIN = "2024-01-01 00:00:00"
SECONDS_PER_CONV = 3600
SECONDS_PER_TURN = 7

LEVELS = ("low", "medium", "high")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A stored message log (M1 schema), never schema-inferred."""
    return spark.read.schema(MESSAGE).parquet(path)


def derived_ts(conv_id, turn):
    secs = F.col(conv_id) * SECONDS_PER_CONV + F.col(turn) * SECONDS_PER_TURN
    return F.timestamp_add("SECOND", secs, F.lit(CLOCK_ORIGIN).cast("timestamp_ntz"))


def messages_from_conversations(conversations: DataFrame) -> DataFrame:
    """Chat log (M1) from ``conversations``; ``system`` turns have no
    counterpart in a chat log and are dropped first.

    * user rows: ``simplify`` = one of low/medium/high chosen by (conv_id + turn);
    * assistant rows: ``simplified_message`` = cleaned text of the user prompt
      right before, masked at 'high', NULL when there is none or the reply is an
      error reply (every 7th (conv_id + turn)). Clean-up and masking run where the
      turns are scanned, so the unmasked prompt does not travel to its reply.
    """
    msgs = conversations.select("conv_id", "turn", "role", "text").where(
        F.col("role").isin("user", "assistant"))
    # previous row of the conversation, by a two-level (bucketed) scan
    shown = F.when(F.col("role") == "user", mask_pii(clean_text("text"), "high"))
    msgs = lag_value(msgs.withColumn("__rt", F.struct("role", shown.alias("text"))),
                     "conv_id", "turn", "__rt", "__prev", turn_bucket("turn"))
    prev_role = F.col("__prev.role")
    prev_text = F.col("__prev.text")
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]),
                         (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) + 1).cast("int"))
    is_user = F.col("role") == "user"
    simplified = (F.when(is_user, F.lit(None).cast("string"))
                  .when(prev_role != "user", F.lit(None).cast("string"))
                  .when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)) == 0,
                        F.lit(None).cast("string"))
                  .otherwise(prev_text))
    return msgs.select(
        "conv_id", "turn", "role",
        F.col("text").alias("content"),
        derived_ts("conv_id", "turn").alias("ts"),
        F.when(is_user, level).alias("simplify"),
        simplified.alias("simplified_message"),
    )


def other_turns(conversations: DataFrame) -> DataFrame:
    """The turns that a chat log has no place for (``system``, unknown and missing roles),
    counted by role: what ``messages_from_conversations`` leaves out."""
    return (conversations.where(F.col("role").isNull() | ~F.col("role").isin("user", "assistant"))
            .groupBy("role").agg(F.count(F.lit(1)).alias("n")))


def chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from_conversations(
        read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))


# The same derivation in DuckDB SQL, for the oracle queries.
SQL_CHAT_LOG = f"""
SELECT conv_id, turn, role, text AS content,
       TIMESTAMP '{CLOCK_ORIGIN}' + to_seconds(conv_id * {SECONDS_PER_CONV} + turn * {SECONDS_PER_TURN}) AS ts,
       CASE WHEN role = 'user' THEN (['low','medium','high'])[((conv_id + turn) % 3) + 1] END AS simplify,
       CASE WHEN role = 'user' THEN NULL
            WHEN lag(role) OVER w IS DISTINCT FROM 'user' THEN NULL
            WHEN (conv_id + turn) % 7 = 0 THEN NULL
            ELSE {{clean_prev}} END AS simplified_message
FROM conversations
WHERE role IN ('user', 'assistant')
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
"""
