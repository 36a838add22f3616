"""O18 as-of (backward) lookup and O19 turn pairing.

The reference finds, for each history row, the nearest earlier user message by
slicing and scanning the list (O(n^2)). Here it is one sort per group: a running
"last non-null anchor value" window, filtered to the targets *after* the window
(filtering first would remove the anchors).

Hot groups: with ``bucket`` given (e.g. ``turn div 4096``) the scan runs in two
levels so no task holds a whole group: a local window per (group, bucket), then
a carry of each bucket's last anchor over the buckets of the group (one row per
bucket), joined back on (group, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def preceding_value(df: DataFrame, group: str, order, anchor: Column,
                    value: str, out: str, bucket: Column | None = None) -> DataFrame:
    """Add ``out`` = ``value`` of the last row before this one (by ``order``, a
    column name or a list of them, within ``group``) where ``anchor`` holds;
    NULL when there is none. ``bucket`` must not decrease along ``order``."""
    ocols = list(order) if isinstance(order, (list, tuple)) else [order]
    anchored = F.when(anchor, F.col(value))
    if bucket is None:
        w = (Window.partitionBy(group).orderBy(order)
             .rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn(out, F.last(anchored, ignorenulls=True).over(w))

    b = "__bucket"
    t = df.withColumn(b, bucket)
    local_w = (Window.partitionBy(group, b).orderBy(order)
               .rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("__local", F.last(anchored, ignorenulls=True).over(local_w))
    # one row per (group, bucket): the bucket's last anchor value
    last_in_bucket = (df.withColumn(b, bucket)
                      .groupBy(group, b)
                      .agg(F.max(F.when(anchor, F.struct(
                          *[F.col(c).alias(f"o{i}") for i, c in enumerate(ocols)],
                          F.col(value).alias("v")))).alias("__m"))
                      .select(group, b, F.col("__m.v").alias("__bl")))
    carry_w = (Window.partitionBy(group).orderBy(b)
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = last_in_bucket.select(
        group, b, F.last("__bl", ignorenulls=True).over(carry_w).alias("__carry"))
    return (t.join(carry, [group, b], "left")
             .withColumn(out, F.coalesce("__local", "__carry"))
             .drop(b, "__local", "__carry"))


def asof_backward(df: DataFrame, group: str, order: str, target: Column,
                  anchor: Column, value: str, out: str,
                  fallback: str | None = None, bucket: Column | None = None) -> DataFrame:
    """Targets only, each with the nearest earlier anchor's ``value``
    (``fallback`` column when there is none)."""
    t = preceding_value(df, group, order, anchor, value, out, bucket)
    t = t.where(target)
    if fallback is not None:
        t = t.withColumn(out, F.coalesce(F.col(out), F.col(fallback)))
    return t


# Conversation turns are dense integers, so ``turn div TURN_BUCKET`` bounds the
# rows one window task holds, however long a conversation is.
TURN_BUCKET = 4096


def turn_bucket(turn: str = "turn", size: int = TURN_BUCKET) -> Column:
    return F.floor(F.col(turn) / F.lit(size)).cast("bigint")


def lag_value(df: DataFrame, group: str, order: str, value: str, out: str,
              bucket: Column | None = None) -> DataFrame:
    """``lag(value)`` over (group, order): the previous row's value. With a
    bucket it runs as the two-level scan of ``preceding_value`` (every row is
    an anchor; values are wrapped in a struct so a NULL value still counts)."""
    t = df.withColumn("__v", F.struct(F.col(value).alias("v")))
    t = preceding_value(t, group, order, F.lit(True), "__v", "__pv", bucket)
    return t.withColumn(out, F.col("__pv.v")).drop("__v", "__pv")


def lead_value(df: DataFrame, group: str, order: str, value: str, out: str,
               bucket_size: int | None = TURN_BUCKET) -> DataFrame:
    """``lead(value)``: the lag of the reversed order (integer ``order``)."""
    t = df.withColumn("__neg", -F.col(order))
    b = (-turn_bucket(order, bucket_size)) if bucket_size else None
    return lag_value(t, group, "__neg", value, out, b).drop("__neg")


def row_index(df: DataFrame, group: str, order: str, out: str,
              bucket: Column | None = None) -> DataFrame:
    """0-based position in the group. With a bucket: row_number inside the
    bucket plus the sizes of the group's earlier buckets (one row per bucket)."""
    if bucket is None:
        w = Window.partitionBy(group).orderBy(order)
        return df.withColumn(out, F.row_number().over(w) - 1)
    b = "__bucket"
    t = df.withColumn(b, bucket)
    local = t.withColumn("__i", F.row_number().over(Window.partitionBy(group, b).orderBy(order)) - 1)
    sizes = t.groupBy(group, b).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(group, b, F.coalesce(F.sum("__n").over(
        Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("__off"))
    return (local.join(before, [group, b], "left")
                 .withColumn(out, F.col("__i") + F.col("__off"))
                 .drop(b, "__i", "__off"))


def pair_turns(msgs: DataFrame, bucket_size: int | None = TURN_BUCKET) -> DataFrame:
    """Each user row with the assistant reply that directly follows it."""
    t = msgs.select("conv_id", "turn", "role", "content",
                    F.struct("role", "turn", "content").alias("__row"))
    t = lead_value(t, "conv_id", "turn", "__row", "__next", bucket_size)
    return (t.where((F.col("role") == "user") & (F.col("__next.role") == "assistant"))
             .select("conv_id", F.col("turn").alias("prompt_turn"),
                     F.col("content").alias("prompt"),
                     F.col("__next.turn").alias("reply_turn"),
                     F.col("__next.content").alias("reply")))
