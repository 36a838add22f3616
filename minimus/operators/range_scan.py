"""O18, O30, O16 over sequences of any length: a prefix scan by range.

Rows are dealt to tasks by range of (group, order), so a group that is larger than a task's share
is split wherever its rows fall, also within one bucket of turns or one minute. Each task walks
its sorted rows once and finds, for every row, the last anchor before it in the task; the
result is written once. What a group's rows in one task know of the tasks before is one value: a
table of one row per task, read off the written rows and carried over the edges, is
broadcast back. So the input is read once, and there are three exchanges: the range sort, the
edges, and their broadcast, whatever the lengths of groups.

Ties in (group, order) are taken in any order but kept together by the sort; give enough order
columns. Defined results: a null group is a group of its own; nulls in the order come first; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clock, epoch_millis_ntz
from ..session import scratch_path, ship_package

PART, IDX, FLAG, VALUE, LOCAL, HAS = "__part", "__idx", "__flag", "__value", "__local", "__has"


def _walk(group: str):
    """Adds to sorted rows the value of the last flagged row before each in its group, and
    whether there is one."""
    def run(batches):
        before = None  # the group of the row before, and the value of its last flagged row (or None)
        for b in batches:
            if not b.num_rows:
                continue
            g, flag, value = b.column(group), b.column(FLAG), b.column(VALUE)
            n = b.num_rows
            later, earlier = g.slice(1), g.slice(0, n - 1)
            differs = pc.fill_null(pc.not_equal(later, earlier), False).to_numpy(zero_copy_only=False)
            differs |= pc.is_null(later).to_numpy(zero_copy_only=False) != pc.is_null(earlier).to_numpy(zero_copy_only=False)
            start = np.zeros(n, np.int64)
            start[1:] = np.where(differs, np.arange(1, n), 0)
            start = np.maximum.accumulate(start)
            hit = pc.fill_null(flag, False).to_numpy(zero_copy_only=False)
            last = np.maximum.accumulate(np.where(hit, np.arange(n), -1))
            earlier_hit = np.concatenate([[-1], last[:-1]])
            # row n of ``known`` is what the batches before left for the first group
            known = pa.concat_arrays([value, before[1] if before and before[1] is not None else pa.nulls(1, value.type)])
            goes_on = before is not None and before[1] is not None and g[0].as_py() == before[0]
            at = np.where(earlier_hit >= start, earlier_hit, np.where(goes_on & (start == 0), n, -1))
            has = at >= 0
            local = known.take(pa.array(at, mask=~has))
            yield pa.RecordBatch.from_arrays([*b.columns, local, pa.array(has)], [*b.schema.names, LOCAL, HAS])
            end = g[n - 1].as_py()
            if last[-1] >= start[-1]:
                before = (end, value.slice(int(last[-1]), 1))
            elif not (goes_on and start[-1] == 0):
                before = (end, None)
    return run


def _edges(rows: DataFrame, group: str) -> DataFrame:
    """(part, group, value): what the tasks before know of the first group of each task."""
    flagged = F.max(F.when(F.col(FLAG), F.struct(IDX, F.col(group).alias("g"), F.col(VALUE).alias("v"))))
    per = rows.groupBy(PART).agg(F.min_by(F.struct(group), IDX).alias("first"), F.max_by(F.struct(group), IDX).alias("last"),
                                 flagged.alias("hit"))
    out, state = [], None  # state: (group, value)
    for r in sorted(per.collect(), key=lambda r: r[PART]):  # one row per task
        first, last = r["first"][0], r["last"][0]
        if state is not None and state[0] == first:
            out.append((r[PART], state[0], state[1]))
        if r["hit"] is not None and r["hit"]["g"] == last:
            state = (last, r["hit"]["v"])
        elif not (state is not None and first == last == state[0]):
            state = None
    schema = T.StructType([T.StructField("__p", T.IntegerType()), T.StructField("__g", rows.schema[group].dataType),
                           T.StructField("__carried", rows.schema[VALUE].dataType)])
    return rows.sparkSession.createDataFrame(out, schema)


def scan_preceding(df: DataFrame, group: str, order: str | list[str], anchor: Column, value: Column, out: str) -> DataFrame:
    """``df`` with ``out``: the ``value`` of the last row before each (by ``order`` within ``group``)
    where ``anchor`` holds, null when there is none."""
    spark = df.sparkSession
    ship_package(spark)
    order = [order] if isinstance(order, str) else list(order)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (df.withColumn(FLAG, F.coalesce(anchor, F.lit(False))).withColumn(VALUE, F.when(F.col(FLAG), value))
            .repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
            .withColumn(PART, F.spark_partition_id()).withColumn(IDX, F.monotonically_increasing_id()))
    schema = T.StructType([*rows.schema.fields, T.StructField(LOCAL, rows.schema[VALUE].dataType), T.StructField(HAS, T.BooleanType())])
    path = scratch_path(spark, "range-scan")
    rows.mapInArrow(_walk(group), schema).write.parquet(path)
    staged = spark.read.schema(schema).parquet(path)
    edges = F.broadcast(_edges(staged, group))  # one row per task
    joined = staged.join(edges, staged[PART] == edges["__p"], "left")
    carried = F.when(F.col(group).eqNullSafe(F.col("__g")) & F.col("__p").isNotNull(), F.col("__carried"))
    return joined.select(*df.columns, F.when(F.col(HAS), F.col(LOCAL)).otherwise(carried).alias(out))


def history_by_range(msgs: DataFrame) -> DataFrame:
    """O50, the rows of ``plans.history.simplify_history``."""
    user = F.col("role") == "user"
    t = scan_preceding(msgs.select("conv_id", "turn", "role", "ts", "simplified_message"), "conv_id", "turn", user, F.col("ts"), "asked")
    t = t.where((F.col("role") == "assistant") & F.col("simplified_message").isNotNull()).withColumn("shown", F.coalesce("asked", "ts"))
    return t.select("conv_id", "turn", "simplified_message", epoch_millis_ntz("shown").alias("display_ts_ms"), clock("shown").alias("clock"))


def single_flight_by_range(msgs: DataFrame) -> DataFrame:
    """O30, the rows of ``admission.single_flight``."""
    rows = msgs.where(F.col("role").isin("user", "assistant"))
    t = scan_preceding(rows, "conv_id", "turn", F.lit(True), F.col("role"), "__prev")
    return t.where((F.col("role") == "user") & (F.col("__prev").isNull() | (F.col("__prev") == "assistant"))).drop("__prev")
