"""Spark session and shared-storage helpers.

Everything cluster-facing is read from the session: the checkpoint folder comes
from ``spark.checkpoint.dir`` and is only filled in here when it is unset (local
runs and tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(master: str | None = None, app: str = "minimus",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings every job here assumes.

    What the submitter or the running session sets wins; the values below only fill in
    what is unset. The driver's memory is set for local runs alone.
    """
    active = SparkSession.getActiveSession()
    if not active and "PYSPARK_GATEWAY_PORT" in os.environ:  # started by spark-submit
        SparkContext._ensure_initialized()  # SparkConf() then reads the submitted settings
    given = active.sparkContext.getConf() if active else SparkConf()
    defaults = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if is_local(given.get("spark.master", master)):
        defaults["spark.driver.memory"] = "16g"
        defaults["spark.sql.shuffle.partitions"] = str(shuffle_partitions or os.cpu_count() or 8)
    elif shuffle_partitions:
        defaults["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder.appName(app)
    if master and not given.contains("spark.master"):
        builder = builder.master(master)
    for key, value in defaults.items():
        if not given.contains(key):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(master: str | None) -> bool:
    """One machine: all tasks see the driver's folders."""
    return master is not None and re.match(r"local(\[|$)", master) is not None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder. A local one is set only if the setting is
    unset and the session runs on this machine alone; a cluster must name one."""
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        if not is_local(spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="minimus-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``minimus`` importable in Python workers (needed where our Python
    functions run in tasks: the ``applyInPandasWithState`` operators). The
    package is zipped once per process and handed to ``SparkContext.addPyFile``,
    which distributes it with the job."""
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="minimus-pkg-"), "minimus.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(id(sc))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local)."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Estimated input bytes that one bucket stands for. One task sorts the term-vector cells of a bucket, many times
#: the input's (compressed) bytes, and should not spill.
BUCKET_BYTES = 32 << 20


def input_bytes(df: DataFrame) -> int:
    """Estimated bytes of what ``df`` reads: the sum over the leaves of its plan. Leaves of
    unknown size (local rows, RDDs) count as nothing, checkpoints as much as their files hold."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [_leaf_bytes(df.sparkSession, leaves.apply(i)) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 62)


def _leaf_bytes(spark: SparkSession, leaf) -> int:
    """A checkpoint's leaf brings the estimate of the plan that wrote it: of a join, the product of its sides."""
    if leaf.getClass().getSimpleName() != "LogicalRDD":
        return int(str(leaf.stats().sizeInBytes()))
    files = leaf.rdd().getCheckpointFile()
    if files.isEmpty():
        return 0
    path = spark._jvm.org.apache.hadoop.fs.Path(files.get())
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def bucket_count(df: DataFrame, copies: int = 1) -> int:
    """Buckets for tables derived from ``df``: one for each ``BUCKET_BYTES`` of what it
    reads, ``copies`` times, and no fewer than the shuffle partitions. A bucket is read by
    one task, so their number follows the input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MAX_BUCKETS, -(-input_bytes(df) * copies // BUCKET_BYTES)))


#: Spark refuses more buckets than this by default.
MAX_BUCKETS = 100_000


def bucketed_stage(df: DataFrame, key: str, name: str, buckets: int | None = None,
                   partitioned: bool = False) -> DataFrame:
    """Write ``df`` as a table bucketed by ``key`` under the shared checkpoint
    folder and read it back. Like a checkpoint this cuts the lineage (a lost
    executor re-reads files instead of recomputing the chain); unlike one, the
    read keeps the hash partitioning on ``key``, so later windows, aggregates and
    joins keyed by ``key`` (plus other columns) need no new shuffle.
    Rows are hash-partitioned into ``buckets`` first, so each task writes one
    file; ``partitioned=True`` skips that when ``df`` already comes from a
    stage bucketed the same way (same key, same count). The table leaves the catalog at
    once; the returned frame keeps its files and bucketing. The files are texts for the most
    part, which zstd writes in fewer bytes than Spark's default.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    table = f"minimus_stage_{name}_{uuid.uuid4().hex[:10]}"
    src = df if partitioned else df.repartition(n, key)
    (src.write.bucketBy(n, key).format("parquet")
        .option("path", path).option("compression", "zstd").saveAsTable(table))
    staged = spark.table(table)
    staged.schema  # analysed: bound to the files, not to the name
    spark.sql(f"DROP TABLE {table}")
    return staged


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared folder) so a lost executor
    does not force recomputation of the whole chain. Never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
