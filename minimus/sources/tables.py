"""Table scans with explicit schemas and column pruning at the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import TABLE_SCHEMAS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work (regexes over long texts) enough tasks.

    A scan yields one task per file split; a table stored as a few large
    row groups would run all its per-row work in a handful of tasks. Only then
    are rows dealt round-robin over the default parallelism. A large input
    already has more splits than cores, and is left alone (no extra shuffle).
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | tuple[str, ...] | None = None,
               heavy: bool = False) -> DataFrame:
    """Read one driver table. The declared schema is used when we have one, so
    nothing is inferred; selecting ``columns`` here lets the Parquet scan prune.
    ``heavy=True`` when expensive per-row work follows (see ``spread``)."""
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    df = reader.parquet(table_path(sf_dir, name))
    df = df.select(*columns) if columns else df
    return spread(df) if heavy else df
