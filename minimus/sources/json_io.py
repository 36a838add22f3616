"""O02 request encode/decode, O05 payload writer and log sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import REQUEST


def encode_request(df: DataFrame, message: str = "message", simplify: str = "simplify",
                   out: str = "request_json") -> DataFrame:
    """``{"message": ..., "simplify": ...}`` as a JSON string column."""
    return df.withColumn(out, F.to_json(F.struct(F.col(message).alias("message"),
                                                 F.col(simplify).alias("simplify"))))


def decode_request(df: DataFrame, col: str = "request_json") -> DataFrame:
    """Parse with the explicit request schema (no inference)."""
    return (df.withColumn("__req", F.from_json(F.col(col), REQUEST))
              .withColumn("message", F.col("__req.message"))
              .withColumn("simplify", F.col("__req.simplify"))
              .drop("__req"))


def append_to_log(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """O04 sink: append-only write of new rows to a stored log."""
    df.write.mode("append").format(fmt).save(path)


def write_payloads(df: DataFrame, path: str, col: str = "payload") -> None:
    """O05 sink: one JSON payload per line."""
    df.select(F.col(col).alias("value")).write.mode("append").text(path)
