"""Review and retry: O37 missing items, O38 similarity, O47 review, O31 attempt
choice, O27 retry history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

APPROVED = "approved"
REJECTED = "rejected"
N_REQUIRED = 5   # intent items: the prompt's top-5 IDF tokens


def missing_items(required, simplified_tokens) -> Column:
    """Required intent tokens the simplified prompt lost (sorted)."""
    req = F.col(required) if isinstance(required, str) else required
    simp = F.col(simplified_tokens) if isinstance(simplified_tokens, str) else simplified_tokens
    return F.array_sort(F.array_except(req, simp))


def similarity(orig_tokens, simplified_tokens) -> Column:
    """Share of the original's distinct content tokens still present."""
    o = F.col(orig_tokens) if isinstance(orig_tokens, str) else orig_tokens
    s = F.col(simplified_tokens) if isinstance(simplified_tokens, str) else simplified_tokens
    return F.when(F.size(o) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(o, s)) / F.size(o))


def top_items(token_idf: DataFrame, keys=("pid", "level"), n: int = N_REQUIRED) -> DataFrame:
    """The rows of the top-n tokens of each prompt by IDF (ties by token)."""
    w = Window.partitionBy(*keys).orderBy(F.col("idf").desc(), F.col("token"))
    return token_idf.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def required_items(token_idf: DataFrame, keys=("pid", "level"), n: int = N_REQUIRED) -> DataFrame:
    """Top-n tokens of each prompt by IDF (ties by token), as a sorted array.
    ``token_idf`` has one row per (keys, token) with ``idf``."""
    return top_items(token_idf, keys, n).groupBy(*keys).agg(F.array_sort(F.collect_list("token")).alias("required"))


def review(df: DataFrame) -> DataFrame:
    """Needs orig_tokens, simp_tokens, required, pass_score, max_missing."""
    miss = missing_items("required", "simp_tokens")
    sim = similarity("orig_tokens", "simp_tokens")
    t = df.withColumn("missing", miss).withColumn("similarity", sim)
    passed = (F.col("similarity") >= F.col("pass_score")) & \
             (F.size("missing") <= F.col("max_missing"))
    return t.withColumn("passed", passed)


def pick_attempt(attempts: DataFrame, keys=("pid", "level")) -> DataFrame:
    """The first passing attempt, else the last one. Status 'approved'
    when it passed, else 'rejected' (retries exhausted still yield a result)."""
    order = F.when(F.col("passed"), F.col("attempt")).otherwise(-F.col("attempt"))
    w = Window.partitionBy(*keys).orderBy(F.col("passed").desc(), order)
    return (attempts.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1)
                    .drop("__rn")
                    .withColumn("status", F.when(F.col("passed"), F.lit(APPROVED))
                                .otherwise(F.lit(REJECTED))))


def retry_history(attempts: DataFrame, keys=("pid", "level"), extra: tuple[Column, ...] = ()) -> DataFrame:
    """Per prompt, the attempts that were run, in order (at most three), each with the
    ``extra`` columns."""
    rec = F.struct("attempt", F.round("similarity", 6).cast("decimal(8,6)").alias("similarity"),
                   F.col("missing").alias("missing_items"), "passed", *extra)
    return attempts.groupBy(*keys).agg(F.sort_array(F.collect_list(rec)).alias("retry_history"))
