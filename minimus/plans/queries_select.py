"""Registered selection / review queries: stages of the simplify chain on
``documents`` (each document at its own level)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.secret_noise import SecretNoise, write_key
from ..operators.budget import sql_zcdp_eps, zcdp_eps
from ..operators.review import retry_history
from ..session import scratch_path
from .catalog import register
from .chain_sql import with_chain
from .queries_text import document_chain


@register("segment_scores", with_chain(
    "SELECT pid, level, pos, round(score, 6) AS score, dot, ss, n_seg, pp FROM scored"))
def q_segment_scores(spark: SparkSession, sf: str) -> DataFrame:
    """O34 (+ hashed-vector sums): relevance score per segment."""
    s = document_chain(spark, sf).scored
    return s.select("pid", "level", "pos", F.round("score", 6).alias("score"), "dot", "ss",
                    "n_seg", "pp")


@register("score_thresholds", with_chain("SELECT level, attempt, t FROM thr"))
def q_score_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """SVT threshold T per (level, attempt): corpus score quantile (histogram)."""
    return document_chain(spark, sf).thresholds


@register("svt_select", with_chain("SELECT pid, level, attempt, pos FROM svt"))
def q_svt_select(spark: SparkSession, sf: str) -> DataFrame:
    """Segments the sparse vector technique lets through."""
    return document_chain(spark, sf).svt.select("pid", "level", "attempt", "pos")


@register("top_k_segments", with_chain("SELECT pid, level, attempt, pos FROM topk"))
def q_top_k_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Top-k of the SVT survivors by score (ties by position)."""
    return document_chain(spark, sf).topk.select("pid", "level", "attempt", "pos")


@register("top_k_gumbel", with_chain("SELECT pid, level, attempt, pos FROM topk",
                                     topk_noise="gumbel"))
def q_top_k_gumbel(spark: SparkSession, sf: str) -> DataFrame:
    """O33, noisy variant: one-shot top-k by score + Gumbel(b) noise."""
    from ..operators.policy import DEFAULT_SEED, policy_df
    from .queries_text import document_base
    from .simplify import simplify_chain
    ch = simplify_chain(document_base(spark, sf), policy_df(spark), seed=DEFAULT_SEED,
                        topk_noise="gumbel")
    return ch.topk.select("pid", "level", "attempt", "pos")


#: A public salt, so that SQL can draw the same numbers. A private run names its own key file.
TEST_SALT = b"a public salt, for the tests only"


def salted_noise(spark: SparkSession, scales: dict[str, list[str]]) -> SecretNoise:
    path = scratch_path(spark, "test-key")
    write_key(spark, path, TEST_SALT)
    return SecretNoise(spark, path, scales)


def private_chain(spark: SparkSession, sf: str):
    from ..operators.policy import noise_scales, policy_df
    from .queries_text import document_base
    from .simplify import simplify_chain
    return simplify_chain(document_base(spark, sf), policy_df(spark), noise=salted_noise(spark, noise_scales()))


@register("svt_private", with_chain("SELECT pid, level, attempt, pos FROM svt", salt=TEST_SALT))
def q_svt_private(spark: SparkSession, sf: str) -> DataFrame:
    """O29 with discrete Laplace draws under a salt."""
    return private_chain(spark, sf).svt.select("pid", "level", "attempt", "pos")


@register("top_k_private", with_chain("SELECT pid, level, attempt, pos FROM topk", salt=TEST_SALT))
def q_top_k_private(spark: SparkSession, sf: str) -> DataFrame:
    """O33, one-shot top-k with geometric draws under a salt, after private SVT."""
    return private_chain(spark, sf).topk.select("pid", "level", "attempt", "pos")


@register("minimize_private", with_chain(
    f"SELECT pid, level, attempt, status, simplified, spent_eps AS eps_total, {sql_zcdp_eps('spent_rho_q')} AS eps_zcdp, "
    "spent_exact AS exact_steps FROM chosen", salt=TEST_SALT))
def q_minimize_private(spark: SparkSession, sf: str) -> DataFrame:
    """O46 to O48 as a private run: no step ranks by exact scores, so the budget bounds all."""
    return private_chain(spark, sf).chosen.select(
        "pid", "level", "attempt", "status", "simplified", F.col("spent_eps").alias("eps_total"),
        zcdp_eps("spent_rho_q").alias("eps_zcdp"), F.col("spent_exact").alias("exact_steps"))


@register("knn_segments", with_chain("SELECT pid, level, attempt, pos FROM knn"))
def q_knn_segments(spark: SparkSession, sf: str) -> DataFrame:
    """O22 (chain form): segments nearest the whole prompt under noisy cosine distance."""
    return document_chain(spark, sf).knn.select("pid", "level", "attempt", "pos")


@register("rebuilt_prompts", with_chain(
    "SELECT pid, level, attempt, simplified, n_kept FROM rebuilt"))
def q_rebuilt_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Kept segments joined back in original order."""
    return document_chain(spark, sf).rebuilt


REVIEW_SQL = ("SELECT pid, level, attempt, round(similarity, 6) AS similarity, "
              "array_to_string(missing, ',') AS missing, passed FROM reviewed")


def _review_cols(df: DataFrame) -> DataFrame:
    return df.select("pid", "level", "attempt", F.round("similarity", 6).alias("similarity"),
                     F.array_join("missing", ",").alias("missing"), "passed")


@register("review_attempts", with_chain(REVIEW_SQL))
def q_review_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """O47 (with O37 missing items and O38 similarity) for every attempt that is run."""
    return _review_cols(document_chain(spark, sf).reviewed)


@register("chosen_attempt", with_chain(
    "SELECT pid, level, attempt, passed, status, simplified FROM chosen"))
def q_chosen_attempt(spark: SparkSession, sf: str) -> DataFrame:
    """First passing attempt, else the last; its status and text."""
    return document_chain(spark, sf).chosen.select(
        "pid", "level", "attempt", "passed", "status", "simplified")


@register("retry_history", with_chain("""
SELECT r.pid, r.level, r.attempt, round(r.similarity, 6) AS similarity,
       array_to_string(r.missing, ',') AS missing, r.passed
FROM reviewed r JOIN chosen c ON r.pid = c.pid AND r.level = c.level
"""))
def q_retry_history(spark: SparkSession, sf: str) -> DataFrame:
    """O27, flat form: the attempts that were run."""
    ch = document_chain(spark, sf)
    flat = retry_history(ch.reviewed).select("pid", "level", F.explode("retry_history").alias("h"))
    return flat.select("pid", "level", "h.attempt", F.col("h.similarity").cast("double").alias("similarity"),
                       F.array_join("h.missing_items", ",").alias("missing"), "h.passed")


@register("simplify_chain", with_chain(
    "SELECT pid, level, status, simplified FROM chosen"))
def q_simplify_chain(spark: SparkSession, sf: str) -> DataFrame:
    """O46 end to end: the simplified prompt of every document."""
    return document_chain(spark, sf).chosen.select("pid", "level", "status", "simplified")
