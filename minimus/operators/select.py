"""Segment selection: O34 score, corpus threshold, O29 SVT, O33 top-k and the
NoisyKNN step of the chain (O22 inside a prompt).

Windows below are all partitioned by keys that start with ``pid``; once the
segment table is hash-partitioned by ``pid`` none of them shuffles again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.noise import gumbel, laplace
from ..functions.secret_noise import SecretNoise
from .segments import content_tokens
from .vocab import NIDF_SCALE

N_BUCKETS = 64       # hashed term-vector width
N_BINS = 10_000      # score histogram resolution for the corpus threshold


def token_bucket(tok) -> Column:
    t = F.col(tok) if isinstance(tok, str) else tok
    return F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(N_BUCKETS))


def token_rows(segs: DataFrame) -> DataFrame:
    """One row per segment and content token."""
    return segs.select("pid", "lang", "level", "pos", F.explode(content_tokens("seg", "lang")).alias("token"))


def rest_sums(found: DataFrame) -> DataFrame:
    """IDF sum and count per segment of token rows that were looked up apart."""
    return found.groupBy("pid", "level", "pos").agg(F.sum("nidf_q").alias("rest_q"), F.count("nidf_q").alias("rest_m"))


def score_segments(segs: DataFrame, idf: DataFrame, keys=("pid", "lang", "level"),
                   rest: DataFrame | None = None) -> DataFrame:
    """O34 plus the prompt statistics the later steps need.

    score = mean normalised IDF over the segment's distinct non-filler tokens
    (0 when none is known), summed in fixed point (see ``vocab.NIDF_SCALE``).
    Hashed term vectors (64 md5 buckets) are sparse: one row per segment and bucket that
    it holds, with its token count n and IDF sum. A window over (prompt, bucket) adds up the
    prompt's count p, and one aggregate per segment gives dot = sum n p, ss = sum n^2 and
    the score; pp = |P|^2 is the sum of dot over the prompt, n_seg its segments. ``idf`` brings
    the bucket of every known token; md5 runs for the others only.

    ``idf`` should be a broadcast side (then nothing here shuffles on data
    partitioned by ``pid``). Where it holds a part of the table only, ``rest`` has what the
    other tokens add to a segment (``rest_sums``). ``segs`` is read twice, so it should be staged.
    """
    k = list(keys)
    j = token_rows(segs).join(idf.select("lang", "token", "nidf_q", "bucket"), ["lang", "token"], "left")
    cells = (j.withColumn("bucket", F.coalesce("bucket", token_bucket("token")))
              .groupBy("pid", "level", "pos", "bucket")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("nidf_q").alias("q"), F.count("nidf_q").alias("m")))
    prompt_bucket = Window.partitionBy("pid", "level", "bucket")
    parts = (cells.withColumn("p", F.sum("n").over(prompt_bucket)).groupBy("pid", "level", "pos").agg(
        F.sum("q").alias("q"), F.sum("m").alias("m"),
        F.sum(F.col("n") * F.col("p")).alias("dot"), F.sum(F.col("n") * F.col("n")).alias("ss")))
    q, m = F.col("q"), F.col("m")
    if rest is not None:
        parts = parts.join(rest, ["pid", "level", "pos"], "left")
        q = F.coalesce(q + F.col("rest_q"), q, F.col("rest_q"))
        m = m + F.coalesce("rest_m", F.lit(0))
    parts = parts.select("pid", "level", "pos", (q / (F.when(m > 0, m) * F.lit(NIDF_SCALE))).alias("score"), "dot", "ss")
    prompt = Window.partitionBy("pid", "level")
    zero = F.lit(0).cast("bigint")
    joined = segs.select(*k, "pos", "seg").join(parts, ["pid", "level", "pos"], "left")
    return joined.select(*k, "pos", "seg", F.coalesce("score", F.lit(0.0)).alias("score"),
                         F.coalesce("dot", zero).alias("dot"), F.coalesce("ss", zero).alias("ss"),
                         F.count(F.lit(1)).over(prompt).alias("n_seg"),
                         F.coalesce(F.sum("dot").over(prompt), zero).alias("pp"))


def score_bin(score: str = "score") -> Column:
    return F.least(F.floor(F.col(score) * N_BINS), F.lit(N_BINS - 1)).cast("bigint")


def thresholds(scored: DataFrame, plan: DataFrame) -> DataFrame:
    """T per (level, attempt): the q_att quantile of the corpus scores, read off
    a fixed 10,000-bin histogram. Distributed count per bin (partial aggregation),
    then a cumulative sum over at most 10,000 rows per level -- no global sort of
    the scores and no group holding the data. ``plan`` has (level, attempt, q_att)."""
    return thresholds_of(histogram(scored), plan)


def histogram(scored: DataFrame) -> DataFrame:
    """(level, bin, n): segments by score bin."""
    return scored.groupBy("level", score_bin().alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def thresholds_of(hist: DataFrame, plan: DataFrame) -> DataFrame:
    """The thresholds that a histogram (level, bin, n) gives."""
    w = Window.partitionBy("level").orderBy("bin")
    cum = (hist.withColumn("cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
               .withColumn("total", F.sum("n").over(Window.partitionBy("level"))))
    return (cum.join(plan.select("level", "attempt", "q_att"), "level")
               .where(F.col("cum") >= F.col("q_att") * F.col("total"))
               .groupBy("level", "attempt")
               .agg((F.min("bin") / F.lit(float(N_BINS))).alias("t")))


def svt(rows: DataFrame, seed: int, keys=("pid", "level", "attempt"),
        noise: SecretNoise | None = None) -> DataFrame:
    """O29 sparse vector technique over a prompt's segments in ``pos`` order.

    Needs score, t, b_thr, b, c_att, n_seg. One noisy threshold per prompt
    (rho ~ Lap(b_thr)), one noise draw per segment (nu ~ Lap(b)); a segment is
    above when score + nu >= t + rho; stop after c = max(1, ceil(c_att*n_seg))
    hits. The running hit count is a prefix sum over earlier rows.
    With ``noise`` the draws and the comparison are integers under its secret salt.
    """
    k = list(keys)
    if noise is not None:
        # one threshold per prompt: drawn for its first row only
        order = Window.partitionBy(*k).orderBy("pos")
        rows = rows.withColumn("__first", F.row_number().over(order) == 1)
        rows = noise.draws(rows, "b_thr", "__rho", "rho", *k, only=F.col("__first"))
        rows = rows.withColumn("__rho", F.first("__rho").over(order)).drop("__first")
        least = noise.value(F.col("t")) + F.col("__rho") - noise.value(F.col("score"))
        return _first_hits(noise.at_least(rows, "b", "above", least, "nu", *k, "pos").drop("__rho"), k)
    rho = laplace(F.col("b_thr"), seed, F.lit("rho"), *[F.col(x) for x in k])
    nu = laplace(F.col("b"), seed, F.lit("nu"), *[F.col(x) for x in k], F.col("pos"))
    above = (F.col("score") + nu) >= (F.col("t") + rho)
    return _first_hits(rows.withColumn("above", above), k)


def _first_hits(rows: DataFrame, k: list[str]) -> DataFrame:
    """The first c rows above the threshold, by ``pos``."""
    c = F.greatest(F.lit(1), F.ceil(F.col("c_att") * F.col("n_seg")).cast("bigint"))
    w = Window.partitionBy(*k).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = rows.withColumn("hits_before", F.coalesce(F.sum(F.col("above").cast("int")).over(w), F.lit(0)))
    return t.where(F.col("above") & (F.col("hits_before") < c)).drop("above", "hits_before")


def top_k(rows: DataFrame, seed: int | None = None, noise: str | SecretNoise | None = None,
          keys=("pid", "level", "attempt")) -> DataFrame:
    """The k = max(1, ceil(k_att*n_seg)) best-scored segments, ties by pos.
    ``noise='gumbel'`` ranks by score + Gumbel(b) (one-shot noisy top-k), a ``SecretNoise``
    by the score on its grid + a geometric draw."""
    k = list(keys)
    rank_by = F.col("score")
    if isinstance(noise, SecretNoise):
        rows = noise.draws(rows, "b", "__draw", "topk", *k, "pos", two_sided=False)
        rank_by = noise.value(rank_by) + F.col("__draw")
    elif noise == "gumbel":
        rank_by = rank_by + gumbel(F.col("b"), seed, F.lit("topk"), *[F.col(x) for x in k],
                                   F.col("pos"))
    kk = F.greatest(F.lit(1), F.ceil(F.col("k_att") * F.col("n_seg")).cast("bigint"))
    w = Window.partitionBy(*k).orderBy(rank_by.desc(), F.col("pos"))
    return (rows.withColumn("__rn", F.row_number().over(w))
                .where(F.col("__rn") <= kk).drop("__rn", "__draw"))


def cosine_distance_to_prompt() -> Column:
    denom = F.sqrt(F.col("ss").cast("double") * F.col("pp").cast("double"))
    return F.lit(1.0) - F.when(denom > 0, F.col("dot") / denom).otherwise(F.lit(0.0))


def knn_select(rows: DataFrame, seed: int, keys=("pid", "level", "attempt"),
               noise: SecretNoise | None = None) -> DataFrame:
    """O22 in the chain: keep the kk = max(1, ceil(knn_att*n_seg)) segments
    nearest the whole prompt under cosine distance + Lap(b) per segment."""
    k = list(keys)
    if noise is not None:
        rows = noise.draws(rows, "b", "__draw", "knn", *k, "pos")
        dist = noise.value(cosine_distance_to_prompt()) + F.col("__draw")
    else:
        dist = cosine_distance_to_prompt() + laplace(
            F.col("b"), seed, F.lit("knn"), *[F.col(x) for x in k], F.col("pos"))
    kk = F.greatest(F.lit(1), F.ceil(F.col("knn_att") * F.col("n_seg")).cast("bigint"))
    w = Window.partitionBy(*k).orderBy(F.col("__d"), F.col("pos"))
    return (rows.withColumn("__d", dist)
                .withColumn("__rn", F.row_number().over(w))
                .where(F.col("__rn") <= kk).drop("__rn", "__d", "__draw"))
