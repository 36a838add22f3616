"""Privacy budget: what each noisy step of the chain spends, composed over steps, attempts
and prompts (O05, O28, O48).

The unit is a change of one prompt's text that moves every segment score and distance by at
most 1 (they lie in [0, 1]). With noise of scale b a step spends (pure eps):

* ``threshold`` (O29): 1 / b_thr, for the noisy threshold;
* ``hits`` (O29): 2 c / b, for up to c answers above it;
* ``top_k`` (O33): 2 k / b, k selections of 2 / b each (one-shot noisy top-k);
* ``knn`` (O22 in the chain): 2 kk / b, kk selections of noisy distances.

A step that ranks by the scores themselves has no bound: its eps is NULL, it does not enter the
totals, and ``exact_steps`` counts it. A total is a bound on the whole release only where
``exact_steps`` is 0.

Two compositions are reported. Basic: eps add up. Zero-concentrated (Bun and Steinke
2016): a step of pure eps has rho = eps^2 / 2, k selections by Gumbel noise have k (2/b)^2 / 8
(bounded range, Cesar and Rogers 2021), rho adds up, and (rho + 2 sqrt(rho ln(1/delta)),
delta) holds for the sum; it grows with the root of the number of steps. A retry reads the
prompt again, so its attempts add up whether they pass or not; so do the prompts of a
conversation. Prompts of different people compose in parallel: their bound is the maximum.

eps are decimals and rho counts millionths, so sums do not depend on order or engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELTA = 1e-6
EPS = "decimal(18,6)"
MICRO = 1_000_000
STEPS = ("threshold", "hits", "top_k", "knn")
#: Kinds of top-k noise whose selections have a bounded range.
GUMBEL = "gumbel"


def count_of(fraction: str, n_seg: str = "n_seg") -> Column:
    """How many segments a fraction of a prompt's segments means: at least one."""
    return F.greatest(F.lit(1), F.ceil(F.col(fraction) * F.coalesce(F.col(n_seg), F.lit(0))).cast("bigint"))


def _micro(c: Column) -> Column:
    return F.floor(c * MICRO + F.lit(0.5)).cast("bigint")


def with_costs(rows: DataFrame, topk_noise: str | None) -> DataFrame:
    """Adds eps_<step> for each step, ``rho_q`` and ``exact_steps`` to rows with b_thr, b,
    c_att, k_att, knn_att and n_seg (one row per attempt)."""
    b = F.col("b")
    svt = 1 / F.col("b_thr") + 2 * count_of("c_att") / b
    knn = 2 * count_of("knn_att") / b
    k = count_of("k_att")
    rho = svt * svt / 2 + knn * knn / 2
    if topk_noise == GUMBEL:
        rho = rho + k / (2 * b * b)
    elif topk_noise:
        rho = rho + (2 * k / b) * (2 * k / b) / 2
    costs = {"threshold": 1 / F.col("b_thr"), "hits": 2 * count_of("c_att") / b,
             "top_k": 2 * k / b if topk_noise else F.lit(None), "knn": knn}
    return rows.select("*", *[costs[s].cast(EPS).alias(f"eps_{s}") for s in STEPS],
                       _micro(rho).alias("rho_q"), F.lit(0 if topk_noise else 1).cast("bigint").alias("exact_steps"))


def attempt_total() -> Column:
    """eps of one attempt's noisy steps."""
    return sum((F.coalesce(F.col(f"eps_{s}"), F.lit(0).cast(EPS)) for s in STEPS[1:]), F.col("eps_threshold")).cast(EPS)


def add_spent(rows: DataFrame, before: bool) -> DataFrame:
    """Running totals over a prompt's attempts: spent_eps, spent_rho_q and spent_exact. With
    ``before``, the rows carry those of the attempts before (b_eps, b_rho_q, b_exact)."""
    def plus(c: Column, name: str) -> Column:
        return c + F.coalesce(F.col(name), F.lit(0)) if before else c
    out = rows.select("*", plus(attempt_total(), "b_eps").cast(EPS).alias("spent_eps"),
                      plus(F.col("rho_q"), "b_rho_q").alias("spent_rho_q"),
                      plus(F.col("exact_steps"), "b_exact").alias("spent_exact"))
    return out.drop("b_eps", "b_rho_q", "b_exact")


def spent_before(rows: DataFrame) -> list[Column]:
    """The running totals of an attempt under the names that ``add_spent`` reads."""
    return [F.col("spent_eps").alias("b_eps"), F.col("spent_rho_q").alias("b_rho_q"), F.col("spent_exact").alias("b_exact")]


def rho(micro: str) -> Column:
    return (F.col(micro).cast("decimal(28,0)") / F.lit(MICRO).cast("decimal(8,0)")).cast("decimal(28,6)")


def zcdp_eps(micro: str, delta: float = DELTA) -> Column:
    """The eps that ``delta`` goes with: rho + 2 sqrt(rho ln(1/delta)), four places."""
    r = F.col(micro).cast("double") / MICRO
    return F.round(r + 2 * F.sqrt(r * F.lit(math.log(1 / delta))), 4)


def steps_of(attempts: DataFrame, keys: tuple[str, ...] = ("pid", "level")) -> DataFrame:
    """Long form, one row per attempt and step: keys, attempt, step, eps (NULL: no noise)."""
    each = F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"eps_{s}").alias("eps")) for s in STEPS])
    return attempts.select(*keys, "attempt", F.explode(each).alias("s")).select(*keys, "attempt", "s.step", "s.eps")


def compose(steps: DataFrame, *keys: str) -> DataFrame:
    """Basic composition of a long table of steps: keys, n_steps, eps_total, exact_steps.
    Sums with partial aggregation, so a hot key costs one row a task."""
    return steps.groupBy(*keys).agg(
        F.count("*").alias("n_steps"), F.coalesce(F.sum("eps"), F.lit(0)).cast(EPS).alias("eps_total"),
        F.count_if(F.col("eps").isNull()).alias("exact_steps"))


def ledger(prompts: DataFrame, *keys: str, delta: float = DELTA) -> DataFrame:
    """Sequential composition of prompts (spent_eps, spent_rho_q, spent_exact, attempt: the last
    one) by ``keys``, such as a conversation or a user."""
    return prompts.groupBy(*keys).agg(
        F.count("*").alias("n_prompts"), F.sum("attempt").cast("bigint").alias("n_attempts"),
        F.sum("spent_eps").cast(EPS).alias("eps_total"), F.sum("spent_rho_q").alias("rho_q"),
        F.sum("spent_exact").cast("bigint").alias("exact_steps")).select(
        *keys, "n_prompts", "n_attempts", "eps_total", rho("rho_q").alias("rho_total"),
        zcdp_eps("rho_q", delta).alias("eps_zcdp"), "exact_steps")


# ---- DuckDB SQL spellings ----------------------------------------------------

def sql_count_of(fraction: str, n_seg: str) -> str:
    return f"greatest(1, CAST(ceil({fraction} * coalesce({n_seg}, 0)) AS BIGINT))"


def sql_costs(topk_noise: str | None, n_seg: str) -> str:
    """Columns eps_<step>, rho_q and exact_steps from b_thr, b, c_att, k_att and knn_att."""
    c, k, kk = (sql_count_of(x, n_seg) for x in ("c_att", "k_att", "knn_att"))
    svt, knn = f"(1 / b_thr + 2 * {c} / b)", f"(2 * {kk} / b)"
    rho_ = f"{svt} * {svt} / 2 + {knn} * {knn} / 2"
    if topk_noise == GUMBEL:
        rho_ += f" + {k} / (2 * b * b)"
    elif topk_noise:
        rho_ += f" + (2 * {k} / b) * (2 * {k} / b) / 2"
    top = f"2 * {k} / b" if topk_noise else "NULL"
    return (f"CAST(1 / b_thr AS DECIMAL(18,6)) AS eps_threshold, CAST(2 * {c} / b AS DECIMAL(18,6)) AS eps_hits, "
            f"CAST({top} AS DECIMAL(18,6)) AS eps_top_k, CAST(2 * {kk} / b AS DECIMAL(18,6)) AS eps_knn, "
            f"CAST(floor(({rho_}) * {MICRO} + 0.5) AS BIGINT) AS rho_q, {0 if topk_noise else 1}::BIGINT AS exact_steps")


SQL_ATTEMPT_TOTAL = "(eps_threshold + eps_hits + coalesce(eps_top_k, 0) + eps_knn)"


def sql_zcdp_eps(micro: str, delta: float = DELTA) -> str:
    r = f"(CAST({micro} AS DOUBLE) / {MICRO})"
    return f"round({r} + 2 * sqrt({r} * CAST({math.log(1 / delta)!r} AS DOUBLE)), 4)"


def sql_rho(micro: str) -> str:
    return f"CAST(CAST({micro} AS DECIMAL(28,0)) / {MICRO} AS DECIMAL(28,6))"
