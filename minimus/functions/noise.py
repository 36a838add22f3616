"""Reproducible noise from md5 of (seed, keys...).

Draws are a pure function of their keys, so a retried task or a recomputed
partition produces exactly the same numbers, and DuckDB can reproduce them.
This is NOT a privacy guarantee: anyone with the seed can recompute the noise.
A private run needs a secret random seed; floating-point Laplace also has
known leaks (Mironov 2012).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def uniform(seed, *keys) -> Column:
    """u in (-0.5, 0.5): first 32 bits of md5('seed|k1|k2|...')."""
    parts = [F.lit(str(seed))] + [
        (F.lit(k) if isinstance(k, str) else k).cast("string") for k in keys]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")
    return (h.cast("double") + F.lit(0.5)) / F.lit(TWO_32) - F.lit(0.5)


def laplace(scale, seed, *keys) -> Column:
    """Lap(scale) by inverse CDF: -b * sign(u) * ln(1 - 2|u|)."""
    u = uniform(seed, *keys)
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    return -b * F.signum(u) * F.ln(F.lit(1.0) - F.lit(2.0) * F.abs(u))


def gumbel(scale, seed, *keys) -> Column:
    """Gumbel(scale): -b * ln(-ln(u + 0.5))."""
    u = uniform(seed, *keys)
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    return -b * F.ln(-F.ln(u + F.lit(0.5)))


def sql_uniform(seed, *keys: str) -> str:
    """The same draw in DuckDB SQL (keys are SQL expressions)."""
    parts = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return (f"((CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::BIGINT AS DOUBLE)"
            f" + 0.5) / {TWO_32} - 0.5)")


def sql_laplace(scale: str, seed, *keys: str) -> str:
    u = sql_uniform(seed, *keys)
    return f"(-({scale}) * sign({u}) * ln(1.0 - 2.0 * abs({u})))"


def sql_gumbel(scale: str, seed, *keys: str) -> str:
    u = sql_uniform(seed, *keys)
    return f"(-({scale}) * ln(-ln({u} + 0.5)))"
