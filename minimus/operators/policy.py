"""O20 per-level policy and the filler lists (our parameters, SURVEY §2.12).

The policy is a fixed three-row table, so broadcasting it is size-proven.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Starting policy (ours, untuned).
# level, level_ord, t_quantile, b_thr, b, c_frac, topk_frac, knn_frac, pass_score, max_missing
POLICY_ROWS = [
    ("low", 1, 0.10, 0.025, 0.05, 1.0, 0.9, 0.8, 0.60, 1),
    ("medium", 2, 0.40, 0.05, 0.10, 0.8, 0.6, 0.5, 0.35, 2),
    ("high", 3, 0.60, 0.10, 0.20, 0.5, 0.4, 0.3, 0.20, 3),
]
POLICY_COLUMNS = ["level", "level_ord", "t_quantile", "b_thr", "b", "c_frac", "topk_frac",
                  "knn_frac", "pass_score", "max_missing"]
POLICY_SCHEMA = T.StructType([
    T.StructField("level", T.StringType(), False),
    T.StructField("level_ord", T.IntegerType(), False),
    T.StructField("t_quantile", T.DoubleType(), False),
    T.StructField("b_thr", T.DoubleType(), False),
    T.StructField("b", T.DoubleType(), False),
    T.StructField("c_frac", T.DoubleType(), False),
    T.StructField("topk_frac", T.DoubleType(), False),
    T.StructField("knn_frac", T.DoubleType(), False),
    T.StructField("pass_score", T.DoubleType(), False),
    T.StructField("max_missing", T.IntegerType(), False),
])

MAX_ATTEMPTS = 3
ATTEMPT_STEP = 0.10      # each retry: T quantile - 0.10, fractions + 0.10
DEFAULT_SEED = 20240101

# Filler (stop) words per language (ours).
FILLERS = {
    "en": ["a", "an", "the", "and", "or", "of", "to", "in", "on", "at", "by", "for", "with",
           "from", "as", "is", "are", "was", "be", "it", "this", "that"],
    "fr": ["le", "la", "les", "de", "des", "du", "un", "une", "et", "ou", "en", "au", "aux",
           "que", "qui", "pour", "dans", "pas", "ce", "se"],
    "de": ["der", "die", "das", "den", "dem", "des", "und", "oder", "in", "zu", "von", "ein",
           "eine", "ist", "mit", "auf", "nicht", "sich"],
    "es": ["el", "la", "los", "las", "de", "del", "y", "o", "en", "que", "un", "una", "por",
           "para", "con", "se", "su", "al"],
}


def policy_df(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or POLICY_ROWS, POLICY_SCHEMA)


def noise_scales(rows=None) -> dict[str, list[str]]:
    """The policy's noise scales as decimals, by column (for ``SecretNoise``)."""
    return {name: [repr(r[POLICY_COLUMNS.index(name)]) for r in rows or POLICY_ROWS] for name in ("b_thr", "b")}


def with_policy(df: DataFrame, policy: DataFrame, level: str = "level") -> DataFrame:
    """Attach the level's parameters (policy is 3 rows: broadcast)."""
    return df.join(F.broadcast(policy), df[level] == policy["level"], "inner").drop(policy["level"])


def attempt_params(df: DataFrame, attempt: str = "attempt") -> DataFrame:
    """Per-attempt parameters: threshold quantile lowered, fractions raised."""
    step = (F.col(attempt) - 1) * F.lit(ATTEMPT_STEP)
    return (df.withColumn("q_att", F.greatest(F.lit(0.0), F.col("t_quantile") - step))
              .withColumn("c_att", F.least(F.lit(1.0), F.col("c_frac") + step))
              .withColumn("k_att", F.least(F.lit(1.0), F.col("topk_frac") + step))
              .withColumn("knn_att", F.least(F.lit(1.0), F.col("knn_frac") + step)))


def filler_map():
    """Literal lang -> array<token> map (constant-folded; no join needed)."""
    kv = []
    for lang, words in FILLERS.items():
        kv += [F.lit(lang), F.array(*[F.lit(w) for w in words])]
    return F.create_map(*kv)


# ---- DuckDB SQL spellings ----------------------------------------------------

def sql_policy_values() -> str:
    def d(x):
        return f"CAST({x!r} AS DOUBLE)"
    rows = ", ".join(
        "('{}', {}, {}, {}, {}, {}, {}, {}, {}, {})".format(
            r[0], r[1], *[d(x) for x in r[2:9]], r[9]) for r in POLICY_ROWS)
    return f"(VALUES {rows}) AS policy({', '.join(POLICY_COLUMNS)})"


def sql_attempt_params(att: str = "attempt") -> str:
    step = f"(({att} - 1) * CAST({ATTEMPT_STEP!r} AS DOUBLE))"
    return (f"greatest(CAST(0 AS DOUBLE), t_quantile - {step}) AS q_att, "
            f"least(CAST(1 AS DOUBLE), c_frac + {step}) AS c_att, "
            f"least(CAST(1 AS DOUBLE), topk_frac + {step}) AS k_att, "
            f"least(CAST(1 AS DOUBLE), knn_frac + {step}) AS knn_att")


def sql_filler_map() -> str:
    items = ", ".join(
        "'{}': [{}]".format(lang, ", ".join(f"'{w}'" for w in words))
        for lang, words in FILLERS.items())
    return "MAP {" + items + "}"


def sql_fillers_of(lang: str) -> str:
    return f"coalesce({sql_filler_map()}[{lang}], []::VARCHAR[])"
