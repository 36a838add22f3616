"""Grade-C message operators: projections, filters and routing.

All are narrow transformations (no shuffle) except the row key, which needs the
conversation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import epoch_millis_ntz, is_blank, js_trim
from .asof import row_index, turn_bucket

LEVELS = ("low", "medium", "high")
DEFAULT_LEVEL = "medium"

# The two reply texts the chat client shows when a request does
# not produce an approved answer (A: not approved; B: request failed).
TEXT_NOT_APPROVED = ("Sorry, I couldn't process your request. Please try again with "
                     "a different query or check back later.")
TEXT_FAILED = "Sorry, I'm having trouble responding right now. Please try again later."
PIPELINE_FAILED = "Pipeline failed"
APPROVED = "approved"

# Level labels shown next to a user prompt.
LEVEL_LABELS = {"low": "Low mode", "medium": "Medium mode", "high": "High mode"}


def non_blank(df: DataFrame, col: str) -> DataFrame:
    """Drop prompts that are empty after a JS trim."""
    return df.where(~is_blank(col))


def with_level(df: DataFrame, col: str = "simplify") -> tuple[DataFrame, DataFrame]:
    """Missing level -> 'medium'; values outside the enum go to quarantine.

    Returns (valid, quarantined); both are lazy filters of the same plan.
    """
    filled = df.withColumn(col, F.coalesce(F.col(col), F.lit(DEFAULT_LEVEL)))
    ok = F.col(col).isin(*LEVELS)
    return filled.where(ok), filled.where(~ok)


def level_checked(df: DataFrame, col: str = "simplify") -> DataFrame:
    """O08 as one frame: the defaulted level plus a validity flag."""
    lv = F.coalesce(F.col(col), F.lit(DEFAULT_LEVEL))
    return df.withColumn(col, lv).withColumn("level_ok", lv.isin(*LEVELS))


def build_user_rows(df: DataFrame, text: str = "text", level: str = "simplify",
                    ts: str = "ts") -> DataFrame:
    """User message rows: trimmed content, role 'user', ts and level."""
    return df.select(
        "conv_id", "turn",
        F.lit("user").alias("role"),
        js_trim(text).alias("content"),
        F.col(ts).alias("ts"),
        F.col(level).alias("simplify"),
        F.lit(None).cast("string").alias("simplified_message"),
    )


def by_role(df: DataFrame, role: str) -> DataFrame:
    """O10."""
    return df.where(F.col("role") == role)


def history_rows(df: DataFrame) -> DataFrame:
    """Assistant rows whose simplified text is not NULL ('' is kept)."""
    return df.where((F.col("role") == "assistant") & F.col("simplified_message").isNotNull())


def level_label(level: str = "simplify", role: str = "role") -> Column:
    """O15: 'Low mode' / 'Medium mode' / 'High mode' on user rows with a level."""
    lab = F.lit(None).cast("string")
    for k in reversed(LEVELS):
        lab = F.when(F.col(level) == k, F.lit(LEVEL_LABELS[k])).otherwise(lab)
    return F.when(F.col(role) == "user", lab)


def row_key(df: DataFrame, out: str = "row_key") -> DataFrame:
    """``epochMillis-idx``; idx is the 0-based position in the conversation
    (two-level count over turn buckets, so no task holds a whole conversation)."""
    t = row_index(df, "conv_id", "turn", "__idx", turn_bucket("turn"))
    return t.withColumn(out, F.concat_ws("-", epoch_millis_ntz("ts").cast("string"),
                                         F.col("__idx").cast("string"))).drop("__idx")


def public_view(df: DataFrame, allow: list[str] | tuple[str, ...]) -> DataFrame:
    """Data-minimisation projection; only allow-listed columns leave the job.
    Applied early, column pruning keeps the raw text out of every later shuffle."""
    return df.select(*allow)


def ordered(df: DataFrame, keys=("conv_id", "turn")) -> DataFrame:
    """Conversation order, made explicit (only at the edge of a job)."""
    return df.orderBy(*keys)


def append_messages(log: DataFrame, new: DataFrame) -> DataFrame:
    """Append-only union by column name."""
    return log.unionByName(new)


# ---- O03 / O12 / O13: response unwrap and routing ------------------------------

def unwrap_response(parsed: Column) -> dict[str, Column]:
    """O03 on a parsed envelope struct: success falsy -> error text."""
    ok = F.coalesce(parsed["success"], F.lit(False))
    data = parsed["data"]
    result = data["result"]
    return {
        "ok": ok,
        "error": F.when(~ok, F.coalesce(parsed["error"], F.lit(PIPELINE_FAILED))),
        "has_data": data.isNotNull(),
        "has_result": result.isNotNull(),
        "status": result["status"],
        "answer": result["answer"],
        "simplified_message": result["simplifiedMessage"],
    }


def route_response(df: DataFrame, parsed: str = "resp") -> DataFrame:
    """Response -> assistant rows, first matching case wins.

    a failed / malformed, b no ``data``      -> 1 row: text B
    c no result or status != 'approved'    -> 1 row: text A
    d approved, answer NULL                -> 2 rows: ('' , simplified), text B
    e approved, answer present             -> 1 row: answer, simplified
    ``simplified_message`` keeps NULL (O13); error routes carry NULL.
    Keeps every other input column; adds ``sub`` (order within the reply).
    """
    u = unwrap_response(F.col(parsed))
    null_s = F.lit(None).cast("string")

    def row(sub, content, simplified):
        return F.struct(F.lit(sub).alias("sub"), content.alias("content"),
                        simplified.alias("simplified_message"))

    failed = F.array(row(0, F.lit(TEXT_FAILED), null_s))
    rows = (F.when(~u["ok"] | ~u["has_data"], failed)
            .when(~u["has_result"] | ~F.coalesce(u["status"] == APPROVED, F.lit(False)),
                  F.array(row(0, F.lit(TEXT_NOT_APPROVED), null_s)))
            .when(u["answer"].isNull(),
                  F.array(row(0, F.lit(""), u["simplified_message"]),
                          row(1, F.lit(TEXT_FAILED), null_s)))
            .otherwise(F.array(row(0, u["answer"], u["simplified_message"]))))
    keep = [c for c in df.columns if c != parsed]
    return (df.select(*keep, F.explode(rows).alias("r"))
              .select(*keep, F.lit("assistant").alias("role"), "r.sub", "r.content",
                      "r.simplified_message"))
