"""Registered text queries over ``documents``: O41, O42, O26, O43, O32, O44, O25, O23."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pii import LEVELS, class_counts, mask_pii, sql_class_counts, sql_mask_pii
from ..functions.text import clean_text, sql_clean_text
from ..operators.policy import DEFAULT_SEED, policy_df, sql_policy_values, with_policy
from ..operators.segments import content_tokens
from ..operators.vocab import build_vocab, corpus_sizes, idf_table
from ..sources.tables import read_table
from .catalog import register
from .chain_sql import DOC_BASE, sql_content_tokens, with_chain
from .simplify import simplify_chain


def level_array():
    return F.array(*[F.lit(x) for x in LEVELS])


def document_base(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt table from ``documents``: pid, lang, pre-processed text (O41) and a
    privacy level picked per document."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text", "lang"], heavy=True)
    return docs.select(
        F.col("doc_id").cast("string").alias("pid"), "lang",
        clean_text("text").alias("text"),
        F.element_at(level_array(), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
        .alias("level"))


def document_chain(spark: SparkSession, sf: str, levels=None):
    return simplify_chain(document_base(spark, sf), policy_df(spark), levels=levels,
                          seed=DEFAULT_SEED)


@register("clean_text", f"""
SELECT doc_id, {sql_clean_text('text')} AS text FROM documents""")
def q_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """Preprocessing clean-up of every document."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text"], heavy=True)
    return docs.select("doc_id", clean_text("text").alias("text"))


@register("mask_pii", f"""
SELECT doc_id, level, {sql_mask_pii(sql_clean_text('text'), 'level')} AS masked
FROM documents, (SELECT unnest(['low', 'medium', 'high']) AS level)""")
def q_mask_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Every cleaned document masked at each of the three levels."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text"], heavy=True)
    lv = docs.select("doc_id", clean_text("text").alias("text"),
                     F.explode(level_array()).alias("level"))
    return lv.select("doc_id", "level", mask_pii("text", "level").alias("masked"))


def _findings_sql() -> str:
    counts = sql_class_counts(sql_clean_text("text"))
    cols = ", ".join(f"{expr} AS {name}" for name, expr in counts)
    names = ", ".join(n for n, _ in counts)
    return f"""
SELECT doc_id, pii_class, CAST(n AS BIGINT) AS n FROM (
  UNPIVOT (SELECT doc_id, {cols} FROM documents)
  ON {names} INTO NAME pii_class VALUE n)
WHERE n > 0"""


@register("pii_findings", _findings_sql())
def q_pii_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Matches per document and class -- counts only, never the values."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text"], heavy=True)
    counts = class_counts(clean_text("text"))
    wide = docs.select("doc_id", *[c.cast("bigint").alias(n) for n, c in counts])
    names = [n for n, _ in counts]
    stack = "stack({}, {}) as (pii_class, n)".format(
        len(names), ", ".join(f"'{n}', {n}" for n in names))
    return wide.select("doc_id", F.expr(stack)).where(F.col("n") > 0)


@register("segments", with_chain("SELECT pid, level, pos, seg FROM segs"))
def q_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Masked documents split into positioned segments."""
    return document_chain(spark, sf).segments.select("pid", "level", "pos", "seg")


@register("drop_repeats", with_chain("SELECT pid, level, pos, seg FROM uniq"))
def q_drop_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """First of each repeated (normalised) segment."""
    return document_chain(spark, sf).uniq.select("pid", "level", "pos", "seg")


@register("drop_filler", f"""
SELECT doc_id, array_to_string(list_sort({sql_content_tokens(sql_clean_text('text'), 'lang')}), ' ')
       AS content
FROM documents""")
def q_drop_filler(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's distinct tokens without its language's filler words."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text", "lang"], heavy=True)
    toks = content_tokens(clean_text("text"), "lang")
    return docs.select("doc_id", F.array_join(F.array_sort(toks), " ").alias("content"))


@register("vocabulary", with_chain("SELECT lang, token, df FROM vocab"))
def q_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency per (language, token)."""
    return build_vocab(document_base(spark, sf))


@register("token_idf", with_chain(
    "SELECT lang, token, df, round(idf, 6) AS idf, round(nidf, 6) AS nidf, nidf_q FROM idf"))
def q_token_idf(spark: SparkSession, sf: str) -> DataFrame:
    """The IDF lookup table."""
    base = document_base(spark, sf)
    t = idf_table(build_vocab(base), corpus_sizes(base))
    return t.select("lang", "token", "df", F.round("idf", 6).alias("idf"),
                    F.round("nidf", 6).alias("nidf"), "nidf_q")


@register("policy_join", f"""
SELECT pid, level, level_ord, pass_score, max_missing
FROM ({DOC_BASE}) b JOIN {sql_policy_values()}
  USING (level)""")
def q_policy_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each prompt with its level's parameters (3-row broadcast)."""
    base = document_base(spark, sf)
    return with_policy(base, policy_df(spark)).select(
        "pid", "level", "level_ord", "pass_score", "max_missing")
