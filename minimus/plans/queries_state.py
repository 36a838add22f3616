"""Registered jobs over stored state: the append-only log (O04), prefix scans by range over a
log (O18, O30, O50) and the corpus state that versions of documents keep up to date (O25, O23, the
histogram of O29)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus_state import CorpusState
from ..operators.policy import DEFAULT_SEED, policy_df
from ..operators.range_scan import history_by_range, single_flight_by_range
from ..schema import MESSAGE
from ..session import scratch_path
from ..sources.log_store import Log
from ..sources.messages import chat_log
from ..sources.tables import read_table
from ..streaming.jobs import read_message_stream
from .catalog import ORACLE, register
from .chain_sql import DOC_BASE, with_chain
from .queries_messages import WITH_LOG
from .queries_text import document_base
from .simplify import attempt_plan, simplify_chain


@register("append_log", WITH_LOG + "SELECT conv_id, turn, role, content, ts, simplify, simplified_message FROM log")
def q_append_log(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts appended as an epoch that is run twice, replies as a stream that is started
    twice; the log holds every row once."""
    rows = chat_log(spark, sf)
    replies = scratch_path(spark, "replies")
    rows.where(F.col("role") == "assistant").write.parquet(replies)
    log = Log(spark, scratch_path(spark, "append-log"), MESSAGE)
    for _ in range(2):
        log.append(rows.where(F.col("role") == "user"), "prompts", 0)
        log.append_stream(read_message_stream(spark, replies), "replies").awaitTermination()
    return log.read()


@register("history_by_range", ORACLE["simplify_history"])
def q_history_by_range(spark: SparkSession, sf: str) -> DataFrame:
    """O50 by a prefix scan over ranges of (conversation, turn)."""
    return history_by_range(chat_log(spark, sf))


@register("single_flight_by_range", ORACLE["single_flight"])
def q_single_flight_by_range(spark: SparkSession, sf: str) -> DataFrame:
    """O30 by a prefix scan over ranges of (conversation, turn)."""
    return single_flight_by_range(chat_log(spark, sf)).select("conv_id", "turn", "content")


# Versions of the corpus: English documents come first, the others next, and what ``labels``
# marks toxic is taken down again.
TOXIC_SQL = "(SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"
KEPT_BASE = f"SELECT * FROM ({DOC_BASE}) WHERE pid NOT IN {TOXIC_SQL}"


def corpus_versions(spark: SparkSession, sf: str) -> tuple[CorpusState, DataFrame, DataFrame]:
    """(state after two additions, all documents, the ones to take down)."""
    base = document_base(spark, sf)
    toxic = (read_table(spark, sf, "labels", ["doc_id", "toxic"]).where("toxic = 1")
             .select(F.col("doc_id").cast("string").alias("pid")))
    state = CorpusState(spark, scratch_path(spark, "corpus-state"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    state.apply(0, added=base.where(english))
    state.apply(1, added=base.where(~english))
    return state, base, base.join(toxic, "pid", "left_semi")


@register("corpus_idf", with_chain("SELECT lang, token, df, n_docs, round(idf, 6) AS idf, nidf_q FROM idf", base_sql=KEPT_BASE))
def q_corpus_idf(spark: SparkSession, sf: str) -> DataFrame:
    """The IDF table of the corpus after two additions and a take-down, from signed counts."""
    state, _, gone = corpus_versions(spark, sf)
    state.apply(2, removed=gone)
    return state.idf().select("lang", "token", "df", "n_docs", F.round("idf", 6).alias("idf"), "nidf_q")


@register("corpus_thresholds", with_chain(f"""
, kept AS (SELECT level, bin, count(*) AS n FROM (
             SELECT level, CAST(least(floor(score * 10000), 9999) AS BIGINT) AS bin FROM scored
             WHERE pid NOT IN {TOXIC_SQL}) GROUP BY level, bin)
SELECT level, attempt, CAST(min(bin) AS DOUBLE) / 10000.0 AS t
FROM (SELECT level, bin, sum(n) OVER (PARTITION BY level ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(n) OVER (PARTITION BY level) AS total FROM kept) k JOIN plan USING (level)
WHERE cum >= q_att * total GROUP BY level, attempt"""))
def q_corpus_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """O29's thresholds after a take-down: the histogram of the segments' scores under the pinned
    IDF table of version 1, merged from signed counts."""
    state, base, gone = corpus_versions(spark, sf)
    policy = policy_df(spark)
    scored = simplify_chain(base, policy, seed=DEFAULT_SEED, idf=state.idf(1)).scored
    state.apply(2, removed=gone, added_scores=scored,
                removed_scores=scored.join(gone.select("pid"), "pid", "left_semi"))
    state.compact(2)
    return state.thresholds(attempt_plan(policy))
