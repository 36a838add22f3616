"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (byte_dedup, chat, decontaminate, jaccard, lexical, line_dedup, mix, packing, passages, quality, repair,
               token_files, topk)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@query("op2_mix_sources", mix.REPORT_SQL)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_report(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_token_output")
def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


@query("op6_chat_format", chat.REPORT_SQL)
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    return chat.chat_report(turns.unionByName(extra))


@query("op10_exact_top_k", topk.TOP_K_SQL)
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_k(rows.where("vec_id % 50 = 0"), rows, 5)


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents", "doc_id", "text"),
                                  table(spark, sf_dir, "labels", "doc_id", "quality"))


@query("op5_decontaminate", decontaminate.FIND_SQL)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents", "doc_id", "text"),
                                            table(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op9_passage_dedup")
def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_report(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op1_byte_dedup")
def op1_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup.byte_report(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_report(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op12_pack")
def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


@query("op11_repair", repair.REPORT_SQL)
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return repair.repair_report(repair.damage(turns), turns)


@query("op13_ranked_search", lexical.SEARCH_SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
