"""The corpus pipeline: from raw documents to token files.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns
a DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the
last return the columns of ``documents``, whatever further columns these are.

Defined results of every stage: a null text counts as an empty one, a null doc_id as an id of
its own kind; equal rows (same doc_id and text) are one document and stay or go together; ties go to
the smaller doc_id; an empty table stays empty. Clashing names of further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minimus.llm import decontaminate, jaccard, mix, quality, token_files
from minimus.llm.common import stage, table
from minimus.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Empty texts are scored like any
    other; without labels to learn from, the classifier rejects nothing that it scores at the cut."""
    model, _ = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score(docs, model).where(F.col("__score") >= quality.CUT).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of every group that the Jaccard join links. Texts without words and
    rows without doc_id are linked with nothing and stay."""
    return jaccard.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of at least five words. Rows without doc_id take no
    part in the search and stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in the numbers that the source weights ask for: a document stands there once
    or twice, or not at all. A null source is a source of its own; documents without words take
    no room and are left out."""
    return mix.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens, ids_crc32; one row per row of ``docs``, those
    without doc_id first, an empty text being its end id alone."""
    return token_files.token_output(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("jaccard", keep_one_of_each),
    ("decontaminate", keep_uncontaminated),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

#: The stages are not expressible in SQL (a fitted model, a tokenizer); they are tested
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
