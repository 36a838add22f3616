"""O25 vocabulary / document frequency and O23 IDF lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pii import vocabulary_text, without_placeholders
from ..functions.text import distinct_tokens

# IDF tables of at most so many bytes (token bytes and ENTRY_BYTES a row) are broadcast to
# the token lookup; larger ones go through a shuffle join (AQE splits hot tokens).
BROADCAST_MAX_BYTES = 128 << 20
ENTRY_BYTES = 48

# Scores are sums of IDF values fixed to 2^-30 steps: integer sums are exact,
# so a score does not depend on the order rows were added in (any engine, any
# partitioning), and equal token sets always tie exactly.
NIDF_SCALE = 1073741824.0


def build_vocab(docs: DataFrame, key: str = "pid", text: str = "text",
                lang: str = "lang", masked: bool = False) -> DataFrame:
    """(lang, token, df): documents per token, taken from text masked at 'high'
    (``vocabulary_text``). Tokens are de-duplicated inside each document first, so the count needs no distinct and the shuffle carries
    partial counts only -- a token in every document costs one row per task.
    ``masked``: the text is masked already, at any level; the tokens are the same."""
    words = without_placeholders(text) if masked else vocabulary_text(text)
    toks = docs.select(lang, F.explode(distinct_tokens(words)).alias("token"))
    return toks.groupBy(lang, "token").agg(F.count(F.lit(1)).alias("df"))


def corpus_sizes(docs: DataFrame, lang: str = "lang") -> DataFrame:
    return docs.groupBy(lang).agg(F.count(F.lit(1)).alias("n_docs"))


def idf_table(vocab: DataFrame, sizes: DataFrame, lang: str = "lang") -> DataFrame:
    """idf = ln((1+N)/(1+df)); nidf = idf / ln(1+N) in [0, 1). N per language.
    ``sizes`` has one row per language; languages come from the data, so the join is
    left to Spark."""
    n1 = F.col("n_docs") + 1
    nidf = F.ln(n1 / (F.col("df") + 1)) / F.ln(n1)
    return (vocab.join(sizes, lang)
                 .select(lang, "token", "df", "n_docs",
                         F.ln(n1 / (F.col("df") + 1)).alias("idf"),
                         nidf.alias("nidf"),
                         F.floor(nidf * F.lit(NIDF_SCALE)).cast("bigint").alias("nidf_q")))


def lookup_bytes(idf: DataFrame) -> int:
    """Bytes of the lookup side. ``idf`` should be materialised (checkpointed)."""
    return idf.agg(F.sum(F.octet_length("token") + ENTRY_BYTES)).first()[0] or 0


def frequent_from(idf: DataFrame, limit: int) -> int:
    """The smallest power of two such that the tokens of at least so many documents take at most
    ``limit`` bytes. ``idf`` should be materialised; one row per power of two is collected."""
    sizes = idf.groupBy(F.length(F.bin("df")).alias("bits")).agg(F.sum(F.octet_length("token") + ENTRY_BYTES).alias("n"))
    cut, held = 0, 0
    for r in sizes.orderBy(F.col("bits").desc()).collect():
        held += r.n
        if held > limit:
            return cut or 1 << r.bits
        cut = 1 << (r.bits - 1)
    return cut
