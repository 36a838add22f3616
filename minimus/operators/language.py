"""Language of untagged prompts (for O44, O21, O23), from character trigrams.

The model is fitted on a tagged table: a trigram's weight in a language is its smoothed
log probability there, in fixed point, so that sums do not depend on order or engine. It keeps the
``TOP`` trigrams that are most frequent over all languages; each has a weight in every language.
A text gets the language with the largest sum over its trigrams, ties to the first by code point;
one without a known trigram stays ``und``.

Trigrams come from the text masked at 'high', lower-cased, with every run of other characters
than letters as one blank. Spark's columns bring the text into this form; numpy counts the trigrams of
a few MB of texts at a time by their place in the alphabet that these texts hold, so that only counts leave a
task. They are added up before the lookup, and all groups are aggregates with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pii import sql_vocabulary_text, vocabulary_text
from ..session import cut_lineage, ship_package

TOP = 2000
SCALE = 1 << 20
UNKNOWN = "und"
#: Models of at most so many rows (trigrams times languages) are broadcast.
BROADCAST_ROWS = 1 << 18


#: Text bytes that are counted at a time, and table cells that a count may take.
STEP_BYTES = 4 << 20
CELLS = 1 << 22


def letter_text(text: str) -> Column:
    """What trigrams are cut from: lower-case letter runs, one blank around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(vocabulary_text(text)), r"[^\p{L}]+", " ")), F.lit(" "))


def _pair_counts(key: np.ndarray, code: np.ndarray, keys: int, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, code, n) of the different pairs of numbers below ``keys`` and ``codes``."""
    if keys * codes <= CELLS:
        n = np.bincount(key * codes + code, minlength=1)
        at = np.flatnonzero(n)
        return at // codes, at % codes, n[at]
    found, place = np.unique(code, return_inverse=True)
    at, n = np.unique(key * len(found) + place, return_counts=True)
    return at // len(found), found[at % len(found)], n


def count_trigrams(keys: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(key, trigram, n) over texts of ``letter_text``. Two blanks meet only where one text
    ends and the next begins, so no trigram with two of them is counted."""
    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4")
    held = np.zeros(0x110000, bool)
    held[chars] = True
    alphabet = np.flatnonzero(held).astype("<u4")
    rank = np.zeros(0x110000, np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    r, m = rank[chars], len(alphabet)
    blank = chars == 32
    two = blank[1:] & blank[:-1]
    start = np.flatnonzero(~(two[1:] | two[:-1]))
    code = (r[start] * m + r[start + 1]) * m + r[start + 2]
    of = keys.dictionary_encode(null_encoding="encode")
    owner = np.repeat(of.indices.to_numpy().astype(np.int64), pc.utf8_length(texts).to_numpy())[start]
    key, code, n = _pair_counts(owner, code, len(of.dictionary), m ** 3)
    grams = np.stack([alphabet[code // (m * m)], alphabet[code // m % m], alphabet[code % m]], 1) if len(code) \
        else np.zeros((0, 3), "<u4")
    return of.dictionary.take(pa.array(key)), pa.array(grams.view("<U3").ravel(), pa.string()), pa.array(n, pa.int64())


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = pc.fill_null(b.column(1).cast(pa.string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + STEP_BYTES, "right")))
            yield pa.RecordBatch.from_arrays(list(count_trigrams(b.column(0)[i:j], texts[i:j])), ["key", "gram", "n"])
            i = j


def _part_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, n): counts of parts of the rows."""
    ship_package(rows.sparkSession)
    kind = rows.schema[key].dataType
    out = T.StructType([T.StructField("key", kind), T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])
    return rows.select(key, letter_text(text).alias("__letters")).mapInArrow(_count_batches, out).withColumnRenamed("key", key)


def _counted(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    return _part_counts(rows, key, text).groupBy(key, "gram").agg(F.sum("n").alias("n"))


def fit_language(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP) -> DataFrame:
    """(gram, lang, weight), staged: ``top`` trigrams times the languages of ``docs``."""
    counts = cut_lineage(_counted(docs.where(F.col(lang).isNotNull()).withColumnRenamed(lang, "lang"), "lang", text=text))
    kept = counts.groupBy("gram").agg(F.sum("n").alias("all"), F.map_from_entries(
        F.collect_list(F.struct("lang", "n"))).alias("of")).orderBy(F.desc("all"), "gram").limit(top)
    kept = cut_lineage(kept)
    totals = (kept.select(F.explode("of").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("total"))
              .collect())  # one row per language
    size = kept.count()
    each = F.array(*[F.struct(F.lit(r.lang).alias("lang"), F.lit(r.total).alias("total")) for r in totals]
                   or [F.struct(F.lit("").alias("lang"), F.lit(1).alias("total"))])
    rows = kept.select("gram", "of", F.explode(each).alias("l"))
    share = (F.coalesce(F.try_element_at("of", F.col("l.lang")), F.lit(0)) + F.lit(0.5)) / (F.col("l.total") + F.lit(0.5) * size)
    return cut_lineage(rows.select("gram", "l.lang", F.floor(F.ln(share) * SCALE).cast("bigint").alias("weight")))


def identify(rows: DataFrame, model: DataFrame, key: str = "pid", text: str = "text") -> DataFrame:
    """(key, lang) of every row that holds a known trigram."""
    side = F.broadcast(model) if model.count() <= BROADCAST_ROWS else model
    found = _counted(rows, key, text=text).join(side, "gram")
    sums = found.groupBy(key, "lang").agg(F.sum(F.col("n") * F.col("weight")).alias("score"))
    best = Window.partitionBy(key).orderBy(F.desc("score"), "lang")  # one row per language
    return sums.withColumn("__place", F.row_number().over(best)).where("__place = 1").select(key, "lang")


def with_language(rows: DataFrame, model: DataFrame, key: str = "pid", text: str = "text") -> DataFrame:
    """``rows`` with a ``lang`` column from the model. What was identified is staged: whoever reads the
    rows again does not count their trigrams again."""
    return rows.drop("lang").join(cut_lineage(identify(rows, model, key, text)), key, "left").withColumn(
        "lang", F.coalesce("lang", F.lit(UNKNOWN)))


# ---- DuckDB SQL spelling -------------------------------------------------------

def _sql_grams(text: str) -> str:
    t = f"(' ' || trim(regexp_replace(lower({sql_vocabulary_text(text)}), '[^\\p{{L}}]+', ' ', 'g')) || ' ')"
    return f"list_concat(list_concat(regexp_extract_all({t}, '.{{3}}'), regexp_extract_all(substring({t}, 2), '.{{3}}')), " \
           f"regexp_extract_all(substring({t}, 3), '.{{3}}'))"


def sql_identify(rows: str, docs: str, key: str = "pid") -> str:
    """(key, lang) for the rows of a query (key, text), fitted on a query (lang, text)."""
    return f"""
SELECT {key}, lang FROM (
  SELECT {key}, lang, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, lang) AS place FROM (
    WITH dg AS (SELECT lang, gram, count(*) AS n FROM (
                  SELECT lang, unnest({_sql_grams('text')}) AS gram FROM ({docs}) WHERE lang IS NOT NULL) GROUP BY lang, gram),
    kept AS (SELECT gram FROM dg GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT {TOP}),
    tot AS (SELECT lang, sum(n) AS total FROM dg WHERE gram IN (SELECT gram FROM kept) GROUP BY lang),
    model AS (SELECT k.gram, t.lang, CAST(floor(ln((coalesce(d.n, 0) + 0.5::DOUBLE)
                / (t.total + 0.5::DOUBLE * (SELECT count(*) FROM kept))) * {SCALE}) AS BIGINT) AS weight
              FROM kept k CROSS JOIN tot t LEFT JOIN dg d ON d.gram = k.gram AND d.lang = t.lang)
    SELECT r.{key}, m.lang, sum(r.n * m.weight) AS score
    FROM (SELECT {key}, gram, count(*) AS n FROM (SELECT {key}, unnest({_sql_grams('text')}) AS gram FROM ({rows}))
          GROUP BY {key}, gram) r JOIN model m USING (gram) GROUP BY r.{key}, m.lang)) WHERE place = 1"""
