"""Benchmark decontamination: short test items inside long documents.

Words are lower-cased runs of letters and digits; an item's set is its distinct shingles of
five words (an item of fewer words has one shingle, all its words). A document is
contaminated by an item if it contains at least 80 % of the item's shingles.

Containment search with size-partitioned MinHash. Items are partitioned by the size n of
their sets. In a partition, up to m = floor(n / 5) shingles of an item may be missing, so
the signature of an item is its m + 1 smallest shingle hashes: a document that contains
the item must hold at least one of them, whatever the document's own length. Long
documents need no signature of their own: their shingle hashes probe the signatures.
Candidate pairs are then verified by counting the item's shingles, compared as text, in
the document. So nothing is missed and nothing is guessed.

DataFrame functions only. The signatures are broadcast behind a check of their written
size, else joined by a shuffle.

Defined results: null, empty and wordless texts neither contaminate nor are contaminated;
rows that repeat a doc_id count as one document holding the union of their shingles; an item_id
with several texts is reported by the text of which a document holds most; a null id is an id of
its own kind and takes no part; empty tables give no pairs. An item of fewer words than a
shingle is found wherever its words stand in a row, but ``clean_documents`` drops documents for items
of at least ``LEAST_WORDS`` words only: one common word is no leak.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, stage

SHINGLE = 5
#: Contaminated from this share of an item's shingles on: PARTS[0] / PARTS[1].
PARTS = (4, 5)
#: Words of the shortest item that removes documents.
LEAST_WORDS = SHINGLE


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(words: str, size: Column | int, make) -> Column:
    """make(i) for every window start i (0-based); empty if there are too few words."""
    n = F.size(words) - size
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), make)).otherwise(F.array())


def _hash_at(h: str, size: int):
    return lambda i: F.xxhash64(*[F.get(F.col(h), i + j) for j in range(size)])


def _text_at(words: str, size: int):
    return lambda i: F.array_join(F.slice(F.col(words), i + 1, size), " ")


def _both_at(words: str, h: str, size: int):
    return lambda i: F.struct(_text_at(words, size)(i).alias("shingle"), _hash_at(h, size)(i).alias("h"))


def item_shingles(items: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(item_id, v, k, shingle, h, n, n_sig): of each text v of an item the distinct shingles of k
    words with their hashes, the size of the set, and how many of its smallest hashes form the
    signature."""
    rows = items.where(F.col("item_id").isNotNull()).select(
        "item_id", F.xxhash64("text").alias("v"), normal_words(F.col("text")).alias("words"))
    rows = (rows.where(F.size("words") > 0)
            .withColumn("k", F.least(F.size("words"), F.lit(size)))
            .withColumn("hs", F.transform("words", lambda w: F.xxhash64(w))))
    pieces = [rows.where(F.col("k") == k).select(
        "item_id", "v", "k", F.explode(_windows("words", k, _both_at("words", "hs", k))).alias("s"))
        for k in range(1, size + 1)]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    out = out.select("item_id", "v", "k", "s.shingle", "s.h").distinct()
    per = out.groupBy("item_id", "v").agg(F.count(F.lit(1)).alias("n"))
    spare = F.floor(F.col("n") * (PARTS[1] - PARTS[0]) / PARTS[1])
    return out.join(per.withColumn("n_sig", spare + 1), ["item_id", "v"])


def signatures(shingles: DataFrame) -> DataFrame:
    """(item_id, k, h): the n_sig smallest hashes of each text of an item."""
    least = shingles.groupBy("item_id", "v", "n_sig").agg(
        F.array_sort(F.collect_set(F.struct(F.col("h"), F.col("k")))).alias("all"))
    return least.select("item_id", F.explode(F.slice("all", 1, F.col("n_sig").cast("int"))).alias("s")).select(
        "item_id", "s.k", "s.h").distinct()


def _doc_hashes(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, k, h) of every distinct shingle of the given lengths."""
    hashed = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", F.transform(normal_words(F.col("text")), lambda w: F.xxhash64(w)).alias("hs"))
    per = [hashed.select("doc_id", F.lit(k).alias("k"), F.explode(_windows("hs", k, _hash_at("hs", k))).alias("h"))
           for k in lengths]
    out = per[0]
    for p in per[1:]:
        out = out.unionByName(p)
    return out


def find_contamination(docs: DataFrame, items: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, shared, n_shingles) of every contaminated pair."""
    shingles = stage(item_shingles(items, size), "bench-shingles")
    sig = stage(signatures(shingles), "bench-signatures")
    lengths = sorted(r.k for r in shingles.select("k").distinct().collect())  # at most ``size`` numbers
    if not lengths:
        lengths = [size]
    probe = _doc_hashes(docs, lengths)
    pairs = stage(probe.join(small_side(sig), ["k", "h"]).select("doc_id", "item_id").distinct(), "bench-candidates")
    suspects = docs.where(F.col("doc_id").isNotNull()).join(small_side(stage(pairs.select("doc_id").distinct(),
                                                                            "bench-suspects")), "doc_id", "left_semi")
    words = suspects.select("doc_id", normal_words(F.col("text")).alias("words"))
    held = [words.select("doc_id", F.lit(k).alias("k"), F.explode(_windows("words", k, _text_at("words", k)))
                         .alias("shingle")) for k in lengths]
    grams = held[0]
    for g in held[1:]:
        grams = grams.unionByName(g)
    found = grams.join(small_side(shingles).select("item_id", "v", "k", "shingle", "n"), ["k", "shingle"])
    shared = (found.select("doc_id", "item_id", "v", "n", "shingle").distinct()
              .groupBy("doc_id", "item_id", "v", "n").agg(F.count(F.lit(1)).alias("shared")))
    most = F.max(F.struct((F.col("shared") / F.col("n")).alias("part"), "shared", "n")).alias("m")
    return (shared.join(pairs, ["doc_id", "item_id"], "left_semi")
            .where(F.col("shared") * PARTS[1] >= F.col("n") * PARTS[0])
            .groupBy("doc_id", "item_id").agg(most)
            .select("doc_id", "item_id", "m.shared", F.col("m.n").alias("n_shingles")))


def clean_documents(docs: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents that no item of at least ``least_words`` words contaminates."""
    items = items.where(F.size(normal_words(F.col("text"))) >= least_words)
    bad = stage(find_contamination(docs, items).select("doc_id").distinct(), "contaminated")
    return docs.join(small_side(bad), "doc_id", "left_anti").select(docs.columns)


FIND_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
            FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
       FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT DISTINCT item_id, text, least(len(w), 5) AS k,
        unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda p: array_to_string(w[p:p + least(len(w), 5) - 1], ' '))) AS s
      FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, text, count(*) AS n FROM i GROUP BY item_id, text),
d AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS s
      FROM dw, (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
c AS (SELECT d.doc_id, i.item_id, i.text, count(*) AS shared FROM d JOIN i ON d.k = i.k AND d.s = i.s GROUP BY 1, 2, 3),
best AS (SELECT c.doc_id, c.item_id, max({'part': c.shared / n.n, 'shared': c.shared, 'n': n.n}) AS m
         FROM c JOIN n USING (item_id, text) WHERE c.shared * 5 >= n.n * 4 GROUP BY c.doc_id, c.item_id)
SELECT doc_id, item_id, m.shared AS shared, m.n AS n_shingles FROM best
"""
