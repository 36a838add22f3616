"""O21 typo correction: rare token -> frequent token of the same language at
edit distance exactly 1 (one insertion, deletion or substitution).

Candidate pairs come from an equi-join on deletion keys instead of comparing
all pairs. Every word w emits (w, 0) and (w with character i removed, i) for
i = 1..len(w). Two different words are at distance 1 exactly when they share
 * a key with the same position i > 0 (one substitution at i), or
 * a key where exactly one side has position 0 (one insertion / deletion).
So the join condition itself is exact; no distance function or candidate cap.

A candidate token has document frequency 1, so it occurs in one document only;
the vocabulary keeps that document (as ``xxhash64`` of its key, so the count
stays a hash aggregate), and corrections are applied per document with a join
on language and hash and a per-row array transform -- the corpus is never exploded into
words and regrouped. Two documents of one language whose keys share a hash get each
other's fixes, which change a text only where it holds the typo, and only one does.

Vocabularies come from text masked at 'high', and fixes are applied after masking, with
placeholders as single pieces: a letter run inside a secret is never rewritten (which
could keep the secret from being recognised), nor does it become a token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pii import PLACEHOLDER_RE, vocabulary_text
from ..functions.text import distinct_tokens

# Our candidate / target rule.
MIN_TYPO_LEN = 5      # a candidate has at least 5 letters and df == 1
MIN_TARGET_DF = 10    # a target occurs in at least 10 documents
PIECES = PLACEHOLDER_RE + r"|\p{L}+|[^\p{L}<]+|<"   # placeholders, letter runs, the rest


def doc_hash(key) -> Column:
    return F.xxhash64(F.col(key) if isinstance(key, str) else key)


def typo_vocab(docs: DataFrame, key: str = "pid", text: str = "text",
               lang: str = "lang") -> DataFrame:
    """(lang, token, df, doc): ``doc`` is the smallest key hash among the
    documents holding the token (the document itself when df == 1)."""
    toks = docs.select(lang, doc_hash(key).alias("__h"),
                       F.explode(distinct_tokens(vocabulary_text(text))).alias("token"))
    return toks.groupBy(lang, "token").agg(F.count(F.lit(1)).alias("df"),
                                           F.min("__h").alias("doc"))


def deletion_keys(w: Column) -> Column:
    """array<struct<k: string, kpos: int>> for word ``w``."""
    return F.transform(
        F.sequence(F.lit(0), F.length(w)),
        lambda i: F.struct(
            F.when(i == 0, w).otherwise(
                F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w))))
            .alias("k"),
            i.alias("kpos")))


def typo_corrections(vocab: DataFrame) -> DataFrame:
    """(lang, token, doc, fix, fix_df): best target per candidate -- highest
    document frequency, then smallest token."""
    # only lengths next to a target's: a junk run of letters emits no keys
    lengths = (vocab.where((F.col("df") >= MIN_TARGET_DF) & (F.length("token") >= MIN_TYPO_LEN - 1))
                    .select("lang", F.explode(F.array(*[F.length("token") + d for d in (-1, 0, 1)]))
                            .alias("__len")).distinct())
    cands = (vocab.where((F.col("df") == 1) & (F.length("token") >= MIN_TYPO_LEN))
                  .withColumn("__len", F.length("token")).join(lengths, ["lang", "__len"], "left_semi")
                  .select("lang", "token", "doc",
                          F.explode(deletion_keys(F.col("token"))).alias("ck")))
    targets = (vocab.where(F.col("df") >= MIN_TARGET_DF)
                    .where(F.length("token") >= MIN_TYPO_LEN - 1)
                    .select("lang", F.col("token").alias("fix"), F.col("df").alias("fix_df"),
                            F.explode(deletion_keys(F.col("token"))).alias("tk")))
    pairs = (cands.join(targets, (cands["lang"] == targets["lang"])
                        & (F.col("ck.k") == F.col("tk.k")))
                  .where(((F.col("ck.kpos") == F.col("tk.kpos")) & (F.col("ck.kpos") > 0))
                         | ((F.col("ck.kpos") == 0) != (F.col("tk.kpos") == 0)))
                  .select(cands["lang"], "token", "doc", "fix", "fix_df")
                  .distinct())
    w = Window.partitionBy("lang", "token").orderBy(F.col("fix_df").desc(), F.col("fix"))
    return (pairs.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1)
                 .drop("__rn"))


def _keep_case(piece: Column, fix: Column) -> Column:
    first = F.substr(piece, F.lit(1), F.lit(1))
    cap = F.concat(F.upper(F.substr(fix, F.lit(1), F.lit(1))), F.substr(fix, F.lit(2), F.length(fix)))
    return F.when(first != F.lower(first), cap).otherwise(fix)


# Fix maps of at most so many bytes are broadcast to the documents; above it the
# documents are joined to them with a shuffle.
FIXES_BROADCAST_MAX_BYTES = 32 << 20


def correct_typos(docs: DataFrame, corrections: DataFrame, key: str = "pid",
                  text: str = "text", materialize: bool = True,
                  max_broadcast_bytes: int = FIXES_BROADCAST_MAX_BYTES) -> DataFrame:
    """Rewrite ``text`` with each document's corrections (separators kept;
    a capitalised typo gets a capitalised fix).

    Only documents holding a typo have a fix map. The maps are checkpointed and
    measured: when small enough, they are broadcast and the documents (the large
    side) are never shuffled for this join."""
    fixes = (corrections.groupBy("lang", F.col("doc").alias("__h"))
                        .agg(F.map_from_entries(F.collect_list(F.struct("token", "fix")))
                             .alias("__fix")))
    if materialize:
        from ..session import cut_lineage
        fixes = cut_lineage(fixes)
        words = F.aggregate(F.map_entries("__fix"), F.lit(64), lambda n, e: n + 32 + F.octet_length(e["key"])
                            + F.octet_length(e["value"]))
        if (fixes.agg(F.sum(words)).first()[0] or 0) <= max_broadcast_bytes:
            fixes = F.broadcast(fixes)
    j = docs.withColumn("__h", doc_hash(key)).join(fixes, ["lang", "__h"], "left").drop("__h")
    pieces = F.regexp_extract_all(F.col(text), F.lit(PIECES), 0)
    fixed = F.array_join(F.transform(pieces, lambda p: F.coalesce(
        _keep_case(p, F.try_element_at(F.col("__fix"), F.lower(p))), p)), "")
    return (j.withColumn(text, F.when(F.col("__fix").isNull(), F.col(text)).otherwise(fixed))
             .drop("__fix"))
