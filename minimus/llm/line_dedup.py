"""Near-duplicate lines by a deletion-neighbourhood join, edit bound 1.

A line (without surrounding white space) is removed if an earlier line, by (doc_id, line
number), is the same or one insertion, deletion or substitution away. Lines are judged
on the input. Lines under ``MIN_CHARS`` count as duplicates only when they are the same:
one edit means nothing there. Blank lines stay.

1. Every line is cut in two halves (for its own length and for one less, so that a line
   and a longer neighbour agree on the cut). One edit leaves one half as it is, so lines
   that share no hashed half with another text have no neighbour.
2. What is left is cut finer, into about sqrt(length) pieces, around each of which the
   rest must agree, so that long lines stay cheap.
3. Only inside the pieces that are left, all variants are emitted as hashed keys:
   the line without character i, tagged with i for substitutions (equal tagged keys:
   exactly one substitution apart) and untagged for deletions, beside the whole line
   itself. Equal variants are joined through one aggregate per key (the earliest member),
   never as pairs within a group.
4. Each line's earliest neighbour is verified with the edit distance of the two texts.

DataFrame functions only; keys are aggregated map-side first.

Defined results: a null text has no lines; rows with a null doc_id come first; rows that
repeat a doc_id are told apart by their row number; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, stage

MIN_CHARS = 8
SPACES = " \t\x0b\x0c\r"


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, line, n): the lines that are not blank."""
    return (docs.select("doc_id", F.xxhash64("text").alias("row"),
                        F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
            .withColumn("line", F.trim(F.col("line"), F.lit(SPACES))).where("line <> ''")
            .withColumn("n", F.length("line")))


def hashes(*cols: Column) -> list[Column]:
    """128 bits over the columns, as two numbers."""
    return [F.xxhash64(F.lit(1), *cols).alias("h1"), F.xxhash64(F.lit(2), *cols).alias("h2")]


def _left(c: str, n: Column) -> Column:
    return F.substr(F.col(c), F.lit(1), n.cast("int"))


def _right(c: str, n: Column) -> Column:
    return F.substr(F.col(c), F.length(c) - n.cast("int") + 1, n.cast("int"))


def _piece(b: Column, lo: Column, hi: Column) -> Column:
    return F.struct(b.cast("int").alias("b"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _halves() -> Column:
    """Pieces (b, lo, hi): the edit may be in [lo, hi) of a line of b characters."""
    out = []
    for b in (F.col("n"), F.col("n") - 1):
        p = F.floor(b / 2)
        out += [_piece(b, F.lit(0), p), _piece(b, p, b)]
    return F.array(*out)


def _around() -> list[Column]:
    """Key of what stands around a piece."""
    return hashes(F.col("b"), F.col("lo"), F.col("hi"), _left("line", F.col("lo")), _right("line", F.col("b") - F.col("hi")))


def _live(keys: DataFrame) -> DataFrame:
    """Keys that two different lines have. ``line_h`` tells lines apart."""
    return (keys.groupBy("h1", "h2").agg(F.min("line_h").alias("a"), F.max("line_h").alias("z"))
            .where("a <> z").select("h1", "h2"))


def _pos() -> Column:
    return F.struct("doc_id", "row", "line_no")


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no) of the lines to remove."""
    lines = lines_of(docs)
    texts = lines.select(*hashes(F.col("line")), _pos().alias("pos"))
    first = stage(texts.groupBy("h1", "h2").agg(F.min("pos").alias("first")), "line-first")
    repeats = (texts.join(first, ["h1", "h2"]).where("pos <> first").select("pos.*"))

    # 1. halves
    halves = (lines.where(F.col("n") >= MIN_CHARS)
              .select("doc_id", "row", "line_no", "line", F.xxhash64("line").alias("line_h"),
                      F.explode(_halves()).alias("p"))
              .select("doc_id", "row", "line_no", "line", "line_h", "p.*").where(F.col("b") >= MIN_CHARS)
              .select("doc_id", "row", "line_no", "line_h", "b", "lo", "hi", *_around()))
    halves = stage(halves, "line-cuts")  # read twice: the lines are cut and hashed once
    live = stage(_live(halves), "line-halves")
    # a null doc_id is an id as well
    firsts = first.select(*[F.col(f"first.{c}").alias(f"__{c}") for c in ("doc_id", "row", "line_no")])
    cand = (halves.join(small_side(live), ["h1", "h2"]).select("doc_id", "row", "line_no", "b", "lo", "hi")
            .join(firsts, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("row") == F.col("__row"))
                  & (F.col("line_no") == F.col("__line_no")), "left_semi"))
    cand = stage(cand.groupBy(F.col("doc_id").alias("__doc_id"), F.col("row").alias("__row")).agg(
        F.collect_set(F.struct("line_no", "b", "lo", "hi")).alias("cands")), "line-candidates")
    held = stage(docs.select("doc_id", F.xxhash64("text").alias("row"), F.split("text", "\n").alias("ls"))
                 .join(small_side(cand), F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("row") == F.col("__row")))
                 .dropDuplicates(["doc_id", "row"])
                 .select("doc_id", "row", "ls", F.explode("cands").alias("c"))
                 .select("doc_id", "row", "c.*", F.trim(F.get("ls", F.col("c.line_no")), F.lit(SPACES)).alias("line")),
                 "line-texts")

    # 2. finer pieces
    width = F.greatest(F.lit(8), F.ceil(F.sqrt(F.col("b").cast("double"))))
    finer = (held.withColumn("w", width.cast("int"))
             .withColumn("at", F.explode(F.sequence(F.floor(F.col("lo") / F.col("w")),
                                                    F.floor(F.greatest(F.col("lo"), F.col("hi") - 1) / F.col("w")))))
             .withColumn("lo2", (F.col("at") * F.col("w")).cast("int"))
             .withColumn("hi2", F.least((F.col("at") + 1) * F.col("w"), F.col("b")).cast("int"))
             .select("doc_id", "row", "line_no", "line", "b", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"))
             .withColumn("line_h", F.xxhash64("line")))
    finer = finer.select("*", *_around())
    live2 = stage(_live(finer), "line-pieces")
    pieces = finer.join(small_side(live2), ["h1", "h2"]).drop("h1", "h2").distinct()

    # 3. variants: 0 substitution, 1 the line itself, 2 deletion
    n = F.length("line")
    subs = (pieces.where(n == F.col("b"))
            .withColumn("i", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)))
            .select(_pos().alias("pos"), F.lit(0).alias("role"),
                    *hashes(F.lit("s"), F.col("b"), F.col("i"), _left("line", F.col("i")),
                            _right("line", F.col("b") - F.col("i") - 1))))
    selves = (pieces.where(n == F.col("b"))
              .select(_pos().alias("pos"), F.lit(1).alias("role"), *hashes(F.lit("d"), F.col("line"))).distinct())
    dels = (pieces.where(n == F.col("b") + 1)
            .withColumn("i", F.explode(F.sequence(F.col("lo"), F.col("hi"))))
            .select(_pos().alias("pos"), F.lit(2).alias("role"),
                    *hashes(F.lit("d"), F.concat(_left("line", F.col("i")), _right("line", F.col("b") - F.col("i"))))))
    variants = subs.unionByName(selves).unionByName(dels)
    earliest = variants.groupBy("h1", "h2").agg(
        *[F.min(F.when(F.col("role") == r, F.col("pos"))).alias(f"m{r}") for r in range(3)])
    earliest = earliest.where("m0 IS NOT NULL OR (m1 IS NOT NULL AND m2 IS NOT NULL)")
    partner = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = (variants.join(earliest, ["h1", "h2"]).withColumn("other", partner).where("other < pos")
             .groupBy("pos").agg(F.min("other").alias("other")))

    # 4. verification
    known = held.select(_pos().alias("pos"), "line").dropDuplicates(["pos"])
    near = (pairs.join(known, "pos")
            .join(known.select(F.col("pos").alias("other"), F.col("line").alias("line2")), "other")
            .where(F.levenshtein("line", "line2", 1) >= 0).select("pos.*"))
    return repeats.unionByName(near).distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The input's columns with the lines removed from ``text``, and ``n_lines`` (of the
    input) and ``n_removed``, which replace columns of these names."""
    gone = stage(removed_lines(docs).groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("__gone"))
                 .select(F.coalesce(F.col("doc_id"), F.lit(-1)).alias("__id"), F.col("doc_id").isNull().alias("__null"),
                         F.col("row").alias("__row"), "__gone"), "line-removed")
    rows = docs.select("*", F.coalesce(F.col("doc_id"), F.lit(-1)).alias("__id"), F.col("doc_id").isNull().alias("__null"),
                       F.xxhash64("text").alias("__row"))
    rows = rows.join(small_side(gone), ["__id", "__null", "__row"], "left").withColumn(
        "__lines", F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")))
    kept = F.array_except(F.transform("__lines", lambda x, i: i),
                          F.coalesce(F.col("__gone"), F.array().cast("array<int>")))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n"))
    return rows.select(*[c for c in docs.columns if c not in ("text", "n_lines", "n_removed")], text.alias("text"),
                       F.size("__lines").cast("long").alias("n_lines"),
                       F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))


def line_report(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed",
                      F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))
