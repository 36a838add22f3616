"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, twice over (a target may
reach two times a source's size). A document's virtual finish time is the cumulative
size of its source up to it, divided by the source's target. All queue entries are
range-sorted by that time and served until the total budget is spent. As the weights
are the targets and these sum to the budget, the budget ends at virtual time 1, where
every source has been served exactly its target: the entry then in service is cut.

DataFrame functions only. Cumulative sums run per (source, bucket of the shuffle key)
plus a prefix sum over bucket totals, so a source with a third of all rows is spread
over the buckets and no window holds a whole source.

Defined results: a null text has size 0; a null source is a source of its own, ranked
last; a row without doc_id is shuffled by its text; equal rows are separate documents; sources
without words get target 0; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import WORD, small_side, stage

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, as a fraction.
BUDGET = (3, 2)
#: A source gives at most so many times its words.
REPEATS = 2
#: Buckets of the shuffle key.
BUCKETS = 256
SEED = "mix"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target): ``budget`` of all words shared by weight, where no
    target exceeds ``repeats`` times its source and the excess goes to the others by
    weight. One row per source: with sources sorted by cap over weight, the first k
    are capped and the rest share what is left, for the first k where that holds."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.partitionBy(F.lit(1))
    per = (per
           .withColumn("__rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
           .withColumn("__w", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                           (F.col("__rank") % len(weights) + 1).cast("int")).cast("long"))
           .withColumn("__cap", F.col("source_size") * repeats)
           .withColumn("__ratio", F.col("__cap") / F.col("__w")))
    upto = everything.orderBy("__ratio", "__rank").rowsBetween(W.unboundedPreceding, -1)
    whole = everything.orderBy("__ratio", "__rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = (per
           .withColumn("__all", F.sum("source_size").over(whole))
           .withColumn("__left", F.col("__all") * budget[0] / budget[1]
                       - F.coalesce(F.sum("__cap").over(upto), F.lit(0)))
           .withColumn("__wleft", F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(upto), F.lit(0)))
           .withColumn("__level", F.col("__left") / F.col("__wleft")))
    level = F.min(F.when(F.col("__level") <= F.col("__ratio"),
                         F.struct("__ratio", "__rank", "__level"))).over(whole)
    return (per.withColumn("__cut", level)
            .withColumn("target", F.when(
                F.col("__cut").isNull()
                | (F.struct("__ratio", "__rank") < F.struct("__cut.__ratio", "__cut.__rank")),
                F.col("__cap").cast("double"))
                .otherwise(F.least(F.col("__cut.__level") * F.col("__w"), F.col("__cap").cast("double"))))
            .select("source", "source_size", "target"))


def shuffle_key(name: Column, copy: Column) -> Column:
    return F.md5(F.concat(F.lit(SEED + ":"), copy.cast("string"), F.lit(":"), name))


def queue_entries(sizes: DataFrame, targets: DataFrame, repeats: int = REPEATS,
                  buckets: int = BUCKETS) -> DataFrame:
    """One row per document and repeat that is served at all: its columns, ``copy``,
    ``served`` (words, at most size) and virtual ``start`` and ``finish``."""
    digits = len(f"{buckets - 1:x}")
    rows = (sizes.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
            .withColumn("__key", shuffle_key(F.col("__name"), F.col("copy")))
            .withColumn("__bucket", F.col("copy") * buckets
                        + F.conv(F.substring("__key", 1, digits), 16, 10).cast("int") % buckets)
            .withColumn("__src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))))
    inner = (W.partitionBy("__src", "__bucket").orderBy("__key", "size", "row")
             .rowsBetween(W.unboundedPreceding, W.currentRow))
    totals = rows.groupBy("__src", "__bucket").agg(F.sum("size").alias("__sum"))
    before = W.partitionBy("__src").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    aims = targets.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("__src"),
                          "source_size", "target")
    return (rows.withColumn("__cum", F.sum("size").over(inner))
            .join(offsets, ["__src", "__bucket"]).join(aims, "__src")
            .withColumn("__end", F.col("__base") + F.col("__cum"))
            .withColumn("__begin", F.col("__end") - F.col("size"))
            .withColumn("served", F.greatest(F.lit(0), F.least(
                F.col("size"), F.floor("target") - F.col("__begin"))).cast("long"))
            .where("served > 0")
            .withColumn("start", F.col("__begin") / F.col("target"))
            .withColumn("finish", F.col("__end") / F.col("target"))
            .select("row", "doc_id", "size", "copy", "served", "start", "finish"))


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """The narrow table that the mix works on, written once: row (a key of the row, as
    doc_id may repeat), doc_id, source, size and what the shuffle goes by: the doc_id, or a hash of
    the text where there is none, so that such rows spread as well."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    return stage(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), name.alias("__name"), *more)
                 .withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def mix_order(entries: DataFrame) -> DataFrame:
    """The entries in the order in which the mix takes them."""
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["finish", "doc_id", "copy", "row"]
    return entries.repartitionByRange(n, *order).sortWithinPartitions(*order)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, whole: a document stands there as often as the mix
    serves at least half of it. The input's columns; the order is that of the input.
    Equal rows (same doc_id and text) share their turns evenly."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    sizes = sized(docs, text.alias("__text"))
    targets = stage(source_targets(sizes), "mix-targets")
    entries = queue_entries(sizes, targets).where(F.col("served") * 2 >= F.col("size"))
    turns = (sizes.join(entries.groupBy("row").agg(F.count(F.lit(1)).alias("n")), "row", "left")
             .groupBy("doc_id", "__text").agg(F.round(F.avg(F.coalesce("n", F.lit(0)))).cast("int").alias("__turns"))
             .where("__turns > 0").select(F.col("doc_id").alias("__id"), F.col("__text"), "__turns"))
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__text"))
    out = docs.join(small_side(stage(turns, "mix-turns")), same)
    return out.withColumn("__turn", F.explode(F.sequence(F.lit(1), "__turns"))).select(*[docs[c] for c in docs.columns])


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document: size, source_size, target of its source, and the words taken."""
    sizes = sized(docs)
    targets = stage(source_targets(sizes), "mix-targets")
    entries = mix_order(queue_entries(sizes, targets))
    taken = entries.groupBy("row").agg(F.sum("served").alias("taken"))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return (sizes.withColumn("__src", key)
            .join(targets.select(key.alias("__src"), "source_size", "target"), "__src")
            .join(taken, "row", "left")
            .select("doc_id", "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


REPORT_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS name
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM per),
weighed AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 2 AS cap FROM ranked),
levels AS (
  SELECT *, cap / w AS ratio,
    ((SELECT sum(source_size) FROM per)::DOUBLE * 3 / 2
      - coalesce(sum(cap) OVER (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER (ORDER BY cap / w, rnk
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS lvl
  FROM weighed),
cut AS (SELECT ratio, rnk, lvl FROM levels WHERE lvl <= ratio ORDER BY ratio, rnk LIMIT 1),
targets AS (
  SELECT l.source, l.source_size,
    CASE WHEN c.lvl IS NULL OR (l.ratio, l.rnk) < (c.ratio, c.rnk) THEN l.cap::DOUBLE
         ELSE least(c.lvl * l.w, l.cap::DOUBLE) END AS target
  FROM levels l LEFT JOIN cut c ON true),
entries AS (
  SELECT s.*, c.copy, md5('mix:' || c.copy || ':' || s.name) AS k
  FROM sizes s CROSS JOIN (SELECT unnest([0, 1]) AS copy) c),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY copy, k, size, doc_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until
  FROM entries),
served AS (
  SELECT e.doc_id, sum(greatest(0, least(e.size, floor(t.target)::BIGINT - (e.until - e.size))))::BIGINT AS taken
  FROM summed e JOIN targets t ON e.source IS NOT DISTINCT FROM t.source GROUP BY e.doc_id)
SELECT s.doc_id, s.size, t.source_size, t.target, v.taken
FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source JOIN served v ON v.doc_id = s.doc_id
"""
