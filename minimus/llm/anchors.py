"""Shared steps of the two substring operators: find the places of a corpus where a
fixed-length window can occur twice, and settle most of them without looking at windows.

An operator names anchors: short strings at chosen places, such that two equal windows
always hold the same anchor at the same offset. Then

1. ``live_positions``: anchors that occur twice, and where (two shuffles of hash, doc_id
   and position; texts stay where they are);
2. ``classes``: every live anchor with a 128-bit hash of its span, the text under all
   windows that hold it. Places with equal spans are one class, aggregated map-side: only
   the first place of a class goes on, all windows of the others are repeats. So a
   passage with thousands of copies costs one place;
3. ``open_places``: first places whose anchor has several classes, which may share some
   windows but not all: the operator settles these. Where a document's own copies are no
   repeats of each other, they are open with its first place.

Whole copies of a text are settled before (``split_copies``).

Positions carry the number of a row among rows with the same doc_id in the bits from
``ROW_SHIFT`` on, so repeated ids do not mix their texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import ints, map_batches, small_side, stage, text_parts

ROW_SHIFT = 40
ROW_MASK = (1 << ROW_SHIFT) - 1


def with_rows(docs: DataFrame, once: bool = False) -> DataFrame:
    """(doc_id, row, text): ``row`` numbers the different texts of one doc_id (0 almost
    always). Rows without doc_id are left out; a null text is empty. Equal rows (same
    doc_id and text) have one (doc_id, row); ``once`` gives one row for them."""
    docs = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    twice = stage(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "ids-twice")
    if twice.isEmpty():
        return docs.select("doc_id", F.lit(0).cast("long").alias("row"), "text")
    texts = docs.join(small_side(twice), "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("h")).distinct()
    rows = stage(texts.withColumn("row", F.row_number().over(W.partitionBy("doc_id").orderBy("h")) - 1), "id-rows")
    numbered = (docs.withColumn("h", F.xxhash64("text")).join(small_side(rows), ["doc_id", "h"], "left")
                .select("doc_id", F.coalesce("row", F.lit(0)).cast("long").alias("row"), "text"))
    if not once:
        return numbered
    again = numbered.join(small_side(twice), "doc_id", "left_semi").dropDuplicates(["doc_id", "row"])
    return numbered.join(small_side(twice), "doc_id", "left_anti").unionByName(stage(again, "rows-once"))


def split_copies(rows: DataFrame, by_row: bool) -> DataFrame:
    """Staged (doc_id, row) of the texts that are whole copies of an earlier one."""
    key = rows.select("doc_id", "row", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"),
                      F.length("text").alias("n"))
    place = F.struct("doc_id", "row")
    first = key.groupBy("h1", "h2", "n").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    later = key.join(first, ["h1", "h2", "n"]).where(
        place > F.col("first") if by_row else F.col("doc_id") > F.col("first.doc_id"))
    return stage(later.select("doc_id", "row").distinct(), "copies")


def per_text(fn: Callable, names: list[str], types: list[pa.DataType]):
    """A mapInArrow function over (doc_id, row, text[, positions]) rows. For each part,
    ``fn(bytes, offsets, positions or None, first position of each text)`` gives the
    index of the text of each result row, its position in that text (-1: no position
    column) and further columns."""
    def run(batches):
        for b in batches:
            has = "positions" in b.schema.names
            doc_ids, rows = ints(b.column("doc_id")), ints(b.column("row"))
            for i, j, data, off in text_parts(b.column("text")):
                pos = at = None
                if has:
                    lists = b.column("positions").slice(i, j - i)
                    lists = lists.cast(pa.large_list(pa.int64()))
                    flat = lists.flatten().to_numpy()
                    owner = np.repeat(np.arange(j - i), np.diff(lists.offsets.to_numpy()))
                    mine = (flat >> ROW_SHIFT) == rows[i:j][owner]
                    pos, at = flat[mine] & ROW_MASK, owner[mine]
                doc, place, *more = fn(data, off, at, pos)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[i:j][doc], pa.int64()), pa.array(place + (rows[i:j][doc] << ROW_SHIFT), pa.int64()),
                     *[pa.array(c if isinstance(c, list) else c.view(np.int64) if c.dtype == np.uint64 else c, t)
                       for c, t in zip(more, types, strict=True)]],
                    ["doc_id", "pos", *names])
    return run


def live_positions(rows: DataFrame, anchors: Callable, once_per_text: bool) -> DataFrame:
    """Staged (doc_id, positions) of anchors that occur at least twice (in different
    texts, if ``once_per_text``). ``anchors(data, off)`` -> text index, position, hash."""
    def every(data, off, at, pos):
        return anchors(data, off)

    def distinct(batches):
        for b in batches:
            for _, _, data, off in text_parts(b.column("text")):
                doc, _, a = anchors(data, off)
                if once_per_text and len(a):
                    order = np.lexsort((a, doc))
                    doc, a = doc[order], a[order]
                    new = np.ones(len(a), bool)
                    new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
                    a = a[new]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64), pa.int64())], ["a"])

    live = (map_batches(rows.select("text"), distinct, "a long").groupBy("a").agg(F.count(F.lit(1)).alias("n"))
            .where("n > 1").select("a"))
    live = stage(live, "live-anchors")
    places = map_batches(rows, per_text(every, ["a"], [pa.int64()]), "doc_id long, pos long, a long")
    return stage(places.join(live, "a").groupBy("doc_id").agg(F.collect_list("pos").alias("positions")), "live-places")


def with_positions(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """The texts that have positions, with them. Their ids filter the texts first, so
    that only those texts move."""
    ids = stage(positions.select("doc_id"), "place-ids")
    return rows.join(small_side(ids), "doc_id", "left_semi").join(positions, "doc_id").select(
        "doc_id", "row", "text", "positions")


def classes(held: DataFrame, spans: Callable) -> DataFrame:
    """Staged (a, c1, c2, doc_id, pos, lead, size) of every live place: the anchor, its span's
    hash, where the anchor is, how far before it the span starts, and the span's length.
    ``spans(data, off, at, pos)`` -> text index, position, a, c1, c2, lead, size."""
    rows = map_batches(held, per_text(spans, ["a", "c1", "c2", "lead", "size"], [pa.int64()] * 3 + [pa.int32()] * 2),
                       "doc_id long, pos long, a long, c1 long, c2 long, lead int, size int")
    return stage(rows, "classes")


def settle(cls: DataFrame, by_place: bool) -> tuple[DataFrame, DataFrame]:
    """(repeats, open): staged places all of whose windows repeat an earlier place
    (doc_id, pos, lead, size), and staged places whose anchor has several classes and
    that repeat no earlier one (a, doc_id, pos, n_classes). Earlier: by (doc_id, pos), or
    by doc_id alone; then all places of the first document are open, not just the first."""
    place = F.struct("doc_id", "pos")
    first = stage(cls.groupBy("a", "c1", "c2").agg(F.min(place).alias("first")), "class-first")
    several = first.groupBy("a").agg(F.count(F.lit(1)).alias("n_classes")).where("n_classes > 1")
    others = cls.join(first, ["a", "c1", "c2"]).where(place > F.col("first"))
    opened = first.select("a", "first.*")
    if by_place:
        repeats = stage(others.select("doc_id", "pos", "lead", "size"), "repeats")
    else:
        others = stage(others.select("a", "doc_id", "pos", "lead", "size",
                                     (F.col("doc_id") > F.col("first.doc_id")).alias("later")), "repeats")
        repeats = others.where("later").select("doc_id", "pos", "lead", "size")
        opened = opened.unionByName(others.where("NOT later").select("a", "doc_id", "pos"))
    return repeats, stage(opened.join(several, "a").select("a", "doc_id", "pos", "n_classes"), "open-places")


def repeated_windows(held: DataFrame, windows: Callable, by_place: bool) -> DataFrame:
    """(doc_id, pos) of the windows of open places that occur earlier too.
    ``windows(data, off, at, pos)`` -> text index, position, h1, h2."""
    rows = stage(map_batches(held, per_text(windows, ["h1", "h2"], [pa.int64()] * 2),
                             "doc_id long, pos long, h1 long, h2 long"), "open-windows")
    place = F.struct("doc_id", "pos")
    first = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = place > F.col("first") if by_place else F.col("doc_id") > F.col("first.doc_id")
    return rows.join(first, ["h1", "h2"]).where(later).select("doc_id", "pos")


def by_document(spans: DataFrame) -> DataFrame:
    """Staged (doc_id, positions, sizes): the removed spans (start, size) of each id."""
    return stage(spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("s"))
                 .select("doc_id", F.col("s.start").alias("positions"), F.col("s.size").alias("sizes")), "removed")


def finish(docs: DataFrame, copies: DataFrame, removed: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """All documents (also those without id), with what is removed from each, through
    ``fn(batches)`` over (doc_id, row, text, copy, positions, sizes)."""
    rows = with_rows(docs).unionByName(docs.where(F.col("doc_id").isNull()).select(
        F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("row"), F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.join(small_side(copies.withColumn("copy", F.lit(True))), ["doc_id", "row"], "left").select(
        "doc_id", "row", "text", F.coalesce("copy", F.lit(False)).alias("copy"))
    # only the texts that something is removed from meet the spans
    ids = stage(removed.select("doc_id"), "removed-ids")
    cut = rows.join(small_side(ids), "doc_id", "left_semi").join(removed, "doc_id")
    whole = rows.join(small_side(ids), "doc_id", "left_anti").select(
        "*", F.array().cast("array<long>").alias("positions"), F.array().cast("array<int>").alias("sizes"))
    return map_batches(cut.unionByName(whole).select("doc_id", "row", "text", "copy", "positions", "sizes"), fn, schema)


def row_spans(b: pa.RecordBatch, i: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the spans removed from row i of a batch."""
    pos = b.column("positions")[i].values.to_numpy()
    size = b.column("sizes")[i].values.to_numpy().astype(np.int64)
    mine = (pos >> ROW_SHIFT) == row
    return pos[mine] & ROW_MASK, (pos[mine] & ROW_MASK) + size[mine]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0
