"""Ranked lexical search: every document scored for every item, by bag deduplication.

Terms are runs of letters and digits (any character beyond ASCII counts), A-Z in lower case.
With N documents that hold a term, L terms in all of them, n terms in a document, df documents
that hold a term and tf its occurrences in the document,

    w = floor(1000 * ln((2 N + 2) / (2 df + 1)))
    m = 75 + (25 * n * N) div L
    score = sum over the item's terms, repeats included, of w * ((1000000000 * tf) div (1000 * tf + 12 * m)).

The score reads nothing of a document but the frequencies of the items' terms and m. So one
pass over the texts restricts every document to that vocabulary: a bag, sorted (term, tf)
pairs. Documents with the same bag and m form a class: the hash of both leads them to one
place, where the bags themselves are compared (an aggregate whose partial step counts a
class of copies as one row a task). Each class is scored once, against the items' posting
lists. The k best classes of an item, ties to the smallest doc_id of a class, contain its k
best documents; only the k smallest doc_ids of those classes are fetched and ranked.

Items are taken in blocks of at most about ``ITEM_BYTES`` of text and ``ITEM_ROWS`` items, all
items of an id together, so that a block's vocabulary and posting lists may be broadcast; the
documents are read once a block.

Defined results: a null or term-free text has no terms, counts nowhere and is never found;
rows with the same doc_id are documents of their own; a null doc_id comes first among equal
scores; rows that repeat an item are one, texts under one item_id are one item; an item
without terms, or whose terms no document holds, has no rows; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import map_batches, small_side, stage

K = 20
ITEM_BYTES = 4 << 20
ITEM_ROWS = 4096
#: Cells of a score table, and posting entries, that one numpy step handles.
CELLS = 1 << 21

FIRST = -(1 << 63)
_KEPT = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TABLE).split()


class ItemBlock:
    """Vocabulary and posting lists of one block of items."""

    def __init__(self, items: dict):
        self.ids = list(items)
        self.vocabulary: dict[bytes, int] = {}
        lists: list[list[tuple[int, int]]] = []
        for number, item in enumerate(self.ids):
            for term, count in sorted(Counter(items[item]).items()):
                place = self.vocabulary.setdefault(term, len(lists))
                if place == len(lists):
                    lists.append([])
                lists[place].append((number, count))
        self.offsets = np.cumsum([0] + [len(x) for x in lists])
        flat = np.array([x for y in lists for x in y], np.int64).reshape(-1, 2)
        self.items, self.counts = flat[:, 0], flat[:, 1]


def item_blocks(items: DataFrame):
    """Blocks of items, one after another."""
    rows = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    rows = rows.select("item_id", "text", F.octet_length("text").cast("long").alias("size"), F.xxhash64("item_id").alias("h"))
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    if not total.n:
        return
    blocks = max(-(-total.size // ITEM_BYTES), -(-total.n // ITEM_ROWS))
    while True:  # a hash may deal unevenly: at most twice the aim, or single items
        of = F.pmod(F.col("h"), F.lit(blocks))
        if blocks == 1 or blocks > 16 * total.n:
            break
        dealt = rows.groupBy(of.alias("b")).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.countDistinct("item_id").alias("ids"))
        if not dealt.where((F.col("ids") > 1) & ((F.col("size") > 2 * ITEM_BYTES) | (F.col("n") > 2 * ITEM_ROWS))).limit(1).count():
            break
        blocks *= 2
    for b in range(blocks):
        texts: dict = {}
        for r in rows.where(of == b).select("item_id", "text").collect():
            texts.setdefault(r.item_id, []).extend(terms(r.text.encode()))
        texts = {i: t for i, t in texts.items() if t}
        if texts:
            yield ItemBlock(dict(sorted(texts.items(), key=lambda x: (x[0] is not None, x[0]))))


def bags(docs: DataFrame, block: ItemBlock) -> DataFrame:
    """(doc_id, n, bag binary) of every document with a term: its number of terms, and its
    (place in the vocabulary, tf) pairs as sorted little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(block.vocabulary)  # bounded by ITEM_BYTES

    def restrict(batches):
        place = shared.value.get
        for b in batches:
            ids, sizes, out = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = terms(text or b"")
                if not words:
                    continue
                found = Counter(map(place, words))
                found.pop(None, None)
                ids.append(doc_id)
                sizes.append(len(words))
                out.append(np.array(sorted(found.items()), "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())],
                                             ["doc_id", "n", "bag"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(map_batches(rows, restrict, "doc_id long, n long, bag binary"), "lexical-bags")


def _pairs(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All (term, tf) pairs of a column of bags, and the number of pairs of each."""
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0]:off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data.view("<u4").reshape(-1, 2).astype(np.int64), np.diff(off) // 8


def document_frequencies(held: DataFrame, size: int) -> np.ndarray:
    """df of every vocabulary term."""
    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(_pairs(b.column(0))[0][:, 0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "df"])

    out = np.zeros(size, np.int64)
    counted = map_batches(held.select("bag"), count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in counted.collect():  # at most the vocabulary
        out[r.term] = r.df
    return out


def best_classes(classes: DataFrame, block: ItemBlock, weight: np.ndarray, k: int) -> DataFrame:
    """(item, class_id, first_id, score): per task and item the k best classes with a score
    above 0."""
    shared = classes.sparkSession.sparkContext.broadcast((block.offsets, block.items, block.counts, weight, len(block.ids)))

    def score(batches):
        offsets, items, counts, w, width = shared.value
        best = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, first_id, class_id
        least = np.ones(width, np.int64)  # what a class must reach

        def keep(parts):
            nonlocal least
            item, points, first, number = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((number, first, -points, item))
            item = item[order]
            rank = np.arange(len(item)) - np.searchsorted(item, item)
            order = order[rank < k]
            got = [x[order] for x in (np.concatenate(y) for y in zip(*parts, strict=True))]
            full = rank[rank < k] == k - 1
            least[got[0][full]] = got[1][full]
            return got

        for b in batches:
            pairs, sizes = _pairs(b.column("bag"))
            m = b.column("m").to_numpy().astype(np.int64)
            first, number = b.column("first_id").to_numpy(), b.column("class_id").to_numpy()
            term, tf = pairs[:, 0], pairs[:, 1]
            row = np.repeat(np.arange(len(sizes)), sizes)
            value = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
            listed = offsets[term + 1] - offsets[term]
            work = np.maximum(np.bincount(row, listed, len(sizes)).astype(np.int64), width)
            ends = np.cumsum(sizes)
            at, done = 0, np.cumsum(work)
            fresh, waiting = [], 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CELLS, "right")))
                some = slice(ends[at] - sizes[at], ends[to - 1])
                times = listed[some]
                stop = np.cumsum(times)
                entry = np.arange(stop[-1] if len(stop) else 0) + np.repeat(offsets[term[some]] - (stop - times), times)
                points = np.repeat(value[some], times) * counts[entry]
                cell = np.repeat(row[some] - at, times) * width + items[entry]
                # two exact halves: each sum stays below 2**53
                cells = (to - at) * width
                total = (np.bincount(cell, points >> 24, cells).astype(np.int64) << 24) + \
                    np.bincount(cell, points & 0xFFFFFF, cells).astype(np.int64)
                hit = np.flatnonzero(total >= np.tile(least, to - at))
                which = at + hit // width
                fresh.append([hit % width, total[hit], first[which], number[which]])
                waiting += len(hit)
                if waiting > CELLS:
                    best, fresh, waiting = keep([best, *fresh]), [], 0
                at = to
            if fresh:
                best = keep([best, *fresh])
        for i in range(0, len(best[0]), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 65536], pa.int64()) for x in best],
                                             ["item", "score", "first_id", "class_id"])

    return map_batches(classes.select("bag", "m", "first_id", "class_id"), score,
                       "item long, score long, first_id long, class_id long")


def _search_block(docs: DataFrame, block: ItemBlock, k: int) -> DataFrame:
    spark = docs.sparkSession
    held = bags(docs, block)
    size = held.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    documents, total = size.documents, size.terms or 1
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1)))
                       for df in document_frequencies(held, len(block.vocabulary))], np.int64)
    held = held.where(F.octet_length("bag") > 0).select(
        "doc_id", "bag", F.expr(f"75 + (cast(n as decimal(18, 0)) * {25 * documents}BD) div {total}BD").alias("m"))
    held = held.withColumn("h", F.xxhash64("bag", "m"))
    first = F.min(F.coalesce("doc_id", F.lit(FIRST))).alias("first_id")
    classes = stage(held.groupBy("h", "bag", "m").agg(first).withColumn("class_id", F.monotonically_increasing_id()),
                    "lexical-classes")
    of_item = W.partitionBy("item").orderBy(F.desc("score"), "first_id", "class_id")
    best = (best_classes(classes, block, weight, k).withColumn("place", F.row_number().over(of_item))
            .where(F.col("place") <= k).select("item", "score", "class_id"))
    best = stage(best, "lexical-best")
    wanted = stage(classes.join(small_side(stage(best.select("class_id").distinct(), "lexical-wanted")), "class_id")
                   .select("h", "bag", "m", "class_id"), "lexical-classes-wanted")
    of_class = W.partitionBy("class_id").orderBy("doc_id")
    members = (held.join(small_side(wanted), ["h", "bag", "m"]).select("class_id", "doc_id")
               .withColumn("place", F.row_number().over(of_class)).where(F.col("place") <= k).drop("place"))
    ranked = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    found = (best.join(members, "class_id").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k))
    schema = "item long, item_id long"
    names = spark.createDataFrame(list(enumerate(block.ids)), schema)
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents."""
    out = None
    for block in item_blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        found = _search_block(docs, block, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


SEARCH_SQL = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
docs AS (SELECT doc_id, r, t, len(t) AS n FROM texts WHERE len(t) > 0),
totals AS (SELECT count(*) AS big_n, sum(n) AS big_l FROM docs),
freq AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) GROUP BY r, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM freq, totals GROUP BY term, big_n),
lengths AS (SELECT doc_id, r, 75 + (25 * n * big_n) // big_l AS m FROM docs, totals),
items AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
scores AS (
  SELECT i.item_id, d.doc_id, d.r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM items i JOIN weights USING (term) JOIN freq f USING (term) JOIN lengths d ON d.r = f.r
  GROUP BY i.item_id, d.doc_id, d.r),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
