"""Substring dedup of byte strings with suffix arrays.

Every byte that a 100-byte string covers which also starts earlier (smaller doc_id, or the
same document, earlier start) is removed; strings never cross documents.

Suffixes are sorted in shards by external induced sorting with common-prefix values
(``induced``). A shard holds the text around places that may repeat, never a slice of the
corpus: the anchor of a 100-byte string is its smallest hashed 32-byte piece, so equal
strings have equal anchors and meet in one shard. Spark's sort, which goes to disk, brings
the places in order of (anchor, document, position), and a task sorts the suffixes of one
bounded run of anchors after the other: a partition may be far larger than memory. Strings
whose anchor never recurs, and whole copies and equal spans, are settled before
(``anchors``), so the arrays hold what is really open.

An anchor with more than ``SHARD_SPANS`` different spans (a line in a large part of all
documents) would need a shard of unbounded size. Its strings are compared one by one
instead, by 128-bit hashes through an aggregate that splits evenly.

Defined results: a null text is empty; a row without doc_id is compared with nothing and
kept; rows that repeat a doc_id are ordered by a hash of their text, and equal rows are
copies of one another that both stay or both go; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .common import ints, map_batches, small_side, stage
from .hashing import RangeHash, mix
from .induced import suffix_array

WINDOW = 100
PIECE = 32
#: Pieces in a window.
PIECES = WINDOW - PIECE + 1
#: Spans of one anchor, and bytes of spans, that one suffix array may hold.
SHARD_SPANS = 4096
SHARD_BYTES = 1 << 20

_BYTES = mix(np.arange(256, dtype=np.uint64), 11)


#: An element's upper half is the hash that is compared, its lower half the place, so that the
#: first of equal hashes is the smallest.
_PLACE_MASK = np.uint64((1 << 32) - 1)


def _minima(h: np.ndarray, width: int) -> np.ndarray:
    """The first smallest element (upper half of the hash, place) in every run of ``width``
    elements. What is left of a hash does not depend on the part, so equal texts agree."""
    low, step = (h & ~_PLACE_MASK) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = width - step
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def _owned(data, off):
    """The anchors of a part: place, first and last start of the windows that they own,
    text, and a range hash of the bytes."""
    ranges = RangeHash(_BYTES[data], 0)
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, none, ranges
    low = _minima(ranges.every(PIECE), PIECES)
    # runs of starts with one anchor, cut where a text's starts begin and end
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    long = np.flatnonzero(np.diff(off) >= WINDOW)
    new[off[long]] = True
    stop = off[long + 1] - WINDOW + 1
    new[stop[stop < len(low)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1
    doc = np.searchsorted(off, first, "right") - 1
    inside = first + WINDOW <= off[doc + 1]
    first, last, doc = first[inside], last[inside], doc[inside]
    return (low[first] & _PLACE_MASK).astype(np.int64), first, last, doc, ranges


def _anchors(data, off):
    place, _, _, doc, ranges = _owned(data, off)
    return doc, place - off[doc], ranges.of(place, place + PIECE)


def _wanted(data, off, at, pos):
    """The owned anchors that stand at the given positions."""
    place, lo, hi, doc, ranges = _owned(data, off)
    asked = np.zeros(len(data), bool)
    asked[off[at] + pos] = True
    keep = asked[place]
    return place[keep], lo[keep], hi[keep], doc[keep], ranges


def _spans(data, off, at, pos):
    place, lo, hi, doc, ranges = _wanted(data, off, at, pos)
    end, lead = hi + WINDOW, place - lo
    extra = (lead * 256 + (end - lo)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    second = RangeHash(_BYTES[data], 1)
    return (doc, place - off[doc], ranges.of(place, place + PIECE), ranges.of(lo, end) ^ extra,
            second.of(lo, end) ^ extra, lead.astype(np.int32), (end - lo).astype(np.int32))


def _texts(data, off, at, pos):
    """Anchor and bytes of the spans; the position is the span's start."""
    place, lo, hi, doc, ranges = _wanted(data, off, at, pos)
    raw = data.tobytes()
    return (doc, lo - off[doc], ranges.of(place, place + PIECE),
            [raw[s:e] for s, e in zip(lo.tolist(), (hi + WINDOW).tolist(), strict=True)])


def _windows(data, off, at, pos):
    _, lo, hi, doc, _ = _wanted(data, off, at, pos)
    size = hi - lo + 1
    start = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
    owner = np.repeat(doc, size)
    h1, h2 = (RangeHash(_BYTES[data], seed).of(start, start + WINDOW) for seed in (2, 3))
    return owner, start - off[owner], h1, h2


def shard_repeats(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(span, offset) of the windows of the spans that also start in an earlier span, or
    earlier in their own."""
    size = np.array([len(s) for s in spans])
    begin = np.cumsum(size + 1) - size - 1
    text = np.frombuffer(b"\0".join(spans) + b"\0", np.uint8).astype(np.int16) + np.int16(2)
    ends = begin + size
    text[ends] = 1  # closes every span
    sa, lcp = suffix_array(text, WINDOW)
    of = np.repeat(np.arange(len(spans)), size + 1)
    group = np.cumsum(lcp < WINDOW)
    whole = sa + WINDOW <= ends[of[sa]]
    sa, group = sa[whole], group[whole]
    if not len(sa):
        return sa, sa
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    earliest = np.repeat(np.minimum.reduceat(sa, start), np.diff(np.append(start, len(sa))))
    at = sa[sa != earliest]
    return of[at], at - begin[of[at]]


def _sort_shards(batches):
    """Suffix arrays over runs of anchors; rows come sorted by (a, doc_id, pos)."""
    doc_ids, starts, texts, held, last = [], [], [], 0, None

    def flush():
        owner, offset = shard_repeats(texts)
        order = np.lexsort((offset, owner))
        owner, offset = owner[order], offset[order]
        new = np.ones(len(owner), bool)  # runs of consecutive starts make one span
        new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
        first = np.flatnonzero(new)
        end = np.append(first[1:], len(owner))[:len(first)] - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(doc_ids, np.int64)[owner[first]], pa.int64()),
             pa.array(np.array(starts, np.int64)[owner[first]] + offset[first], pa.int64()),
             pa.array((offset[end] - offset[first] + WINDOW).astype(np.int32), pa.int32())],
            ["doc_id", "start", "size"])

    for b in batches:
        for a, doc_id, pos, text in zip(ints(b.column("a")).tolist(), ints(b.column("doc_id")).tolist(),
                                        ints(b.column("pos")).tolist(), b.column("span").to_pylist(), strict=True):
            if a != last and held > SHARD_BYTES:
                yield flush()
                doc_ids, starts, texts, held = [], [], [], 0
            last = a
            doc_ids.append(doc_id)
            starts.append(pos)
            texts.append(text)
            held += len(text)
    if texts:
        yield flush()


def repeated_bytes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged copies (doc_id, row) and removed byte spans (doc_id, positions, sizes)."""
    rows = A.with_rows(docs, once=True)
    copies = A.split_copies(rows, by_row=True)
    rows = rows.join(small_side(copies), ["doc_id", "row"], "left_anti")
    cls = A.classes(A.with_positions(rows, A.live_positions(rows, _anchors, once_per_text=False)), _spans)
    repeats, opened = A.settle(cls, by_place=True)

    def held(places, name):
        return A.with_positions(rows, stage(places.groupBy("doc_id").agg(F.collect_list("pos").alias("positions")), name))

    texts = map_batches(held(opened.where(F.col("n_classes") <= SHARD_SPANS), "shard-documents"),
                        A.per_text(_texts, ["a", "span"], [pa.int64(), pa.binary()]),
                        "doc_id long, pos long, a long, span binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = texts.repartition(n, "a").sortWithinPartitions("a", "doc_id", "pos")
    found = map_batches(sorted_, _sort_shards, "doc_id long, start long, size int")
    windows = A.repeated_windows(held(opened.where(F.col("n_classes") > SHARD_SPANS), "hot-documents"), _windows,
                                 by_place=True)
    spans = (repeats.select("doc_id", (F.col("pos") - F.col("lead")).alias("start"), "size")
             .unionByName(found)
             .unionByName(windows.select("doc_id", F.col("pos").alias("start"), F.lit(WINDOW).alias("size"))))
    return copies, A.by_document(spans)


def _kept(b: pa.RecordBatch):
    """(doc_id, n_bytes, n_removed, n_spans, remaining bytes) of each row."""
    for i, (doc_id, row, text, copy) in enumerate(zip(*(
            b.column(c).to_pylist() for c in ("doc_id", "row", "text", "copy")), strict=True)):
        raw = text.encode()
        if copy and len(raw) >= WINDOW:
            yield doc_id, len(raw), len(raw), 1, b""
            continue
        starts, ends = A.row_spans(b, i, row)
        if not len(starts):
            yield doc_id, len(raw), 0, 0, raw
            continue
        gone = A.covered(len(raw), starts, ends)
        rises = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        yield doc_id, len(raw), int(gone.sum()), rises, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the remaining bytes, which may cut
    characters."""
    def run(batches):
        for b in batches:
            got = list(_kept(b))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([g[k] for g in got], pa.int64()) for k in range(4)),
                 pa.array([g[4] for g in got], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    copies, removed = repeated_bytes(docs)
    return A.finish(docs, copies, removed, run,
                    "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def byte_report(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            got = list(_kept(b))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([g[k] for g in got], pa.int64()) for k in range(4)),
                 pa.array([hashlib.sha256(g[4]).hexdigest() for g in got], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    copies, removed = repeated_bytes(docs)
    return A.finish(docs, copies, removed, run,
                    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
