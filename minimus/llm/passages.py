"""Substring dedup of word passages with difference-cover anchors.

A window is 50 consecutive words of one document. Anchors are runs of 20 words that start
at positions whose remainder modulo 31 is in a difference cover: for any two positions
there is a shift below 31 that takes both onto the cover, so two equal windows hold the
same anchor at the same offset (shift + 20 <= 50). One word in five starts an anchor and
is hashed. A match extends from its anchor: the span of an anchor is the text under all
windows that hold it at that offset; equal spans settle all their windows at once, and
only where an anchor's spans differ are the single windows compared (see ``anchors``).

Defined results: a null text has no words; a row without doc_id is compared with nothing
and kept; rows that repeat a doc_id are one document to each other (no smaller id) but
are cut separately; documents under 50 words are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .common import small_side, stage
from .hashing import RangeHash, cut_words, word_hashes

WINDOW = 50
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)  # all differences modulo 31 occur
ANCHOR = WINDOW - PERIOD + 1
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"

_ON = np.zeros(PERIOD, bool)
_ON[list(COVER)] = True


def _words(data, off):
    """Word hashes, first word of each text, and each word's text."""
    starts, ends, first = cut_words(data, off)
    return word_hashes(data, starts, ends), first, np.repeat(np.arange(len(off) - 1), np.diff(first))


def _anchors(data, off):
    h, first, doc = _words(data, off)
    local = np.arange(len(h)) - first[doc]
    size = np.diff(first)[doc]
    at = np.flatnonzero(_ON[local % PERIOD] & (local + ANCHOR <= size) & (size >= WINDOW))
    return doc[at], local[at], RangeHash(h, 0).of(at, at + ANCHOR)


def _span(first, at, pos):
    """First word and end word of the spans, as places in the part."""
    size = np.diff(first)[at]
    lo = np.maximum(pos - PERIOD + 1, 0)
    hi = np.minimum(pos, size - WINDOW)
    return first[at] + lo, first[at] + hi + WINDOW


def _spans(data, off, at, pos):
    h, first, _ = _words(data, off)
    lo, end = _span(first, at, pos)
    place = first[at] + pos
    lead, size = place - lo, end - lo
    extra = (lead * 128 + size).astype(np.uint64)
    c1, c2 = (RangeHash(h, seed).of(lo, end) ^ (extra * np.uint64(0x9E3779B97F4A7C15)) for seed in (1, 2))
    return at, pos, RangeHash(h, 0).of(place, place + ANCHOR), c1, c2, lead.astype(np.int32), size.astype(np.int32)


def _windows(data, off, at, pos):
    h, first, doc = _words(data, off)
    lo, end = _span(first, at, pos)
    on = np.flatnonzero(A.covered(len(h), lo, end - WINDOW + 1)) if len(h) else np.zeros(0, np.int64)
    h1, h2 = (RangeHash(h, seed).of(on, on + WINDOW) for seed in (3, 4))
    return doc[on], on - first[doc[on]], h1, h2


def repeated_passages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged copies (doc_id, row) and removed word spans (doc_id, positions, sizes)."""
    rows = A.with_rows(docs, once=True)
    copies = A.split_copies(rows, by_row=False)
    rows = rows.join(small_side(copies), ["doc_id", "row"], "left_anti")
    cls = A.classes(A.with_positions(rows, A.live_positions(rows, _anchors, once_per_text=True)), _spans)
    repeats, opened = A.settle(cls, by_place=False)
    places = opened.groupBy("doc_id").agg(F.collect_set("pos").alias("positions"))
    held = A.with_positions(rows, stage(places, "open-documents"))
    windows = A.repeated_windows(held, _windows, by_place=False)
    spans = repeats.select("doc_id", (F.col("pos") - F.col("lead")).alias("start"), "size").unionByName(
        windows.select("doc_id", F.col("pos").alias("start"), F.lit(WINDOW).alias("size")))
    return copies, A.by_document(spans)


def _kept(batches):
    """(doc_id, n_words, n_removed, words kept joined by a space) of each row."""
    for b in batches:
        for i, (doc_id, row, text, copy) in enumerate(zip(*(
                b.column(c).to_pylist() for c in ("doc_id", "row", "text", "copy")), strict=True)):
            raw = text.encode()
            data = np.frombuffer(raw, np.uint8)
            starts, ends, _ = cut_words(data, np.array([0, len(raw)]))
            n = len(starts)
            if copy and n >= WINDOW:
                gone = np.ones(n, bool)
            else:
                gone = A.covered(n, *A.row_spans(b, i, row))
            kept = b" ".join([raw[s:e] for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)])
            yield doc_id, n, int(gone.sum()), kept


def dedup_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, text): the kept words joined by one space."""
    def run(batches):
        for b in batches:
            got = list(_kept([b]))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([g[k] for g in got], pa.int64()) for k in range(3)),
                 pa.array([g[3].decode() for g in got], pa.string())], ["doc_id", "n_words", "n_removed", "text"])
    copies, removed = repeated_passages(docs)
    return A.finish(docs, copies, removed, run, "doc_id long, n_words long, n_removed long, text string")


def passage_report(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            got = list(_kept([b]))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([g[k] for g in got], pa.int64()) for k in range(3)),
                 pa.array([hashlib.sha256(g[3]).hexdigest() for g in got], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])
    copies, removed = repeated_passages(docs)
    return A.finish(docs, copies, removed, run, SCHEMA)
