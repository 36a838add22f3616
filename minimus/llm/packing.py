"""Packing: token sequences of at most ``size`` ids, cut by order-preserving dynamic programming.

The documents, in ascending doc_id order, form one stream of ids. A window of the stream is
a sequence. A window of L ids is padded to ``size``, except where L is a power of two; a
window that ends inside a document pays a truncation penalty, small at the end of a
sentence (a token that closes a word and holds a full stop, ``!`` or ``?``, unless a digit
follows) and larger elsewhere. The cheapest cuts follow from

    cost(j) = penalty(j) + min over cuts i in [j - size, j) of cost(i) + padding(j - i).

Padding is ``size`` - j + i, so the minimum is that of cost(i) + i over a sliding window: a
monotone queue gives it in constant time, and the windows of 1, 2, 4 ... ids are looked up.
Cuts are document ends and sentence ends; a sentence of more than ``LONG`` ids (a table, a
text without full stops) may also be cut every ``STEP`` ids.

Spark deals the documents to tasks by range of doc_id; each task plans its stream in runs of
about ``RUN`` ids, and the last window of a run opens the next run, so only the last
sequence of a task is cut by the end of its stream. Memory is that of one run, or of one
document where that is longer.

Defined results: a null text is an empty one (the end id alone); a null doc_id comes first;
rows with the same doc_id are documents of their own, ordered by hash and text; an empty
table gives no sequences. Other columns of the input are ignored. Sequence ids rise with
the documents; the upper bits number the task.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .token_files import END_ID, _batches, encoder

SIZE = 4096
#: Penalties, in ids of padding, of a window that ends within a document.
AT_SENTENCE, IN_SENTENCE = 16, 256
#: A sentence of more ids than LONG may be cut every STEP ids.
LONG, STEP = 64, 32
#: Ids that one run of the dynamic programme covers, about.
RUN = 1 << 19

PIECE = "struct<doc_id:long,start:long,length:long,doc_tokens:long,offset:long>"
SEQUENCES = f"sequence_id long, length long, ids binary, pieces array<{PIECE}>"
PIECE_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "offset")]))
SEQUENCE_ARROW = pa.schema([("sequence_id", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                            ("pieces", PIECE_ARROW)])


def padding(length: int, size: int = SIZE) -> int:
    """Ids that fill a sequence up: none at a power of two."""
    return 0 if length & (length - 1) == 0 else size - length


def plan(cuts: list[int], penalty: list[int], size: int = SIZE) -> tuple[int, list[int]]:
    """The least cost and the window ends that reach it. ``cuts`` are rising places, at most
    ``size`` apart, from 0 to the end of the stream; ``penalty`` is what a window pays that
    ends there."""
    none = float("inf")
    cost = [none] * (cuts[-1] + 1)  # by place
    cost[0] = 0
    came = {}
    powers = [1 << k for k in range(size.bit_length()) if 1 << k <= size]
    queue = deque([0])  # places whose cost + place rises
    for j, fine in zip(cuts[1:], penalty[1:], strict=True):
        while queue[0] < j - size:
            queue.popleft()
        at = queue[0]
        best = cost[at] + size - j + at
        for p in powers:
            if p > j:
                break
            if cost[j - p] < best:
                at = j - p
                best = cost[at]
        cost[j] = best = best + fine
        came[j] = at
        while queue and cost[queue[-1]] + queue[-1] >= best + j:
            queue.pop()
        queue.append(j)
    ends, j = [], cuts[-1]
    while j:
        ends.append(j)
        j = came[j]
    return cost[cuts[-1]], ends[::-1]


def sentence_tables(path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Per id: does it end a sentence, is it a digit."""
    enc = encoder(path, end_id)
    vocab = enc.tokenizer.get_vocab()
    size = max(max(vocab.values()), end_id) + 1
    closes, digit = np.zeros(size, bool), np.zeros(size, bool)
    for token, i in vocab.items():
        text = token.removesuffix("</w>")
        closes[i] = text != token and any(c in ".!?" for c in text) and not any(c.isalnum() for c in text)
        digit[i] = text.isdigit()
    closes[end_id] = digit[end_id] = False
    return closes, digit


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, closes: np.ndarray, digit: np.ndarray,
               size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, from 0 on, and their penalties."""
    ends = closes[ids]
    ends[:-1] &= ~digit[ids[1:]]
    places = np.union1d(np.flatnonzero(ends) + 1, np.concatenate([[0], doc_ends]))
    gap = np.diff(places)
    wide = np.flatnonzero(gap > min(LONG, size))
    step = min(STEP, size)
    more = [np.arange(places[k] + step, places[k + 1], step) for k in wide]
    fine = np.full(len(places), AT_SENTENCE, np.int64)
    fine[np.isin(places, doc_ends)] = 0
    fine[0] = 0
    if more:
        extra = np.concatenate(more)
        places = np.concatenate([places, extra])
        fine = np.concatenate([fine, np.full(len(extra), IN_SENTENCE, np.int64)])
        order = np.argsort(places, kind="stable")
        places, fine = places[order], fine[order]
    return places, fine


class Packer:
    """Sequences of a stream of documents, a run at a time."""

    def __init__(self, tables, size: int, first: int):
        self.tables, self.size, self.number = tables, size, first
        self.parts: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, doc_tokens, start, ids
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.parts.append((doc_id, len(ids), 0, ids))
        self.held += len(ids)

    def flush(self, last: bool):
        """The sequences of what is held; unless ``last``, the last window stays."""
        if not self.parts:
            return
        ids = np.concatenate([p[3] for p in self.parts])
        ends = np.cumsum([len(p[3]) for p in self.parts])
        places, fine = cut_places(ids, ends, *self.tables, self.size)
        _, windows = plan(places.tolist(), fine.tolist(), self.size)
        begin, k, at = 0, 0, 0  # window start, part, ids of that part that are used
        done = windows if last else windows[:-1]
        for end in done:
            pieces, offset = [], 0
            while offset < end - begin:
                doc_id, total, start, part = self.parts[k]
                n = min(len(part) - at, end - begin - offset)
                pieces.append({"doc_id": doc_id, "start": start + at, "length": n, "doc_tokens": total, "offset": offset})
                offset, at = offset + n, at + n
                if at == len(part):
                    k, at = k + 1, 0
            yield {"sequence_id": self.number, "length": end - begin, "ids": ids[begin:end].astype("<u4").tobytes(),
                   "pieces": pieces}
            self.number, begin = self.number + 1, end
        rest = self.parts[k:]
        if rest and at:
            doc_id, total, start, part = rest[0]
            rest[0] = (doc_id, total, start + at, part[at:])
        self.parts, self.held = rest, len(ids) - begin


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, run: int = RUN) -> DataFrame:
    """(sequence_id, length, ids binary of unsigned 32-bit integers, pieces) of ``docs``
    (doc_id, text): the sequences with what each holds."""
    def sequences(batches):
        enc = encoder(tokenizer, end_id)
        packer = Packer(sentence_tables(tokenizer, end_id), size, TaskContext.get().partitionId() << 40)

        def rows(last):
            out = list(packer.flush(last))
            for k in range(0, len(out), 256):
                yield pa.RecordBatch.from_pylist(out[k:k + 256], SEQUENCE_ARROW)

        for b in batches:
            for i, j in _batches(b.column(1)):
                ids, at = enc.ids(b.column(1)[i:j])
                for k, doc_id in enumerate(b.column(0)[i:j].to_pylist()):
                    packer.add(doc_id, ids[at[k]:at[k + 1]])
                    if packer.held >= run:
                        yield from rows(False)
        yield from rows(True)

    spread = F.xxhash64("text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange(n, F.col("doc_id"), spread).sortWithinPartitions(F.col("doc_id"), spread, "text"))
    return map_batches(ordered, sequences, SEQUENCES)


def packing_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece, with the checksum of its ids."""
    digest = F.transform("pieces", lambda p: F.struct(
        p.doc_id.alias("doc_id"), p.start.alias("start"), p.length.alias("length"),
        F.crc32(F.substring(F.col("ids"), (p.offset * 4 + 1).cast("int"), (p.length * 4).cast("int"))).alias("ids_crc32"),
        p.doc_tokens.alias("doc_tokens"), p.offset.alias("offset")))
    rows = pack(docs, tokenizer).select("sequence_id", F.explode(digest).alias("p"))
    return rows.select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset")
