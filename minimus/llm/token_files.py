"""Token-ID output: one zstandard frame per document, a shared dictionary, an offset index.

File format, under one folder that Spark's writers fill (so a lost task leaves no half
file, and any store that Spark writes to will do):

* ``dictionary/``: one row (dict_hash, dictionary): sha256 hex and bytes of the shared
  zstandard dictionary, trained on serialized id arrays of a bounded sample.
* ``blocks/``: one row per block of consecutive documents: shard, block, first_id and
  last_id, n_ids, dict_hash, width (bytes of an id, little-endian), payload (the
  documents' frames, one after another) and ``docs``, the offset index: an array of
  (doc_id, start within the shard, n_tokens, offset and length of the frame).
* ``shards/``: one row per shard: shard, base (ids in all shards before it), n_ids.

Shards are ranges of doc_id, so ids run in ascending doc_id order over shards and blocks.
A few documents are read by opening only the blocks that can hold them and
decompressing only their frames.

Defined results: a null text is encoded as an empty one (the end id alone); a null doc_id
comes first; rows with the same doc_id stand next to each other, ordered by text; an
empty table gives files without blocks. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import map_batches, stage

END_ID = 2
#: Documents and bytes of id pieces that the dictionary is trained on, at most.
SAMPLE_DOCS = 2000
SAMPLE_BYTES = 4 << 20
PIECE_BYTES = 4 << 10
DICT_BYTES = 64 << 10
#: A block ends at so many payload bytes or documents.
BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 4096
#: Distinct words whose ids a worker keeps, and bits of its table of words met once: a word is
#: kept when it is met again, so that words that never recur take no room.
CACHE_WORDS = 300_000
SEEN_BITS = 22
LEVEL = 3

BLOCKS = ("shard int, block int, first_id long, last_id long, n_ids long, dict_hash string, width int, "
          "payload binary, docs array<struct<doc_id:long,start:long,n_tokens:long,offset:long,length:long>>")
INDEX = pa.list_(pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "offset", "length")]))
BLOCK_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()),
                         ("last_id", pa.int64()), ("n_ids", pa.int64()), ("dict_hash", pa.string()),
                         ("width", pa.int32()), ("payload", pa.binary()), ("docs", INDEX)])


def _byte_characters() -> dict[int, int]:
    """The character that byte-level BPE writes for each byte: printable Latin-1 bytes
    stand for themselves, the others follow from 256 on, in order (fixed by the format)."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in own]
    return {x: x for x in own} | {x: 256 + i for i, x in enumerate(rest)}


#: What the shortcut of ``Encoder`` rests on; a tokenizer with other steps is refused.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "behavior": "Removed", "invert": True, "pattern": {
        "Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class Encoder:
    """Serialized ids of texts.

    The tokenizer drops white space and joins nothing across it, so a text's ids are those
    of its pieces between ASCII white space. Arrow splits the texts and finds the distinct
    pieces; each is encoded once and kept, up to ``CACHE_WORDS`` of them, and numpy lays the
    ids out. Pieces that are Latin-1 letters, perhaps with final punctuation, are a run of
    letters and a run of punctuation for the tokenizer, so their lower-case letters go to
    its BPE model directly; all others go through the whole pipeline."""

    def __init__(self, path: str, end_id: int = END_ID):
        import json

        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.code = "<%d" + {2: "H", 4: "I"}[self.width]
        self.end = end_id.to_bytes(self.width, "little")
        self.cache: dict[str, bytes] = {}
        self.seen = np.zeros(1 << SEEN_BITS, bool)
        self.tails = {"": b""}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [x["content"] for x in spec.get("added_tokens", [])]
        if (spec.get("normalizer") != NORMALIZER or spec.get("pre_tokenizer") != PRE_TOKENIZER
                or any(re.search(r"\s", x) or not re.search(r"[^A-Za-z]", x.rstrip(".,!?")) for x in added)):
            raise ValueError(f"{path}: not a tokenizer with word ends, lower case and dropped white space")
        self.table = _byte_characters()

    def _stem(self, stem: str) -> bytes:
        """Ids of lower-case Latin-1 letters."""
        if not stem.isascii():
            stem = stem.encode().decode("latin-1").translate(self.table)
        ids = [t.id for t in self.model.tokenize(stem)]
        return struct.pack(self.code % len(ids), *ids)

    def _learn(self, pieces: list[str], known: dict[str, bytes]) -> None:
        rest = []
        for w in pieces:
            stem = w.rstrip(".,!?")
            if stem.isalpha() and (stem.isascii() or max(stem) < "\u0100"):
                low = stem.lower()
                ids = self.cache.get(low) or known.get(low)
                if ids is None:
                    ids = known[low] = self._stem(low)
                if len(w) > len(stem):
                    tail = w[len(stem):]
                    if tail not in self.tails:
                        self.tails[tail] = self._full([tail])[0]
                    ids += self.tails[tail]
                known[w] = ids
            else:
                rest.append(w)
        known.update(zip(rest, self._full(rest), strict=True))

    def _keep(self, known: dict[str, bytes]) -> None:
        """Keep the words that were met before; remember that the others were met."""
        words = list(known)
        at = np.fromiter(map(hash, words), np.int64, len(words)) & ((1 << SEEN_BITS) - 1)
        again = self.seen[at]
        self.seen[at] = True
        room = CACHE_WORDS - len(self.cache)
        self.cache.update((words[i], known[words[i]]) for i in np.flatnonzero(again)[:room].tolist())

    def _full(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes()
                for i in range(0, len(pieces), 20_000)
                for e in self.tokenizer.encode_batch_fast(pieces[i:i + 20_000], add_special_tokens=False)]

    def ids(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, end ids included, and where each text's begin
        (one place more than texts). A null text counts as empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(col, ""))
        found = lists.flatten().dictionary_encode()
        words = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts = list(map(self.cache.get, words))
        new = [i for i, x in enumerate(parts) if x is None]
        known: dict[str, bytes] = {}  # for these texts only
        self._learn([words[i] for i in new], known)
        for i in new:
            parts[i] = known[words[i]]
        if len(self.cache) < CACHE_WORDS:
            self._keep(known)
        parts.append(self.end)
        flat = np.frombuffer(b"".join(parts), self.dtype)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.width
        first = np.cumsum(size) - size
        off = lists.offsets.to_numpy().astype(np.int64)
        piece = np.insert(found.indices.to_numpy().astype(np.int64), off[1:] - off[0], len(words))
        length = size[piece]
        stop = np.cumsum(length)
        place = np.repeat(first[piece] - (stop - length), length)
        place += np.arange(len(place))
        starts = np.concatenate([[0], stop[off[1:] - off[0] + np.arange(len(col))]])
        return flat[place], starts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The serialized ids of each text."""
        ids, at = self.ids(pa.array(texts, pa.string()))
        data = memoryview(ids.tobytes())
        return [bytes(data[i:j]) for i, j in zip(at[:-1] * self.width, at[1:] * self.width, strict=True)]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """The worker's encoder: tasks that follow one another share its pieces."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def forget_encoders() -> None:
    """A worker that goes on to other work keeps no words."""
    _ENCODERS.clear()


def _batches(col: pa.Array, step: int = 2 << 20):
    """Consecutive slices of about ``step`` text bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + step, "right")))
        yield i, j
        i = j


def _sample(df: DataFrame, key: Column, rows: int, most: int) -> DataFrame:
    """About ``most`` of the ``rows`` rows: those whose hashed key is below a threshold, so
    each task picks its own and nothing is sorted. All of them if there are no more."""
    if rows <= most:
        return df
    return df.where(F.pmod(key, F.lit(1 << 32)) < int((1 << 32) * most / rows))


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> bytes:
    """Dictionary over 4 KB pieces of the whole id arrays of a bounded sample: about
    ``SAMPLE_DOCS`` documents and at most ``SAMPLE_BYTES`` of pieces, chosen by hash. Empty
    if there is too little."""
    def pieces(batches):
        enc = encoder(tokenizer, end_id)
        for b in batches:
            for i, j in _batches(b.column(0)):
                out = [x[k:k + PIECE_BYTES] for x in enc.encode(b.column(0)[i:j].to_pylist())
                       for k in range(0, len(x), PIECE_BYTES)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["piece"])

    some = _sample(docs.select("doc_id", "text"), F.xxhash64("doc_id", "text"), docs.count(), SAMPLE_DOCS)
    cut = stage(map_batches(some.select("text"), pieces, "piece binary"), "dictionary-pieces")
    most = SAMPLE_BYTES // PIECE_BYTES
    got = _sample(cut, F.xxhash64("piece"), cut.count(), most).limit(2 * most).collect()
    samples = sorted(bytes(r.piece) for r in got)
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples
        return b""


def _dict(data: bytes):
    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the files described above for ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    dictionary = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_hash string, dictionary binary") \
        .coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICT_BYTES

    def blocks(batches):
        enc = encoder(tokenizer, end_id)
        zip_ = zstandard.ZstdCompressor(level=LEVEL, **_dict(shared.value))
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        index, frames, size = [], [], 0

        def row():
            ids = [x["doc_id"] for x in index]
            one = {"shard": shard, "block": block, "first_id": ids[0], "last_id": ids[-1],
                   "n_ids": sum(x["n_tokens"] for x in index), "dict_hash": digest, "width": enc.width,
                   "payload": b"".join(frames), "docs": index}
            return pa.RecordBatch.from_pylist([one], BLOCK_ARROW)

        for b in batches:
            for i, j in _batches(b.column(1)):
                ids, at = enc.ids(b.column(1)[i:j])
                data = memoryview(ids).cast("B")
                for k, doc_id in enumerate(b.column(0)[i:j].to_pylist()):
                    n = int(at[k + 1] - at[k])
                    frame = zip_.compress(data[at[k] * enc.width:at[k + 1] * enc.width])
                    index.append({"doc_id": doc_id, "start": start, "n_tokens": n, "offset": size, "length": len(frame)})
                    frames.append(frame)
                    start, size = start + n, size + len(frame)
                    if size >= BLOCK_BYTES or len(index) >= BLOCK_DOCS:
                        yield row()
                        block, index, frames, size = block + 1, [], [], 0
        if index:
            yield row()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    map_batches(ordered, blocks, BLOCKS).write.parquet(f"{path}/blocks")
    from pyspark.sql import Window as W
    before = W.partitionBy(F.lit(1)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    (spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
     .select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"), "n_ids")
     .write.parquet(f"{path}/shards"))


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None, crc: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, width, ids binary) from the files; of ``doc_ids`` only, if given.
    ``crc``: ids_crc32 (see ``checksums``) in place of width and ids, taken by the worker that reads, so that
    the ids do not travel to a second one beside it."""
    head = spark.read.parquet(f"{path}/dictionary").first()
    shared = spark.sparkContext.broadcast(bytes(head.dictionary))
    digest = head.dict_hash
    if hashlib.sha256(shared.value).hexdigest() != digest:
        raise ValueError(f"{path}: the dictionary does not match its hash")
    wanted = set(doc_ids) if doc_ids is not None else None
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if wanted is not None:
        lo, hi = min(wanted, default=0), max(wanted, default=-1)
        blocks = blocks.where((F.col("last_id") >= lo) & (F.col("first_id") <= hi)).where(
            F.exists("docs", lambda d: d.doc_id.isin(list(wanted))))

    def documents(batches):
        forget_encoders()
        unzip = zstandard.ZstdDecompressor(**_dict(shared.value))
        for b in batches:
            for one in range(b.num_rows):
                row = b.slice(one, 1)
                if row.column("dict_hash")[0].as_py() != digest:
                    raise ValueError("a block was written with another dictionary")
                payload = memoryview(row.column("payload")[0].as_buffer())
                shard, width = row.column("shard")[0].as_py(), row.column("width")[0].as_py()
                docs = row.column("docs")[0].as_py()
                for k in range(0, len(docs), 512):
                    got = [d for d in docs[k:k + 512] if wanted is None or d["doc_id"] in wanted]
                    ids = [unzip.decompress(payload[d["offset"]:d["offset"] + d["length"]]) for d in got]
                    own = [pa.array([_crc32(x, width) for x in ids], pa.int64())] if crc else \
                        [pa.array([width] * len(got), pa.int32()), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * len(got), pa.int32())]
                        + [pa.array([d[c] for d in got], pa.int64()) for c in ("doc_id", "start", "n_tokens")]
                        + own, ["shard", "doc_id", "local", "n_tokens", *names])

    names = ["ids_crc32"] if crc else ["width", "ids"]
    rows = map_batches(blocks, documents, "shard int, doc_id long, local long, n_tokens long, "
                       + ("ids_crc32 long" if crc else "width int, ids binary"))
    base = spark.read.parquet(f"{path}/shards").select("shard", "base")
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", *names)


def _crc32(ids, width: int) -> int:
    return zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())


def checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): crc32 of the ids as unsigned 32-bit integers."""
    def crc(batches):
        for b in batches:
            out = [_crc32(x.as_buffer(), w.as_py()) for x, w in zip(b.column("ids"), b.column("width"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in ("doc_id", "start", "n_tokens")]
                                             + [pa.array(out, pa.int64())],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])
    return map_batches(rows, crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to a fresh folder in the shared scratch area, read the files back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer)
    return read_token_files(docs.sparkSession, path, crc=True)
