"""Exact n-gram Jaccard join with set-relation skipping, and its connected components.

Texts are sets of 4-word shingles (hashed to 64 bits); two link when the intersection is at
least 85 % of the union. Equal sets are one node from the start. Then:

* Prefix index. A set's shingles are ordered rare first, by a count sketch of fixed size
  (any common order is right, a rare-first one is fast), and linked sets share one of
  their first shingles. The index lists (shingle -> node, set size, place of the shingle)
  are rows, joined and aggregated by Spark; lists with one node go at once.
* Skipping by position. In a list, nodes are in blocks of equal set size and place. What
  two sets can still share follows from these alone, so a block passes or is skipped as
  a whole.
* Answers from a similar set's answers. First, every node is compared with one pivot, the
  smallest set of a list and size class that it meets most often. Nodes linked to a
  pivot have its answers: within a component nothing more is asked. Then, in rounds, the
  nodes outside a list's largest component ask: each is compared with the nodes of other
  components that it may be linked with, the nearest first (4, then 64 ... of them), and
  links merge components before the next round. A pair whose distances to a common pivot
  differ by more than a link allows is skipped (Jaccard distance obeys the triangle
  inequality), as is a pair whose parity maps (one bit per hashed shingle, flipped by
  each) differ in more bits than linked sets have unshared shingles. It ends when
  nobody has anyone left to ask, so no link between components is lost; a round's questions
  are a few per node and list, whatever a list's length.

Long lists are dealt over chunks, and askers go to all chunks of their lists. A comparison brings one text to the other's; a pivot with many partners is repeated over
salted groups of bounded size.

Defined results: a null text or one without words has an empty set, linked with nothing;
a text under four words is one shingle, the whole sequence; a row without doc_id is
linked with nothing and has no component; rows that repeat a doc_id are texts of their
own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .anchors import with_rows
from .common import ints, map_batches, small_side, stage, text_parts
from .components import components
from .hashing import LOWER, RangeHash, cut_words, mix, word_hashes

SHINGLE = 4
#: Linked from 85 / 100 of the union on.
NUM, DEN = 85, 100
#: Counters of the sketch: a fixed 8 MB, whatever the input.
SKETCH = 1 << 21
CHUNK = 1 << 15
#: Partners that a group compares with one text, and rows that one merge step adds up.
PARTNERS = 128
MERGE = 64
#: Rows of a chunk of a list, about; pairs that one numpy step looks at.
LIST_CHUNK = 4096
PAIR_STEP = 1 << 17
#: Names that a node gets in the first round, and how many times more in each further one.
FIRST, MORE = 4, 16
#: Bits of a set's parity map.
PARITY = 512


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = SHINGLE):
    """(text, hash) of the distinct shingles of each text, sorted by text and hash."""
    starts, ends, first = cut_words(data, off)
    words = np.diff(first)
    h = RangeHash(word_hashes(LOWER[data], starts, ends), 0)
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(off) - 1), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    out = h.of(at, np.minimum(at + size, first[doc + 1]))
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (out[1:] != out[:-1])
    return doc[new], out[new]


def fingerprints(rows: DataFrame) -> DataFrame:
    """The rows' columns but text, with n (set size), a 128-bit fingerprint of the set and
    its parity map."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches):
        for b in batches:
            for i, j, data, off in text_parts(b.column("text")):
                doc, h = shingle_sets(data, off)
                n = np.bincount(doc, minlength=j - i)
                sums = []
                for seed in (1, 2):
                    total = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(mix(h, seed), out=total[1:])
                    edge = np.concatenate([[0], np.cumsum(n)])
                    sums.append(mix(total[edge[1:]] - total[edge[:-1]], seed).view(np.int64))
                bit = (mix(h, 5) % np.uint64(PARITY)).astype(np.int64)
                odd = np.bincount(doc * PARITY + bit, minlength=(j - i) * PARITY) & 1
                maps = np.packbits(odd.astype(np.uint8).reshape(j - i, PARITY), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(i, j - i) for c in names), pa.array(n, pa.int64()),
                     *(pa.array(s, pa.int64()) for s in sums),
                     pa.array([m.tobytes() for m in maps], pa.binary())], [*names, "n", "f1", "f2", "parity"])

    kinds = ", ".join(f"{c} long" for c in names)
    return map_batches(rows.select(*names, "text"), run, f"{kinds}, n long, f1 long, f2 long, parity binary")


def shingle_counts(rows: DataFrame) -> np.ndarray:
    """Count sketch over the shingles of all texts: ``SKETCH`` counters. Tasks count into
    counters of their own, which are added up chunk by chunk, ``MERGE`` at a time."""
    def count(batches):
        from pyspark import TaskContext
        total = np.zeros(SKETCH, np.uint32)
        for b in batches:
            for _, _, data, off in text_parts(b.column("text")):
                _, h = shingle_sets(data, off)
                np.add.at(total, (h & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
        if total.any():
            part = TaskContext.get().partitionId()
            for c in range(SKETCH // CHUNK):
                piece = total[c * CHUNK:(c + 1) * CHUNK]
                yield _sketch_row([c], [part], [_packed(piece)])

    def add(key, t):
        total = sum(_unpacked(x.as_py()).astype(np.int64) for x in t.column("counts"))
        total = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
        return pa.Table.from_batches([_sketch_row([key[0].as_py()], [key[1].as_py()], [_packed(total)])])

    schema = "chunk int, part int, counts binary"
    got = stage(map_batches(rows.select("text"), count, schema), "sketch")
    fan = got.agg(F.max("part")).first()[0]
    while fan:
        got = stage(got.withColumn("part", F.floor(F.col("part") / MERGE).cast("int"))
                    .groupBy("chunk", "part").applyInArrow(add, schema), "sketch")
        fan //= MERGE
    out = np.zeros(SKETCH, np.uint32)
    for r in got.collect():  # SKETCH counters
        out[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] += _unpacked(bytes(r.counts))
    return out


def _packed(x: np.ndarray) -> bytes:
    import zlib
    return zlib.compress(x.astype("<u4").tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    import zlib
    return np.frombuffer(zlib.decompress(x), "<u4")


def _sketch_row(chunk, part, counts):
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(part, pa.int32()),
                                       pa.array(counts, pa.binary())], ["chunk", "part", "counts"])


def need(nx, ny):
    """Shingles that linked sets of these sizes share at least."""
    return -(-NUM * (nx + ny) // (NUM + DEN))


def size_class(n):
    """Linked sets are in the same or neighbouring classes."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * DEN // NUM + 1)
    return np.searchsorted(np.array(edges), n, "right")


def prefixes(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """(tok, nid, n, pos, cls): the first shingles of each set of (nid, text), rare first."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)  # SKETCH counters

    def run(batches):
        for b in batches:
            nids = ints(b.column("nid"))
            for i, j, data, off in text_parts(b.column("text")):
                doc, h = shingle_sets(data, off)
                order = np.lexsort((h, shared.value[(h & np.uint64(SKETCH - 1)).astype(np.int64)], doc))
                doc, h = doc[order], h[order]
                n = np.bincount(doc, minlength=j - i)
                first = np.cumsum(n) - n
                pos = np.arange(len(doc)) - first[doc]
                size = n[doc]
                keep = pos <= size - -(-NUM * size // DEN)
                size = size[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[keep].view(np.int64), pa.int64()), pa.array(nids[i:j][doc[keep]], pa.int64()),
                     pa.array(size.astype(np.int32), pa.int32()), pa.array(pos[keep].astype(np.int32), pa.int32()),
                     pa.array(size_class(size).astype(np.int32), pa.int32())], ["tok", "nid", "n", "pos", "cls"])

    return map_batches(rows.select("nid", "text"), run, "tok long, nid long, n int, pos int, cls int")


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, shared, together): sizes of intersection and union of the sets of each pair
    (a, b) of nodes; ``texts`` is (nid, text). Groups hold one text b and at most about
    ``PARTNERS`` texts a."""
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("k"))
    salted = stage(pairs.join(many, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("k")).cast("int"))
                   .select("a", "b", "salt"), "pairs")
    ids = stage(salted.select(F.col("a").alias("nid")).unionByName(salted.select(F.col("b").alias("nid"))).distinct(), "pair-nodes")
    held = texts.join(small_side(ids), "nid", "left_semi")
    left = held.join(small_side(salted.withColumnRenamed("a", "nid")), "nid").select(
        "b", "salt", F.lit(1).alias("role"), F.col("nid").alias("a"), "text")
    right = held.withColumnRenamed("nid", "b").join(small_side(stage(salted.select("b", "salt").distinct(), "pivots")), "b").select(
        "b", "salt", F.lit(0).alias("role"), F.col("b").alias("a"), "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = left.unionByName(right).repartition(n, "b", "salt").sortWithinPartitions("b", "salt", "role")

    def run(batches):
        pivot = np.zeros(0, np.uint64)
        for batch in batches:
            for i, j, data, off in text_parts(batch.column("text")):
                doc, h = shingle_sets(data, off)
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                roles = ints(batch.column("role").slice(i, j - i))
                at, shared, union = [], [], []
                for k, role in enumerate(roles.tolist()):
                    mine = h[edge[k]:edge[k + 1]]
                    if role == 0:
                        pivot = mine
                        continue
                    place = np.searchsorted(pivot, mine)
                    place[place == len(pivot)] = 0
                    both = int((pivot[place] == mine).sum()) if len(pivot) else 0
                    at.append(k)
                    shared.append(both)
                    union.append(len(mine) + len(pivot) - both)
                idx = pa.array([i + k for k in at], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a").take(idx), batch.column("b").take(idx), pa.array(shared, pa.int64()),
                     pa.array(union, pa.int64())], ["a", "b", "shared", "together"])

    return stage(map_batches(grouped, run, "a long, b long, shared long, together long").distinct(), "compared")


def dealt_lists(lists: DataFrame, known: DataFrame, maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, askers) of the lists of more than one component. ``lists``: (tok, n, pos, nid,
    comp); ``known``: (nid, pivot, dist); ``maps``: (nid, parity). A list's members are dealt
    over chunks of about ``LIST_CHUNK`` rows; its nodes outside its largest component ask, so of
    any two nodes of different components at least one asks, and an asker is sent to all
    chunks of its lists. Both are read from one staged table."""
    sizes = lists.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("c"))
    sizes = (sizes.groupBy("tok").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("rows"))
             .where("m.c < rows").select("tok", F.col("m.comp").alias("main"), F.ceil(F.col("rows") / LIST_CHUNK).cast("int").alias("chunks")))
    mixed = stage(lists.join(sizes, "tok").join(known, "nid", "left").join(maps, "nid").select(
        "tok", "n", "pos", "nid", "comp", F.coalesce("pivot", "nid").alias("pivot"), F.coalesce("dist", F.lit(0.0)).alias("dist"),
        "parity", "main", "chunks"), "mixed-lists")
    columns = ["tok", "n", "pos", "nid", "comp", "pivot", "dist", "parity"]
    members = mixed.select(*columns, F.pmod(F.xxhash64("nid"), F.col("chunks")).cast("int").alias("chunk"))
    askers = mixed.where("comp <> main").select(*columns, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    return members, askers


def renamed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """List rows with the components of now."""
    return (rows.drop("comp").join(roots.withColumnRenamed("node", "nid"), "nid", "left")
            .withColumn("comp", F.coalesce("root", "nid")).drop("root"))


def ask(members: DataFrame, askers: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(a, b): for every asker the ``k`` nodes, by parity maps the nearest, that share a list with
    it, are in another component, may be linked with it and were not asked before
    (``asked``: (a, b) so far)."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = asked.groupBy("a").agg(F.collect_list("b").alias("asked")).withColumnRenamed("a", "nid")  # an asker's own: a few times k
    both = members.withColumn("role", F.lit(0)).withColumn("asked", F.lit(None).cast("array<long>")).unionByName(
        askers.withColumn("role", F.lit(1)).join(before, "nid", "left"))
    names = ["tok", "chunk", "role", "n", "pos", "nid", "comp", "pivot", "dist"]
    ordered = both.select(*names, "parity", "asked").repartition(n, "tok", "chunk").sortWithinPartitions("tok", "chunk", "role")

    def may_link(x, i, j):
        """Of the index pairs (i, j): those that may be linked, and how far apart they look."""
        ok = x["comp"][i] != x["comp"][j]
        i, j = i[ok], j[ok]
        ni, nj = x["n"][i], x["n"][j]
        least = need(ni, nj)
        ok = NUM * np.maximum(ni, nj) <= DEN * np.minimum(ni, nj)
        ok &= np.minimum(ni - x["pos"][i], nj - x["pos"][j]) >= least
        ok &= (x["pivot"][i] != x["nid"][j]) & (x["pivot"][j] != x["nid"][i])  # compared before
        ok &= ~((x["pivot"][i] == x["pivot"][j]) & (np.abs(x["dist"][i] - x["dist"][j]) > 1 - NUM / DEN + 1e-9))
        i, j, room = i[ok], j[ok], (ni + nj - 2 * least)[ok]
        apart = np.bitwise_count(x["parity"][i] ^ x["parity"][j]).sum(axis=1)
        ok = apart <= room
        return i[ok], j[ok], apart[ok]

    def nearest(x, done):
        """Pairs of one batch of whole chunks (members first, then askers)."""
        new = np.append(True, (x["tok"][1:] != x["tok"][:-1]) | (x["chunk"][1:] != x["chunk"][:-1]))
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        members_of = np.bincount(group, x["role"] == 0, len(begin)).astype(np.int64)
        asking = np.flatnonzero(x["role"] == 1)
        many = members_of[group[asking]]
        upto = np.cumsum(many)
        at = 0
        while at < len(asking):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIR_STEP, "right")))
            some, times = asking[at:to], many[at:to]
            i = np.repeat(some, times)
            j = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + begin[group[i]]
            i, j, apart = may_link(x, i, j)
            if done and len(i):
                ok = np.array([p not in done for p in zip(x["nid"][i].tolist(), x["nid"][j].tolist(), strict=True)], bool)
                i, j, apart = i[ok], j[ok], apart[ok]
            order = np.lexsort((x["nid"][j], apart, i))
            i, j, apart = i[order], j[order], apart[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield pa.RecordBatch.from_arrays([pa.array(x["nid"][i[first]], pa.int64()), pa.array(x["nid"][j[first]], pa.int64()),
                                              pa.array(apart[first].astype(np.int64), pa.int64())], ["a", "b", "apart"])
            at = to

    def run(batches):
        held = None  # the members of a chunk that may go on
        for b in batches:
            x = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
            x["parity"] = np.frombuffer(b"".join(b.column("parity").to_pylist()), np.uint64).reshape(b.num_rows, -1)
            lists_of = b.column("asked")
            done = {(a, o) for a, some in zip(x["nid"].tolist(), lists_of.to_pylist(), strict=True) if some for o in some} \
                if lists_of.null_count < len(lists_of) else set()
            if held is not None:
                x = {c: np.concatenate([held[c], v]) for c, v in x.items()}
            if not len(x["tok"]):
                continue
            yield from nearest(x, done)
            last = (x["tok"] == x["tok"][-1]) & (x["chunk"] == x["chunk"][-1]) & (x["role"] == 0)
            held = {c: v[last] for c, v in x.items()}

    found = map_batches(ordered, run, "a long, b long, apart long")
    found = found.groupBy("a", "b").agg(F.min("apart").alias("apart"))
    place = F.row_number().over(W.partitionBy("a").orderBy("apart", "b"))
    return stage(found.withColumn("place", place).where(F.col("place") <= k).select("a", "b"), "asked")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, row, h, n, comp, component_id) for every row of ``docs`` that has a doc_id: h
    is a hash of the text, comp a number of the component (null for an empty set)."""
    rows = with_rows(docs)
    sets = stage(fingerprints(rows.withColumn("h", F.xxhash64("text"))), "set-prints")
    nodes = stage(sets.where("n > 0").groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "row")).alias("first"))
                  .select("f1", "f2", "n", "first.*", F.monotonically_increasing_id().alias("nid")), "set-nodes")
    texts = rows.join(small_side(nodes.select("doc_id", "row", "nid")), ["doc_id", "row"]).select("nid", "text")
    counts = shingle_counts(rows)
    index = prefixes(texts, counts)
    live = stage(index.groupBy("tok").agg(F.min("nid").alias("lo"), F.max("nid").alias("hi")).where("lo <> hi").select("tok"),
                 "shared-shingles")
    lists = stage(index.join(live, "tok").distinct(), "index-lists")

    # one pivot for every node: the smallest set of a list and size class, met most often
    heads = lists.groupBy("tok", "cls").agg(F.min(F.struct("n", "nid")).alias("head"))
    heads = heads.unionByName(heads.select("tok", (F.col("cls") + 1).alias("cls"), "head"))
    meets = (lists.join(heads, ["tok", "cls"]).where("head.nid <> nid")
             .where((NUM * F.greatest("n", "head.n") <= DEN * F.least("n", "head.n")))
             .groupBy(F.col("nid").alias("a"), F.col("head.nid").alias("b")).agg(F.count(F.lit(1)).alias("c")))
    best = meets.groupBy("a").agg(F.max(F.struct("c", (-F.col("b")).alias("b"))).alias("m"))
    known = compare(best.select("a", (-F.col("m.b")).alias("b")), texts)
    linked = F.col("shared") * DEN >= F.col("together") * NUM
    links = known.where(linked).select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(links)

    # what is left: nodes of different components that share a list
    dist = known.select(F.col("a").alias("nid"), F.col("b").alias("pivot"), (1 - F.col("shared") / F.col("together")).alias("dist"))
    maps = nodes.select("nid", "doc_id", "row").join(sets.select("doc_id", "row", "parity").dropDuplicates(["doc_id", "row"]),
                                                     ["doc_id", "row"]).select("nid", "parity")
    members, askers = dealt_lists(renamed(lists.withColumn("comp", F.col("nid")), roots), dist, maps)
    asked = links.select(F.col("u").alias("a"), F.col("v").alias("b")).limit(0)
    k = FIRST
    while True:
        now = ask(members, askers, asked, k)
        if now.isEmpty():
            break
        links = stage(links.unionByName(compare(now, texts).where(linked).select(F.col("a").alias("u"), F.col("b").alias("v"))), "all-links")
        roots = components(links)
        # who got fewer than k names has none left: components only grow
        active = stage(now.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= k).select("a"), "still-asking")
        askers = stage(renamed(askers.join(small_side(active.withColumnRenamed("a", "nid")), "nid", "left_semi"), roots), "list-askers")
        chunks = stage(askers.select("tok", "chunk").distinct(), "open-chunks")
        members = stage(renamed(members.join(small_side(chunks), ["tok", "chunk"], "left_semi"), roots), "list-members")
        asked = stage(asked.unionByName(now).join(active, "a", "left_semi"), "asked-so-far")
        k *= MORE

    joined = (sets.join(nodes.select("f1", "f2", "n", "nid"), ["f1", "f2", "n"], "left")
              .join(roots.withColumnRenamed("node", "nid"), "nid", "left")
              .withColumn("comp", F.coalesce("root", "nid")))
    joined = stage(joined.select("doc_id", "row", "h", "n", "comp"), "members")
    least = joined.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return (joined.join(least, "comp", "left")
            .select("doc_id", "row", "h", "n", "comp", F.coalesce("component_id", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The input without the documents that are linked to one with a smaller doc_id: of
    every component the first document stays. Empty sets stay, as do rows without doc_id;
    equal rows (same doc_id and text) are one document and stay or go together."""
    found = jaccard_components(docs.select("doc_id", "text"))
    first = found.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    gone = stage(found.join(first, "comp").where(F.struct("doc_id", "row") > F.col("first"))
                 .select(F.col("doc_id").alias("__gone_id"), F.col("h").alias("__gone_text")).distinct(), "linked")
    same = (docs["doc_id"] == F.col("__gone_id")) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__gone_text"))
    return docs.join(small_side(gone), same, "left_anti")


def jaccard_report(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    out = jaccard_components(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    loose = fingerprints(docs.where(F.col("doc_id").isNull()).select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")))
    return out.unionByName(loose.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
