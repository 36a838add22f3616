"""Exact top-k search by integer inner product, a block at a time.

Vectors become integers floor(scale * x). Candidates are sorted by id and cut into shards
of consecutive ids; a shard holds the forward index (the vectors) of its blocks, and the
largest and smallest value of every component (term) in each block. The sum over terms
of the larger of query * maximum and query * minimum bounds every score in a block. The blocks
of a shard are visited in falling order of that bound, a few at a time; a query takes part while
one of them has a bound that reaches its kth score so far. A task keeps each query's k best over
all of its shards; the k best of every task meet in one more ranking.

The smaller side is copied to lanes, the other is dealt over them; every (query block, shard)
pair of a lane is one self-contained row of bounded size, so neither side is ever gathered or
broadcast. Vectors travel in the narrowest type that holds them.

Defined results: a vector that is null or has a null or non-finite component takes no
part, nor does a row without id or a vector without components; vectors are compared with those of the same length
only; rows that repeat an id are candidates each, and one query (the one with the
smallest vector); a query skips all rows with its own id; equal scores rank by id; fewer
candidates than k give fewer rows. Scores that leave the 64-bit range are clipped to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import map_batches, stage, written_bytes

BLOCK_ROWS = 128
#: Blocks that one matrix product scores, and queries.
VISIT_BLOCKS = 8
VISIT_QUERIES = 512
SHARD_BYTES = 1 << 20
QUERY_ROWS = 2048
#: Bytes (as written) of the dealt side that a lane stands for.
LANE_BYTES = 1 << 20
#: Lanes for each core at least, as far as there are shuffle partitions: some fall together.
LANES_A_CORE = 4
#: Queries whose best a task holds before it hands them on.
HELD_QUERIES = 1 << 18
#: Inner products up to these are exact in float32 and float64.
EXACT = ((1 << 24, np.float32), (1 << 53, np.float64))
#: Below every score, and the mark of a query's own rows, below that.
NONE, OWN = np.float32(-3e38), np.float32(-np.inf)


def integer_vectors(rows: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every valid vector, as doubles."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return (rows.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine)
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")))


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers as 16-bit integers if they fit."""
    return x.astype("<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<f8")


def _pack(kind: str, rows_of):
    """Turn a partition into rows (kind-specific number, dim, n, ids, vectors), at most
    ``rows_of(dim)`` vectors each."""
    def pack(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}

        def row(dim):
            nonlocal number
            ids, vecs = held.pop(dim)
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number], pa.int64()), pa.array([dim], pa.int32()),
                 pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                 pa.array([_narrow(np.concatenate(vecs)).tobytes()], pa.binary())],
                [kind, "dim", f"{kind}_ids", f"{kind}_vectors"])

        for b in batches:
            lists = b.column("v").cast(pa.large_list(pa.float64()))
            flat, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, vec_id in enumerate(b.column("vec_id").to_pylist()):
                x = flat[off[i]:off[i + 1]]
                ids, vecs = held.setdefault(len(x), ([], []))
                ids.append(vec_id)
                vecs.append(x)
                if len(ids) >= rows_of(len(x)):
                    yield row(len(x))
        for dim in list(held):
            yield row(dim)
    return pack


class Best:
    """The k best (score, id) of each of some queries so far, in falling order; ids of places
    that are not filled mean nothing."""

    def __init__(self, q_ids: np.ndarray, k: int):
        self.q_ids, self.k = q_ids, k
        self.score = np.full((len(q_ids), k), NONE, np.float64)
        self.id = np.zeros((len(q_ids), k), np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Hits of queries ``row``, sorted by it. Equal scores rank by id."""
        some = np.unique(row)
        row = np.concatenate([np.repeat(some, self.k), row])
        score = np.concatenate([self.score[some].ravel(), score])
        ids = np.concatenate([self.id[some].ravel(), ids])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        take = (first[:, None] + np.arange(self.k)).ravel()  # every query has k places at least
        self.score[some], self.id[some] = score[take].reshape(-1, self.k), ids[take].reshape(-1, self.k)

    def found(self):
        """(query id, id, score) of the places that are filled."""
        row, place = np.nonzero(self.score > NONE)
        return self.q_ids[row], self.id[row, place], self.score[row, place].astype(np.int64)


def search_shard(best: Best, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray) -> bool:
    """Bring ``best`` of the queries' vectors up to date with the candidates, whose rows are sorted
    by id. Block at a time, with pruning. False: not done, as the numbers are too large for it."""
    n, dim = c.shape
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dim
    kind = next((kind for limit, kind in EXACT if largest < limit), None)
    if kind is None:
        return False
    q, c = q.astype(kind), c.astype(kind)
    starts = np.arange(0, n, BLOCK_ROWS)
    top, low = np.maximum.reduceat(c, starts, axis=0), np.minimum.reduceat(c, starts, axis=0)
    first, last = np.searchsorted(c_ids, best.q_ids, "left"), np.searchsorted(c_ids, best.q_ids, "right")
    for i in range(0, len(q), VISIT_QUERIES):
        part = slice(i, i + VISIT_QUERIES)
        bound = np.maximum(q[part], 0) @ top.T + np.minimum(q[part], 0) @ low.T
        order = np.argsort(-bound.max(axis=0), kind="stable")
        for j in range(0, len(order), VISIT_BLOCKS):
            blocks = order[j:j + VISIT_BLOCKS]
            reach = bound[:, blocks] >= best.score[part, -1][:, None]
            rows, blocks = i + np.flatnonzero(reach.any(axis=1)), np.sort(blocks[reach.any(axis=0)])
            if len(rows):
                at = (starts[blocks][:, None] + np.arange(BLOCK_ROWS)).ravel()
                _visit(best, rows, q[rows], at[at < n], c_ids, c, first, last)
    return True


def _visit(best: Best, rows, q, at, c_ids, c, first, last) -> None:
    """Score the candidates at the places ``at`` (rising) for some of the queries."""
    score = q @ c[at].T
    for r in np.flatnonzero(last[rows] > first[rows]):
        own = slice(*np.searchsorted(at, (first[rows[r]], last[rows[r]])))
        score[r, own] = OWN
    floor = best.score[rows, -1]
    if (floor == NONE).any() and len(at) > best.k:  # the kth of these alone is a bound, too
        kth = np.partition(score, len(at) - best.k, axis=1)[:, len(at) - best.k]
        floor = np.maximum(floor, np.maximum(kth, NONE))
    r, a = np.divmod(np.flatnonzero(score >= floor.astype(score.dtype)[:, None]), len(at))
    hit, ids = score[r, a].astype(np.float64), c_ids[at[a]]
    new = (hit > best.score[rows[r], -1]) | (ids < best.id[rows[r], -1])
    if new.any():
        best.add(rows[r[new]], hit[new], ids[new])


def best_by_whole_numbers(q_ids, q, c_ids, c, k: int):
    """Per query the k best (position of the query, id, score), all blocks in exact integers."""
    whole = np.vectorize(int, otypes=[object])
    big_q, big_c = whole(q), whole(c)
    for i in range(len(q)):
        scores = big_c @ big_q[i]
        rows = sorted((j for j in range(len(c)) if c_ids[j] != q_ids[i]), key=lambda j: (-scores[j], j))[:k]
        for j in rows:
            yield i, c_ids[j], max(-(1 << 63), min((1 << 63) - 1, int(scores[j])))


def _pairs(asked: DataFrame, shards: DataFrame, n: int) -> DataFrame:
    """Every block of queries with every shard of its length. The side of fewer bytes is copied to
    the lanes, so that what is copied and the best that the lanes hand on follow the other side's bytes."""
    spark = shards.sparkSession
    size = {"ask": written_bytes(asked), "shard": written_bytes(shards)}
    copied, dealt = ("ask", "shard") if size["ask"] <= size["shard"] else ("shard", "ask")
    lanes = min(n, max(LANES_A_CORE * spark.sparkContext.defaultParallelism, -(-size[dealt] // LANE_BYTES)))
    number = F.col(dealt)
    lane = {copied: F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))),
            dealt: F.pmod(F.shiftright(number, 32) + number.bitwiseAND((1 << 32) - 1), F.lit(lanes)).cast("int")}
    # dealt by number: small partitions are not put together, a lane is much work whatever its bytes
    ask, shard = (side.withColumn("lane", lane[name]).repartition(lanes, "dim", "lane")
                  for name, side in (("ask", asked), ("shard", shards)))
    return ask.hint("merge").join(shard, ["dim", "lane"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id",
          vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates."""
    spark = candidates.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = "{0} long, dim int, {0}_ids binary, {0}_vectors binary"
    cand = integer_vectors(candidates, id_col, vector, scale)
    shards = stage(map_batches(
        cand.repartitionByRange(n, "vec_id").sortWithinPartitions("vec_id"),
        _pack("shard", lambda dim: max(BLOCK_ROWS, SHARD_BYTES // (8 * max(dim, 1)))),
        packed.format("shard")), "topk-shards")
    asked = (integer_vectors(queries, id_col, vector, scale).groupBy("vec_id").agg(F.min("v").alias("v")))
    asked = stage(map_batches(asked, _pack("ask", lambda dim: min(QUERY_ROWS, max(BLOCK_ROWS, SHARD_BYTES // (8 * max(dim, 1))))), packed.format("ask")), "topk-queries")
    pairs = _pairs(asked, shards, n)

    def vectors(b, side, r):
        ids = np.frombuffer(b.column(f"{side}_ids")[r].as_buffer(), "<i8")
        data, dim = b.column(f"{side}_vectors")[r].as_buffer(), b.column("dim")[r].as_py()
        return ids, np.frombuffer(data, "<i2" if data.size == 2 * len(ids) * dim else "<f8").reshape(len(ids), dim)

    def batch(query_ids, ids, scores):
        return pa.RecordBatch.from_arrays([pa.array(query_ids, pa.int64()), pa.array(ids, pa.int64()),
                                           pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

    def search(batches):
        held: dict[int, Best] = {}
        for b in batches:
            for r in range(b.num_rows):
                ask = b.column("ask")[r].as_py()
                q_ids, q = vectors(b, "ask", r)
                c_ids, c = vectors(b, "shard", r)
                if ask not in held and held and sum(len(x.q_ids) for x in held.values()) + len(q_ids) > HELD_QUERIES:
                    for x in held.values():
                        yield batch(*x.found())
                    held = {}
                if ask not in held:
                    held[ask] = Best(q_ids.copy(), k)
                best = held[ask]
                if not search_shard(best, q, c_ids, c):
                    got = list(best_by_whole_numbers(q_ids, q.astype(np.float64), c_ids, c.astype(np.float64), k))
                    yield batch(q_ids[[g[0] for g in got]] if got else [], [g[1] for g in got], [g[2] for g in got])
        for x in held.values():
            yield batch(*x.found())

    found = map_batches(pairs, search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH valid AS (
  SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (
  SELECT vec_id, unnest(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS x,
    unnest(range(len(embedding))) AS d FROM valid),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
