"""O22 over vectors without scoring every pair: exact neighbours by pivots and blocks.

Base rows are grouped around pivots (a bounded sample of them): each row belongs to its nearest
pivot and to a ring of angles around it. A ring of a pivot is a block; its smallest and largest
angle are all that a search needs to know of it. On the unit sphere angles obey the triangle
inequality, so no row of a block is nearer to a query than

    max(0, angle(query, pivot) - largest, smallest - angle(query, pivot)).

Each query first scores the blocks with the smallest bounds until they hold k rows, which gives
it k distances and so a kth one; then only the blocks whose bound does not exceed that. With
noise on the distances the bound is lowered by the largest draw, which is finite (draws have
32 bits, or a fixed number of digits), so no neighbour is lost either way; where the noise is
wide, little is skipped.

A query row is sent to the blocks that it needs and nowhere else; a block of more than
``BLOCK_ROWS`` rows (a hot ring, copies of one vector) is dealt over salted parts. The pivots
and the block table are bounded by ``PIVOTS`` and the number of rings, so both are broadcast.

Defined results: the rows are those of ``knn.noisy_knn``; a null vector or one without
length (all zeros) has no direction and takes no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise import laplace
from ..session import cut_lineage, ship_package
from .knn import as_double_array, dot, nearest

PIVOTS = 64
#: Width of a ring in radians; PIVOTS * pi / RING bounds the blocks.
RING = 0.05
BLOCK_ROWS = 4096
#: Room for rounding in bounds, in radians.
SLACK = 1e-6


def largest_draw(scale: float) -> float:
    """The largest magnitude of ``noise.laplace``: 1 - 2|u| is 2^-32 at least."""
    return scale * 32 * math.log(2)


def _vectors(col: pa.Array) -> np.ndarray:
    flat = col.values.to_numpy(zero_copy_only=False)[col.offsets[0].as_py():col.offsets[-1].as_py()]
    x = flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _pivots(base: DataFrame, n: int) -> np.ndarray:
    """Unit vectors of the ``n`` rows whose hashed ids are smallest (all, if fewer)."""
    rows = base.select(F.xxhash64("vec_id").alias("h"), "v").orderBy("h", "v").limit(n).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r.v for r in rows], float)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Blocks:
    """Base rows dealt to blocks: ``rows`` (pivot, ring, part, vec_id, v, vn)."""

    def __init__(self, base: DataFrame, bid: str = "vec_id", bvec: str = "embedding", pivots: int = PIVOTS,
                 block_rows: int = BLOCK_ROWS):
        spark = base.sparkSession
        ship_package(spark)
        b = base.select(F.col(bid).alias("vec_id"), as_double_array(bvec).alias("v"))
        b = b.withColumn("vn", F.sqrt(dot(F.col("v"), F.col("v")))).where("vn > 0")
        self.pivots = _pivots(b, pivots)
        if not len(self.pivots):
            self.rows, self.table = b.withColumn("pivot", F.lit(0)).limit(0), np.zeros((0, 6))
            return
        shared = spark.sparkContext.broadcast(self.pivots)

        def place(batches):
            for batch in batches:
                angle = _angles(_vectors(batch.column("v")), shared.value)
                pivot = angle.argmin(axis=1)
                near = angle[np.arange(len(pivot)), pivot]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(pivot, pa.int32()), pa.array((near / RING).astype(np.int32)), pa.array(near)],
                    [*batch.schema.names, "pivot", "ring", "angle"])

        id_type = b.schema["vec_id"].dataType.simpleString()
        placed = b.mapInArrow(place, f"vec_id {id_type}, v array<double>, vn double, pivot int, ring int, angle double")
        placed = cut_lineage(placed)
        table = placed.groupBy("pivot", "ring").agg(
            F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        table = table.withColumn("parts", F.ceil(F.col("n") / block_rows).cast("int"))
        self.rows = (placed.join(F.broadcast(table.select("pivot", "ring", "parts")), ["pivot", "ring"])
                     .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts", "angle"))
        self.table = np.array([tuple(r) for r in table.select("pivot", "ring", "n", "low", "high", "parts").collect()],
                              float).reshape(-1, 6)  # at most pivots * rings

    def wanted(self, queries: DataFrame, k: int, reach: float | None) -> DataFrame:
        """(query columns, pivot, ring, part) of the blocks each query of (qid, q, qn) must score: the
        nearest ones that hold ``k`` rows if ``reach`` is None; else those within its ``kth``
        distance and ``reach`` (what noise may take off), without the first ones."""
        shared = queries.sparkSession.sparkContext.broadcast((self.pivots, self.table))
        second = reach is not None

        def route(batches):
            pivots, table = shared.value
            which = table[:, 0].astype(np.int64)
            for batch in batches:
                angle = _angles(_vectors(batch.column("q")), pivots)[:, which]
                low = np.maximum(np.maximum(angle - table[:, 4], table[:, 3] - angle) - SLACK, 0)
                order = np.argsort(low, axis=1, kind="stable")
                before = np.cumsum(table[order, 2], axis=1) - table[order, 2]
                first = np.zeros(low.shape, bool)
                np.put_along_axis(first, order, before < k, axis=1)
                take = first
                if second:
                    kth = batch.column("kth").to_numpy(zero_copy_only=False)
                    kth = np.where(np.isnan(kth.astype(float)), np.inf, kth.astype(float))  # fewer than k rows so far
                    take = ~first & (1 - np.cos(low) - reach <= kth[:, None])
                at, block = np.nonzero(take)
                chosen = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*chosen.columns, *(pa.array(table[block, c].astype(np.int32)) for c in (0, 1, 5))],
                    [*batch.schema.names, "pivot", "ring", "parts"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
        routed = queries.mapInArrow(route, f"{kinds}, pivot int, ring int, parts int")
        return routed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def pruned_pairs(wanted: DataFrame, blocks: Blocks) -> DataFrame:
    """(qid, vec_id, q, v, qn, vn): the pairs that are scored."""
    return wanted.join(blocks.rows, ["pivot", "ring", "part"])


def pruned_knn(queries: DataFrame, base: DataFrame, k: int, scale: float, seed: int, noise_on: str = "distance",
               qid: str = "qid", qvec: str = "qvec", bid: str = "vec_id", bvec: str = "embedding",
               blocks: Blocks | None = None) -> DataFrame:
    """(qid, rank, vec_id, distance): the rows of ``knn.noisy_knn``. ``blocks`` of the same base
    may be kept and passed again."""
    ship_package(queries.sparkSession)
    blocks = blocks or Blocks(base, bid, bvec)
    qs = queries.select(F.col(qid).alias("qid"), as_double_array(qvec).alias("q"))
    if noise_on == "vector":
        qs = qs.withColumn("q", F.transform("q", lambda x, i: x + laplace(scale, seed, F.lit("vec"), F.col("qid"), i)))
    elif noise_on != "distance":
        raise ValueError("noise_on must be 'distance' or 'vector'")
    qs = cut_lineage(qs.withColumn("qn", F.sqrt(dot(F.col("q"), F.col("q")))).where("qn > 0"))
    if not len(blocks.pivots):
        return nearest(qs.select("qid", F.lit(None).cast("long").alias("vec_id"), F.lit(0.0).alias("distance")).limit(0), k)

    def distance() -> Column:
        d = F.lit(1.0) - dot(F.col("q"), F.col("v")) / (F.col("qn") * F.col("vn"))
        return d + laplace(scale, seed, F.lit("knn"), F.col("qid"), F.col("vec_id")) if noise_on == "distance" else d

    def best(wanted: DataFrame) -> DataFrame:
        return nearest(pruned_pairs(wanted, blocks).select("qid", "vec_id", distance().alias("distance")), k)

    first = cut_lineage(best(blocks.wanted(qs, k, None)).drop("rank"))
    kth = first.groupBy("qid").agg(F.max("distance").alias("kth"), F.count(F.lit(1)).alias("n"))
    asked = qs.join(kth, "qid", "left").withColumn("kth", F.when(F.col("n") >= k, F.col("kth"))).drop("n")
    reach = largest_draw(scale) if noise_on == "distance" else 0.0
    rest = best(blocks.wanted(asked, k, reach)).drop("rank")
    return nearest(first.unionByName(rest), k)
