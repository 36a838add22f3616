"""O22 NoisyKNN over vectors: the k nearest base vectors of each query vector
under cosine distance with Laplace noise.

``noise_on='distance'`` adds Lap(scale) to every (query, base) distance;
``'vector'`` perturbs each query coordinate with Lap(scale) first (in the spirit
of Feyisetan et al. 2020) and ranks exactly. Ties by base id.

Plan: every base row is scored against every query by definition, so the work is queries
times base rows. Neither side is collected or broadcast by us: base rows are hashed over
shards, queries are repeated per shard, and the two meet in an equi-join on the shard. The
per-query top-k is a ``row_number() <= k`` filter, which Catalyst turns into a partial
WindowGroupLimit before the shuffle: each task forwards at most k rows per query, so a
query's group never holds the base table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.noise import laplace
from ..functions.secret_noise import SecretNoise


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def as_double_array(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.transform(col, lambda x: x.cast("double"))


def centroids(emb: DataFrame, key: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per key: (key, centroid array<double>). Coordinates are
    averaged with a distributed aggregate (partial sums per task)."""
    coords = emb.select(key, F.posexplode(vec).alias("dim", "x"))
    means = coords.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"])
        .alias("centroid"))


def noisy_knn(queries: DataFrame, base: DataFrame, k: int, scale: float, seed: int,
              noise_on: str = "distance", qid: str = "qid", qvec: str = "qvec",
              bid: str = "vec_id", bvec: str = "embedding", noise: SecretNoise | None = None) -> DataFrame:
    """(qid, rank, vec_id, distance) for the k nearest base rows per query. With ``noise`` (its
    scales name ``scale``) the noise on distances is drawn under its secret salt and
    ``distance`` is an integer on its grid."""
    qs = queries.select(F.col(qid).alias("qid"), as_double_array(qvec).alias("q"))
    if noise_on == "vector":
        qs = qs.withColumn("q", F.transform("q", lambda x, i: x + laplace(
            scale, seed, F.lit("vec"), F.col("qid"), i)))
    elif noise_on != "distance":
        raise ValueError("noise_on must be 'distance' or 'vector'")
    shards = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    qs = qs.withColumn("qn", F.sqrt(dot(F.col("q"), F.col("q")))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    b = base.select(F.col(bid).alias("vec_id"), as_double_array(bvec).alias("v"))
    b = b.withColumn("vn", F.sqrt(dot(F.col("v"), F.col("v")))).withColumn(
        "shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    scored = b.join(qs, "shard")
    dist = F.lit(1.0) - dot(F.col("q"), F.col("v")) / (F.col("qn") * F.col("vn"))
    if noise is not None:
        if noise_on != "distance":
            raise ValueError("secret noise goes on distances")
        d = noise.draws(scored.select("qid", "vec_id", noise.value(dist).alias("d"), F.lit(float(scale)).alias("scale")),
                        "scale", "draw", "knn", "qid", "vec_id")
        d = d.select("qid", "vec_id", (F.col("d") + F.col("draw")).alias("distance"))
        return nearest(d, k)
    if noise_on == "distance":
        dist = dist + laplace(scale, seed, F.lit("knn"), F.col("qid"), F.col("vec_id"))
    return nearest(scored.select("qid", "vec_id", dist.alias("distance")), k)


def nearest(d: DataFrame, k: int) -> DataFrame:
    """The k smallest distances of each query, ties by base id, ranked from 1."""
    w = Window.partitionBy("qid").orderBy("distance", "vec_id")
    return (d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
