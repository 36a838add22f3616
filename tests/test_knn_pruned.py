"""Pruned neighbours: the rows of the full search, fewer pairs on clustered data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from minimus.operators.knn import as_double_array, dot, noisy_knn
from minimus.operators.knn_pruned import Blocks, pruned_knn, pruned_pairs
from minimus.sources.tables import read_table


def table(spark, x, name="embedding", first=0):
    return spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(x)], f"vec_id long, {name} array<double>")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    base = np.repeat(centres, 60, axis=0) + 0.1 * rng.normal(size=(1200, 16))
    base[100:500] = base[100]  # copies: a third of all rows
    return base, centres + 0.05 * rng.normal(size=centres.shape)


def rows(df):
    return sorted((r.qid, r.rank, r.vec_id, round(r.distance, 9)) for r in df.collect())


@pytest.mark.parametrize("noise_on,scale", [("vector", 0.01), ("distance", 0.002), ("distance", 0.3)])
def test_rows_of_the_full_search(spark, clustered, noise_on, scale):
    base, asked = (table(spark, x) for x in clustered)
    asked = asked.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    want = rows(noisy_knn(asked, base, 7, scale, 5, noise_on=noise_on))
    assert rows(pruned_knn(asked, base, 7, scale, 5, noise_on=noise_on)) == want
    few = Blocks(base, pivots=3, block_rows=16)  # salted parts
    assert rows(pruned_knn(asked, base, 7, scale, 5, noise_on=noise_on, blocks=few)) == want


def test_fewer_pairs_on_clustered_data(spark, clustered):
    base, asked = (table(spark, x) for x in clustered)
    blocks = Blocks(base)
    qs = asked.select(F.col("vec_id").alias("qid"), as_double_array("embedding").alias("q")).withColumn(
        "qn", F.sqrt(dot(F.col("q"), F.col("q"))))
    near = qs.withColumn("kth", F.lit(0.05))
    scored = (pruned_pairs(blocks.wanted(qs, 7, None), blocks).count()
              + pruned_pairs(blocks.wanted(near, 7, 0.0), blocks).count())
    assert scored < 0.25 * 20 * 1200


def test_embeddings(spark, sf):
    base = read_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    asked = base.where("vec_id < 40").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    want = rows(noisy_knn(asked, base, 5, 0.01, 9))
    assert rows(pruned_knn(asked, base, 5, 0.01, 9)) == want


def test_odd_tables(spark):
    base = table(spark, np.array([[1.0, 0], [0, 1], [0, 0], [1, 0]]))
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 0.0])], "qid long, qvec array<double>")
    got = rows(pruned_knn(asked, base, 5, 0.01, 9, noise_on="distance"))
    assert sorted(r[2] for r in got if r[0] == 1) == [0, 1, 3] and {r[0] for r in got} == {1}
    assert pruned_knn(asked, base.limit(0), 5, 0.01, 9).collect() == []
    assert pruned_knn(asked.limit(0), base, 5, 0.01, 9).collect() == []
