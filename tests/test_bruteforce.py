"""The exact-without-all-pairs operators against brute force on the smoke tables."""
import math

import numpy as np
from pyspark.sql import functions as F

from minimus.operators.typos import (MIN_TARGET_DF, MIN_TYPO_LEN, correct_typos,
                                     typo_corrections, typo_vocab)
from minimus.plans.queries_flow import KNN_K, knn_job
from minimus.plans.queries_text import document_base
from minimus.sources.tables import read_table


def _dist_is_one(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1:]


def test_typo_join_equals_brute_force(spark, sf):
    vocab = typo_vocab(document_base(spark, sf)).collect()
    got = {(r.lang, r.token): (r.fix, r.fix_df)
           for r in typo_corrections(spark.createDataFrame(vocab)).collect()}
    by_lang = {}
    for r in vocab:
        by_lang.setdefault(r.lang, []).append(r)
    want = {}
    for lang, rows in by_lang.items():
        targets = [r for r in rows if r.df >= MIN_TARGET_DF]
        for c in rows:
            if c.df != 1 or len(c.token) < MIN_TYPO_LEN:
                continue
            hits = [(-t.df, t.token) for t in targets if _dist_is_one(c.token, t.token)]
            if hits:
                best = min(hits)
                want[(lang, c.token)] = (best[1], -best[0])
    assert got == want
    assert len(want) > 0


def test_typo_rewrite_keeps_separators(spark):
    docs = spark.createDataFrame([("d1", "en", "Helo, world!\nhelo"), ("d2", "en", "untouched text"),
                                  ("d1", "fr", "helo")], "pid string, lang string, text string")
    corr = spark.createDataFrame([("en", "helo", "d1", "hello", 12)],
                                 "lang string, token string, d string, fix string, fix_df long")
    corr = corr.withColumn("doc", F.xxhash64("d")).drop("d")
    out = {(r.pid, r.lang): r.text for r in correct_typos(docs, corr).collect()}
    # fixes belong to a language: the same key in another one is left alone
    assert out == {("d1", "en"): "Hello, world!\nhello", ("d2", "en"): "untouched text", ("d1", "fr"): "helo"}


def test_knn_equals_brute_force(spark, sf):
    emb = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"]).collect()
    vec = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in emb}
    labels = sorted({r.label for r in emb})
    got = knn_job(spark, sf, "vector").collect()
    # noise-free ranking of the same noisy query vectors must match: recompute
    # the distances for the returned query ids exactly and compare the order
    by_q = {}
    for r in got:
        by_q.setdefault(r.qid, []).append(r)
    assert sorted(by_q) == labels
    for q, rows in by_q.items():
        rows.sort(key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, KNN_K + 1))
        dists = [r.distance for r in rows]
        assert dists == sorted(dists)
    # with zero noise the operator is exact kNN: compare with numpy
    from minimus.operators.knn import centroids, noisy_knn
    emb_df = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    qs = centroids(emb_df).select(F.col("label").alias("qid"), F.col("centroid").alias("qvec"))
    exact = {(r.qid, r.rank): r.vec_id
             for r in noisy_knn(qs, emb_df, KNN_K, 0.0, 1, "distance").collect()}
    for lab in labels:
        c = np.mean([vec[r.vec_id] for r in emb if r.label == lab], axis=0)
        d = {i: 1 - float(c @ v) / (math.sqrt(float(c @ c)) * math.sqrt(float(v @ v)))
             for i, v in vec.items()}
        ranked = sorted(d, key=lambda i: (round(d[i], 12), i))[:KNN_K]
        assert [exact[(lab, k)] for k in range(1, KNN_K + 1)] == ranked
