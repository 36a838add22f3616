"""Quality classifier by positive-unlabelled learning.

A linear score over text features is fitted by minimising the non-negative unbiased risk
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)): trusted positives (rows labelled 1), unlabelled
web text (rows without a label), and the class prior pi, estimated as the share of 1
among the labels that may be learnt from. Negative labels enter through pi only.

Features are computed for every whole text in tasks; the fit runs on a bounded sample
(``SAMPLE`` positives and as many unlabelled rows, those with the smallest hashed
doc_id), so that the driver sees a few numbers for each sampled row. Language, source,
doc_id and labels are no inputs of a score.

Defined results: a null or empty text has all-zero features and gets a score like any
other; rows with a null doc_id are never labelled; rows that repeat a doc_id are scored
each; without positives or unlabelled rows the prior (or 0.5) is everyone's score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_parts
from .hashing import LOWER, cut_words, word_hashes

#: Rows of either kind that the fit may use, at most.
SAMPLE = 20_000
FOLDS = 5
CUT = 0.3
STEPS = 1500
RATE = 0.05
DECAY = 1e-4

_CLASS = np.zeros((8, 256), np.int64)
for _row, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789",
                               b".,;:?'\"()-", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~", b"\n")):
    _CLASS[_row, list(_chars)] = 1
N_FEATURES = 36


def text_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of numbers per text."""
    n_docs = len(off) - 1
    starts, ends, first = cut_words(data, off)
    words = np.diff(first)
    w = np.maximum(words, 1)
    chars = np.maximum(np.diff(off), 1)

    def per_text(values, edges):
        return np.diff(np.concatenate([[0], np.cumsum(values)])[edges])

    upper, lower, digit, stop, bang, bar, symbol, line = (per_text(c[data], off) for c in _CLASS)
    letters = np.maximum(upper + lower, 1)
    high = per_text((data >= 128).astype(np.int64), off)
    out = [upper / letters, digit / chars, stop / w, bang / w, bar / w, symbol / w, line / w, high / chars]
    if len(starts):
        doc = np.repeat(np.arange(n_docs), words)
        h = word_hashes(LOWER[data], starts, ends)
        same = np.zeros(len(h), np.int64)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        order = np.lexsort((h, doc))
        new = np.ones(len(h), np.int64)
        new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        size = ends - starts
        capital = _CLASS[0][data[starts]]
        odd = 1 - (_CLASS[0] + _CLASS[1] + (np.arange(256) >= 128))[data[ends - 1]]
        out += [per_text(same, first) / w, per_text(new, first) / w, per_text(size, first) / w / 10,
                per_text((size > 24).astype(np.int64), first) / w, per_text((size <= 2).astype(np.int64), first) / w,
                per_text(capital, first) / w, per_text(odd, first) / w]
    else:
        out += [np.zeros(n_docs)] * 7
    x = np.stack(out, axis=1)
    x = np.concatenate([x, np.sqrt(x), (x[:, [0, 3, 4, 5, 8]] > 0.15).astype(float),
                        np.log1p(words)[:, None] / 10], axis=1)
    x[words == 0] = 0
    return x


def _features(col: pa.Array) -> np.ndarray:
    parts = [text_features(data, off) for _, _, data, off in text_parts(col)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))


def non_negative_pu(pos: np.ndarray, unl: np.ndarray, prior: float):
    """Weights, bias, means and scales of the features: the minimiser of the
    non-negative risk (logistic loss), by full-batch Adam steps."""
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    pos, unl = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    pos, unl = (np.concatenate([x, np.ones((len(x), 1))], axis=1) for x in (pos, unl))
    w, m, v = (np.zeros(pos.shape[1]) for _ in range(3))

    def push(x, s):  # mean logistic loss for label s, and its gradient
        z = s * (x @ w)
        return np.logaddexp(0, -z).mean(), -(x * (s / (1 + np.exp(np.clip(z, -50, 50))))[:, None]).mean(axis=0)

    for step in range(1, STEPS + 1):
        _, up = push(pos, 1.0)
        risk_p, down_p = push(pos, -1.0)
        risk_u, down_u = push(unl, -1.0)
        if risk_u - prior * risk_p >= 0:
            g = prior * up + down_u - prior * down_p
        else:  # the negative part went below zero: step back on it
            g = prior * down_p - down_u
        g = g + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], w[-1], mean, scale


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Model for ``score``: (weights, bias, mean, scale) and the class prior."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()
                          & (fold(F.col("doc_id")) != 0)).select("doc_id", "quality")
    share = marked.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    prior = min(0.99, max(0.01, 0.5 if share is None else share))
    key = F.xxhash64("doc_id", F.lit(8))
    positives = (marked.where("quality = 1").select("doc_id").distinct().orderBy(key).limit(sample)
                 .withColumn("kind", F.lit(1)))
    unlabelled = (docs.select("doc_id").where("doc_id IS NOT NULL")
                  .join(labels.select("doc_id"), "doc_id", "left_anti").distinct().orderBy(key).limit(sample)
                  .withColumn("kind", F.lit(0)))
    chosen = docs.select("doc_id", "text").join(F.broadcast(positives.unionByName(unlabelled)), "doc_id")

    def measure(batches):
        for b in batches:
            x = _features(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("kind"), pa.array(list(x), pa.list_(pa.float64()))],
                ["doc_id", "kind", "x"])

    rows = map_batches(chosen.select("doc_id", "kind", "text"), measure,
                       "doc_id long, kind int, x array<double>").orderBy("kind", "doc_id", "x").toArrow()
    kind = rows.column("kind").to_numpy()
    x = np.array(rows.column("x").to_pylist(), float).reshape(len(kind), N_FEATURES)
    if not len(kind) or kind.min() == kind.max():
        return (np.zeros(N_FEATURES), float(np.log(prior / (1 - prior))), np.zeros(N_FEATURES), np.ones(N_FEATURES)), prior
    return non_negative_pu(x[kind == 1], x[kind == 0], prior), prior


def score(docs: DataFrame, model) -> DataFrame:
    """The input's columns and ``score``: the chance of quality 1."""
    weights, bias, mean, scale = model
    names = docs.columns

    def run(batches):
        for b in batches:
            x = np.clip((_features(b.column("text")) - mean) / scale, -8, 8)
            z = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -50, 50)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(z, pa.float64())],
                                             [*names, "__score"])

    from pyspark.sql import types as T
    schema = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())])
    return map_batches(docs, run, schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model, _ = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
                         F.col("__score").alias("score"),
                         F.when(F.col("__score") >= CUT, 1).otherwise(0).alias("predicted"))
