import random

import pytest
from pyspark.sql import types as T

EXTRA = ["row", "pos", "h1", "nid", "copy", "positions", "size", "score", "n", "item_id", "line", "target"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in EXTRA])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) rows, with columns whose names clash with
    names that the operators use inside."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) + ("x",) * len(EXTRA) for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages and odd cases: (doc_id, text)."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 8))) for _ in range(900)]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    base = prose(150)
    passage = prose(70)
    boiler = prose(55)
    texts = [base, base, base.replace(" ", "\n", 3), base + " tail", prose(200) + " " + passage + " " + prose(30),
             passage, prose(20) + " " + passage[5:], prose(90), prose(3), "one", "", None, " \t\n ", "x" * 4000,
             "x" * 4000, "ab " * 500, "é" * 300, boiler, boiler + " end", "start " + boiler, prose(10) + boiler[30:] + prose(60),
             passage + " " + passage, prose(12000), base.upper(), "ab " * 499]
    words = base.split(" ")
    for i in range(12):  # near copies
        w = list(words)
        for j in range(i):
            w[(17 * j + i) % len(w)] = "edit%d" % j
        texts.append(" ".join(w))
    for i in range(20):  # a line in many documents
        texts.append(prose(rng.randint(5, 60)) + " " + boiler + " " + prose(rng.randint(5, 60)))
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(3 * k, texts[i]) for k, i in enumerate(order)]
    rows += [rows[0], (rows[1][0], "another text under an id that repeats " + prose(60)), (None, base), (None, None)]
    return rows


@pytest.fixture(scope="session")
def some(corpus):
    """The corpus without repeated and missing ids: what brute force reads easily."""
    seen = {}
    for doc_id, text in corpus:
        if doc_id is not None:
            seen.setdefault(doc_id, text)
    return sorted(seen.items())
