"""Ranked lexical search: brute force, SQL, item blocks, classes of copies."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from minimus.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    bags = [(d, Counter(split(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, total = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, bag, size in bags:
            m = 75 + (25 * size * n) // total
            points = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
                         for t in split(text) if t in bag)
            if points > 0:
                found.append((-points, d))
        out += [(item, i + 1, d, -p) for i, (p, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def search_case():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "x-y", "A1", "don't", "日本"]

    def prose(n):
        return " ".join(rng.choice(words[:1 + rng.randrange(len(words))]) for _ in range(n))

    docs = [(i, prose(rng.randint(0, 40))) for i in range(150)]
    docs += [(200 + i, "w1 W2 w3 unrelated") for i in range(60)] + [(300, None), (301, " .. "), (302, "x" * 50000)]
    docs += [(400 + i, "other words " * (i % 3 + 1)) for i in range(30)]
    items = [(i, prose(rng.randint(1, 12))) for i in range(9)] + [(20, "w1 w1 w2"), (21, "nowhere"), (22, None), (23, "!")]
    return docs, items


def tables(spark, case):
    docs = spark.createDataFrame([(*r, "x") for r in case[0]], "doc_id long, text string, bag string")
    items = spark.createDataFrame([(*r, "x") for r in case[1]], "item_id long, text string, score string")
    return docs, items


def test_brute_force(spark, search_case):
    got = lexical.search(*tables(spark, search_case))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(*search_case)


def test_few_and_blocks(spark, search_case, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_ROWS", 3)
    monkeypatch.setattr(lexical, "CELLS", 50)
    docs, items = tables(spark, search_case)
    assert sorted(map(tuple, lexical.search(docs.repartition(5), items, 3).collect())) == brute(*search_case, 3)


def test_matches_sql(spark, search_case):
    docs, items = tables(spark, search_case)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", items.toArrow())
    assert sorted(con.sql(lexical.SEARCH_SQL).fetchall()) == brute(*search_case)


def test_odd_tables(spark, make_docs):
    item = "item_id long, text string"
    some = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "b")], item)
    none = spark.createDataFrame([], item)
    docs = make_docs([(None, "b a"), (3, "b a"), (3, "b a"), (4, "c C"), (5, "z")])
    assert lexical.search(docs, none).collect() == []
    assert lexical.search(make_docs([]), some).collect() == []
    got = lexical.search(docs, some).collect()
    assert [r.doc_id for r in sorted((r for r in got if r.item_id == 1), key=lambda r: r.rank)] == [4, None, 3, 3]
    assert [r.rank for r in sorted((r for r in got if r.item_id is None), key=lambda r: r.rank)] == [1, 2, 3]


def test_terms_are_those_of_the_pattern():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(128, 400), 0x3000, 0x85, 0x10FFFF])) for _ in range(30))
        assert [t.decode() for t in lexical.terms(text.encode())] == split(text)
