"""Jaccard join against brute force."""

import random
import re

import numpy as np

from minimus.llm import components, jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows):
    out = {}
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate(FOLD))
        out[doc_id] = {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    return out


def brute(rows):
    sets = sets_of(rows)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def check(make_docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_report(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_corpus(make_docs, some):
    check(make_docs, some)


def test_chains_at_the_threshold(make_docs):
    """Texts that drift away from each other: neighbours link, distant ones do not, and a
    pivot is not linked with all of its list."""
    rng = random.Random(3)
    rows = []
    for c in range(6):
        w = [f"w{c}x{rng.randrange(10 ** 6)}" for _ in range(rng.choice([12, 40, 120]))]
        for k in range(25):
            rows.append((len(rows), " ".join(w)))
            w = list(w)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10 ** 6)}"
    rng.shuffle(rows)
    check(make_docs, [(i, t) for i, (_, t) in enumerate(rows)])


def near_group(size, rng):
    """Near copies around one text, some linked with each other, some not, and an outsider
    with the same rare words."""
    w = [f"g{i}" for i in range(120)]
    rows = []
    for _ in range(size):
        x = list(w)
        for _ in range(rng.randint(0, 6)):
            x[rng.randrange(len(x))] = f"n{rng.randrange(10 ** 6)}"
        rows.append(" ".join(x))
    rows.append(" ".join(w[:60] + [f"o{i}" for i in range(60)]))
    return rows


def test_lists_in_chunks(make_docs, some, monkeypatch):
    """Lists longer than a chunk, and steps of a few pairs."""
    monkeypatch.setattr(jaccard, "LIST_CHUNK", 3)
    monkeypatch.setattr(jaccard, "PAIR_STEP", 10)
    texts = [t for _, t in some[:20]] + near_group(30, random.Random(9))
    check(make_docs, list(enumerate(texts)))


def test_pairs_grow_with_rows(make_docs, monkeypatch):
    """A near-copy group of a third of all rows: what is compared grows with the rows."""
    real, counts = jaccard.ask, []

    def counted(*args):
        out = real(*args)
        counts.append(out.count())
        return out
    monkeypatch.setattr(jaccard, "ask", counted)
    seen = []
    for size in (40, 160):
        rng = random.Random(size)
        other = [" ".join(f"x{rng.randrange(10 ** 6)}" for _ in range(30)) for _ in range(2 * size)]
        counts.clear()
        check(make_docs, list(enumerate(near_group(size, rng) + other)))
        seen.append(sum(counts))
    assert seen[1] <= 6 * max(seen[0], 40)


def test_odd_rows(make_docs, corpus):
    rows = jaccard.jaccard_report(make_docs(corpus)).collect()
    assert len(rows) == len(corpus)
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert jaccard.jaccard_report(make_docs([])).collect() == []
    empty = jaccard.jaccard_report(make_docs([(4, ""), (5, None), (6, " ")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in empty) == [(4, 0, 4), (5, 0, 5), (6, 0, 6)]


def test_one_of_each_keeps_the_first(make_docs, some):
    docs = make_docs(some)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {d for d, (_, c) in brute(some).items() if c == d}
    assert {r.doc_id for r in kept.collect()} == want


def test_components_of_a_long_path(spark):
    n = 300
    order = np.random.default_rng(2).permutation(n)
    links = [(int(order[i]), int(order[i + 1])) for i in range(n - 1) if i != 100]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    halves = [set(order[:101].tolist()), set(order[101:].tolist())]
    assert got == {x: min(h) for h in halves for x in h}
