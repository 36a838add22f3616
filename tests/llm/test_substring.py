"""Byte, passage and line dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from minimus.llm import byte_dedup, line_dedup, passages
from minimus.llm.hashing import RangeHash
from minimus.llm.induced import Shard, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for it in range(400):
        t = rng.integers(1, rng.integers(2, 6), rng.integers(1, 60))
        if it % 3 == 0:
            t = np.tile(t[:max(1, len(t) // 4)], 6)
        limit = int(rng.choice([3, 8, 100]))
        sa, lcp = suffix_array(t, limit)
        x = t.tolist()

        def common(a, b):
            k = 0
            while k < limit and max(a, b) + k < len(x) and x[a + k] == x[b + k]:
                k += 1
            return k

        assert sorted(sa.tolist()) == list(range(len(x)))
        assert all(x[a:a + limit] <= x[b:b + limit] for a, b in zip(sa, sa[1:]))
        assert lcp.tolist() == [0] + [common(a, b) for a, b in zip(sa, sa[1:])]


def test_anchors_do_not_depend_on_the_part():
    """Anchors are the first smallest piece by the upper half of its hash, whatever stands beside a text."""
    rng = np.random.default_rng(2)
    texts = [b"", b"x" * 99, b"y" * 300, b"z" * 100, bytes(rng.integers(97, 100, 700, dtype=np.uint8)), b""]

    def owned(some):
        off = np.append(0, np.cumsum([len(t) for t in some])).astype(np.int64)
        place, lo, hi, doc, _ = byte_dedup._owned(np.frombuffer(b"".join(some), np.uint8), off)
        assert (np.diff(doc) >= 0).all()
        return [list(zip(*(x[doc == i] - off[i] for x in (place, lo, hi)))) for i in range(len(some))]

    together = owned(texts)
    assert together == [owned([t])[0] for t in texts]
    for text, got in zip(texts, together, strict=True):
        data = np.frombuffer(text, np.uint8)
        h = RangeHash(byte_dedup._BYTES[data], 0)
        at = np.arange(max(0, len(data) - byte_dedup.PIECE + 1))
        top = h.of(at, at + byte_dedup.PIECE) >> np.uint64(32)
        assert (h.every(byte_dedup.PIECE) >> np.uint64(32)).tolist() == top.tolist()
        want = [i + int(top[i:i + byte_dedup.PIECES].argmin()) for i in range(len(data) - byte_dedup.WINDOW + 1)]
        assert [p for p, lo, hi in got for _ in range(lo, hi + 1)] == want


def test_common_prefix_of_one_pair():
    rng = np.random.default_rng(3)
    for limit in (3, 100, 200):  # values fit a byte, or do not
        shard = Shard(np.append(np.tile(rng.integers(1, 3, 150), 2), 0).astype(np.int16), limit)
        a, b = rng.integers(0, 301, 200), rng.integers(0, 301, 200)
        a, b = a[a != b], b[a != b]
        assert shard.common(a, b).tolist() == [shard.common_of(x, y) for x, y in zip(a, b)]


def brute_bytes(rows):
    seen, out = set(), {}
    for doc_id, text in rows:
        w = (text or "").encode()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 99):
            if w[i:i + 100] in seen:
                gone[i:i + 100] = True
            seen.add(w[i:i + 100])
        kept = bytes(np.frombuffer(w, np.uint8)[~gone])
        runs = sum(1 for i in range(len(w)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(w), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_bytes_match_brute_force(make_docs, some):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in byte_dedup.byte_report(make_docs(some)).collect()}
    assert got == brute_bytes(some)


def test_bytes_of_hot_anchors(make_docs, some, monkeypatch):
    """Anchors with too many spans for a shard take the other way; results agree."""
    monkeypatch.setattr(byte_dedup, "SHARD_SPANS", 2)
    monkeypatch.setattr(byte_dedup, "SHARD_BYTES", 500)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in byte_dedup.byte_report(make_docs(some)).collect()}
    assert got == brute_bytes(some)


@pytest.mark.parametrize("spans", [4096, 1])
def test_bytes_of_equal_rows_with_partial_matches(make_docs, monkeypatch, spans):
    """Equal rows are one document to the others, and are cut alike, on both ways."""
    monkeypatch.setattr(byte_dedup, "SHARD_SPANS", spans)
    rng = random.Random(13)

    def prose(n):
        return "".join(rng.choice("abcdefghij") for _ in range(n))

    shared, other = prose(300), prose(200)
    rows = [(1, prose(150) + shared[:200]), (2, shared + other), (4, other + prose(120)),
            (5, prose(90) + other[:150] + prose(90))]
    got = byte_dedup.byte_report(make_docs([*rows, rows[1], rows[2], rows[1]])).collect()
    got = sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got)
    want = brute_bytes(rows)
    assert got == sorted((d, want[d]) for d in (1, 2, 2, 2, 4, 4, 5))


def brute_passages(rows):
    first, out = {}, {}
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i:i + 50]), doc_id) < doc_id:
                gone[i:i + 50] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc_id] = (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_passages_match_brute_force(make_docs, some):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256)
           for r in passages.passage_report(make_docs(some)).collect()}
    assert got == brute_passages(some)


def test_passage_repeated_inside_a_document(make_docs):
    """Copies that fall alike in one document, of a passage that a smaller document has
    between other words: all of them go, also under a doc_id that repeats."""
    rng = random.Random(11)

    def prose(n):
        return " ".join("w%d" % rng.randrange(10 ** 6) for _ in range(n))

    passage = prose(60)
    block = prose(20) + " " + passage + " " + prose(13)  # 93 words, three periods
    rows = [(1, prose(100) + " " + passage + " " + prose(100)), (2, " ".join([block] * 5)), (3, block + " " + block)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256)
           for r in passages.passage_report(make_docs(rows)).collect()}
    assert got == brute_passages(rows)
    assert got[2][1] == 300
    twin = [rows[0], (2, block), (2, block + " " + prose(40))]
    assert sorted(r.n_removed for r in passages.passage_report(make_docs(twin)).collect()) == [0, 60, 60]


def test_difference_cover():
    shifts = {(a - b) % passages.PERIOD for a in passages.COVER for b in passages.COVER}
    assert shifts == set(range(passages.PERIOD))


@pytest.mark.parametrize("report", [byte_dedup.byte_report, passages.passage_report, line_dedup.line_report])
def test_repeated_and_missing_ids(make_docs, corpus, report):
    rows = report(make_docs(corpus)).collect()
    assert len(rows) == len(corpus)
    if report is not line_dedup.line_report:  # rows without an id are kept as they are
        assert all(r.n_removed == 0 for r in rows if r.doc_id is None)
    twice = [r for r in rows if r.doc_id == corpus[0][0]]
    assert len(twice) == 2


@pytest.mark.parametrize("report", [byte_dedup.byte_report, passages.passage_report, line_dedup.line_report])
def test_empty_tables(make_docs, report):
    assert report(make_docs([])).collect() == []
    assert len(report(make_docs([(1, None), (2, "")])).collect()) == 2


def brute_lines(rows):
    first = {}
    for doc_id, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\x0b\x0c\r")
            if line:
                first.setdefault(line, (doc_id, i))

    def near(a, b):
        if min(len(a), len(b)) < line_dedup.MIN_CHARS or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) < len(b):
            a, b = b, a
        return any(a[:i] + a[i + 1:] == b for i in range(len(a)))

    drop = {a for a in first for b in first if first[b] < first[a] and near(a, b)}
    out = {}
    for doc_id, text in rows:
        kept, n = [], 0
        for i, line in enumerate((text or "").split("\n")):
            s = line.strip(" \t\x0b\x0c\r")
            if s and (s in drop or first[s] != (doc_id, i)):
                n += 1
            else:
                kept.append(line)
        out[doc_id] = (n, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_lines_match_brute_force(make_docs):
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcd é") for _ in range(rng.choice([3, 8, 9, 10, 11, 40, 200]))) for _ in range(40)]
    rows = []
    for k in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            x = rng.choice(lines)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(x) + 1)
                x = rng.choice([x[:i] + rng.choice("abé") + x[i:], x[:i] + x[i + 1:], x[:i] + rng.choice("bd") + x[i + 1:]])
            text.append(rng.choice(["", " ", "\t"]) + x)
        rows.append((k, rng.choice(["\n", "\n\n", "\r\n"]).join(text)))
    rows += [(100, "z" * 3000), (101, "z" * 2999), (102, None), (103, "z" * 1500 + "y" + "z" * 1499)]
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in line_dedup.line_report(make_docs(rows)).collect()}
    want = brute_lines(rows)
    assert sum(v[0] for v in want.values()) > 30
    assert got == want


def test_near_lines_of_rows_without_id(make_docs):
    """Rows without doc_id come first, and their lines are compared like any other."""
    rows = [(None, "a line of some length\nand one more of them"), (1, "a line of sume length\nsomething else here"),
            (2, "something else her\nand one more of thm"), (None, "a line of some lengthy")]
    got = line_dedup.line_report(make_docs(rows)).collect()
    assert sum(r.n_removed for r in got if r.doc_id is None) == 1
    assert {r.doc_id: r.n_removed for r in got if r.doc_id is not None} == {1: 1, 2: 2}
