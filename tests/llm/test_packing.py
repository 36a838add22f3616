"""Packing: the plan against brute force, every id once, padding."""

import itertools
import random
import zlib

import numpy as np
import pytest

from minimus.llm import packing, queries

TOKENIZER = queries.tokenizer_path()


def cheapest(cuts, fine, size):
    """Least cost over all choices of cuts."""
    best = None
    inner = range(1, len(cuts) - 1)
    for n in range(len(cuts) - 1):
        for some in itertools.combinations(inner, n):
            at = [0, *some, len(cuts) - 1]
            lengths = [cuts[b] - cuts[a] for a, b in itertools.pairwise(at)]
            if max(lengths) <= size:
                cost = sum(packing.padding(x, size) for x in lengths) + sum(fine[i] for i in at[1:])
                best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("size", [8, 12, 16])
def test_plan_is_cheapest(size):
    rng = random.Random(size)
    for _ in range(60):
        cuts = [0]
        while len(cuts) < 11:
            cuts.append(cuts[-1] + rng.randint(1, min(7, size)))
        fine = [0] + [rng.choice([0, 1, 3, 9]) for _ in cuts[1:]]
        cost, ends = packing.plan(cuts, fine, size)
        assert cost == cheapest(cuts, fine, size)
        lengths = np.diff([0, *ends])
        assert max(lengths) <= size and set(ends) <= set(cuts) and ends[-1] == cuts[-1]
        assert cost == sum(packing.padding(int(x), size) for x in lengths) + sum(fine[cuts.index(e)] for e in ends)


def check_pieces(rows, got):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(TOKENIZER)
    want = sorted((d if d is not None else -1, t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x in rows)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id if r.doc_id is not None else -1, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    total = 0
    for d, ids in want:
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    assert sum(r.length for r in got) == total
    pad = 0
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE
        pad += packing.padding(at)
    return pad / total, len(by_sequence)


def test_every_id_in_one_piece(spark, make_docs, some):
    rows = [*some, (100_000, "a b c d. " * 6000), (100_001, "word " * 9000), (100_002, None), (100_003, "3.14 " * 900)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        share, n = check_pieces(rows, packing.packing_report(make_docs(rows), TOKENIZER).collect())
        assert share < 0.06 and n > 10  # two short last sequences among few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_runs_join(make_docs, some, monkeypatch):
    """Many short runs: the last window of each opens the next."""
    got = packing.pack(make_docs(some), TOKENIZER, size=64, run=300).collect()
    assert all(0 < r.length <= 64 and len(r.ids) == 4 * r.length for r in got)
    seen = {}
    for r in got:
        for p in r.pieces:
            seen.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
    assert len(seen) == len(some)
    for spans in seen.values():
        at = 0
        for start, length, total in sorted(spans):
            assert start == at
            at += length
        assert at == total


def test_sentence_ends():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(TOKENIZER)
    ids = np.array(t.encode("One two three. Pi is 3.14 now! End", add_special_tokens=False).ids + [2])
    places, fine = packing.cut_places(ids, np.array([len(ids)]), *packing.sentence_tables(TOKENIZER, 2))
    words = [t.id_to_token(i).removesuffix("</w>") for i in ids.tolist()]
    assert [words[p - 1] for p, f in zip(places, fine, strict=True) if f == packing.AT_SENTENCE] == [".", "!"]
    assert [int(p) for p, f in zip(places, fine, strict=True) if f == 0] == [0, len(ids)]
    long = np.concatenate([np.repeat(ids[:1], 500), ids[-1:]])
    places, _ = packing.cut_places(long, np.array([len(long)]), *packing.sentence_tables(TOKENIZER, 2))
    assert max(np.diff(places)) <= packing.LONG


def test_odd_rows(make_docs):
    assert packing.packing_report(make_docs([]), TOKENIZER).collect() == []
    rows = [(None, None), (1, ""), (2, " \n"), (3, "<|endoftext|>a.b")]
    check_pieces(rows, packing.packing_report(make_docs(rows), TOKENIZER).collect())
    twice = packing.packing_report(make_docs([(7, "same text"), (7, "same text"), (7, "other")]), TOKENIZER).collect()
    assert sorted((r.doc_id, r.start) for r in twice) == [(7, 0)] * 3
