"""Properties of the D-grade operators and the leak test (§5.5)."""
import re

import pytest
from pyspark.sql import functions as F

from minimus.functions.pii import LEVEL_CLASSES, PATTERN, mask_pii
from minimus.functions.text import clean_text
from minimus.plans.queries_text import document_base, document_chain
from minimus.sources.tables import read_table

CLASS_RE = {k: re.compile(v) for k, v in PATTERN.items()}


def _luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x)
               for i, x in enumerate(d)) % 10 == 0


def _leaks(text, level):
    found = []
    for cls in LEVEL_CLASSES[level]:
        if cls == "card_luhn":
            found += [m for m in CLASS_RE["card"].findall(text) if len(m) <= 19 and _luhn(m)]
        else:
            found += CLASS_RE[cls].findall(text)
    return found


@pytest.fixture(scope="module")
def masked(spark, sf):
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    t = docs.select("doc_id", clean_text("text").alias("text"))
    out = t.select("doc_id", "text", *[mask_pii("text", lv).alias(lv) for lv in LEVEL_CLASSES])
    again = out.select("doc_id", *[mask_pii(lv, lv).alias(lv + "2") for lv in LEVEL_CLASSES],
                       *LEVEL_CLASSES)
    return again.collect()


def test_no_class_left_and_idempotent(masked):
    for r in masked:
        for lv in LEVEL_CLASSES:
            assert _leaks(r[lv], lv) == [], (r.doc_id, lv)
            assert r[lv + "2"] == r[lv]


def test_higher_level_masks_more(masked):
    """What a higher level leaves is found by no lower level's patterns, and it never
    leaves fewer placeholders."""
    for r in masked:
        assert r["low"].count("<") <= r["medium"].count("<") <= r["high"].count("<")
        assert _leaks(r["high"], "medium") == [] == _leaks(r["medium"], "low")


@pytest.fixture(scope="module")
def chain(spark, sf):
    return document_chain(spark, sf)


def test_selection_bounds(chain):
    svt = chain.svt.groupBy("pid", "level", "attempt").agg(
        F.count(F.lit(1)).alias("n"), F.max("c_att").alias("c_att"), F.max("n_seg").alias("ns"))
    for r in svt.collect():
        assert r.n <= max(1, -(-r.c_att * r.ns // 1))
    topk = chain.topk.groupBy("pid", "level", "attempt").agg(
        F.count(F.lit(1)).alias("n"), F.max("k_att").alias("k"), F.max("n_seg").alias("ns"))
    for r in topk.collect():
        assert r.n <= max(1, -(-r.k * r.ns // 1))


def test_rebuilt_is_subsequence_and_attempts(chain):
    rows = chain.rebuilt.join(chain.masked.select("pid", "level", "masked"),
                              ["pid", "level"]).collect()
    for r in rows:
        pos = 0
        for seg in r.simplified.split(" "):
            i = r.masked.find(seg, pos)
            assert i >= 0
            pos = i + len(seg)
    ch = chain.chosen.collect()
    assert all(1 <= r.attempt <= 3 for r in ch)
    assert all(r.status in ("approved", "rejected") for r in ch)


def test_payload_has_no_pii(spark, sf):
    from minimus.plans.queries_flow import sweep
    ch = sweep(spark, sf)
    originals = {str(r.doc_id): r.text for r in read_table(spark, sf, "documents", ["doc_id", "text"]).collect()}
    for r in ch.chosen.select("pid", "level", "simplified").collect():
        for secret in _leaks(originals[r.pid], r.level):  # found in the original, not in the output
            assert secret not in r.simplified
    for r in ch.chosen.select("level", "simplified").collect():
        assert _leaks(r.simplified, r.level) == []


def test_report_rollup(spark, sf):
    from minimus.plans.queries_flow import minimization_report, sweep
    rep = minimization_report(sweep(spark, sf).chosen).collect()
    total = [r for r in rep if r.gid == 3][0]
    assert total.n_prompts == 3 * document_base(spark, sf).count()
    assert total.chars_after <= total.chars_before
