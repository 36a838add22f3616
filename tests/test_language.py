"""Language identification: held-out documents, odd texts, fillers of chat prompts."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from minimus.functions.text import clean_text
from minimus.operators import language
from minimus.operators.language import TOP, fit_language, identify, with_language
from minimus.plans.queries_flow import chat_prompts, minimize_log
from minimus.operators.policy import FILLERS
from minimus.sources.tables import read_table


def documents(spark, sf):
    docs = read_table(spark, sf, "documents", ["doc_id", "text", "lang"])
    return docs.select(F.col("doc_id").cast("string").alias("pid"), "lang", clean_text("text").alias("text"),
                       (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"))


def test_held_out_documents(spark, sf):
    docs = documents(spark, sf).where("length(text) > 20 AND lang IS NOT NULL")
    model = fit_language(docs.where("NOT held_out"))
    grams = model.select("gram").distinct().count()
    assert grams <= TOP and model.count() == grams * docs.select("lang").distinct().count()
    held = docs.where("held_out").withColumnRenamed("lang", "truth").join(identify(docs.where("held_out"), model), "pid")
    right = held.agg(F.avg((F.col("lang") == F.col("truth")).cast("double"))).first()[0]
    assert held.count() >= 20 and right >= 0.9, right


def test_odd_texts(spark, sf):
    model = fit_language(documents(spark, sf))
    rows = spark.createDataFrame([("a", ""), ("b", None), ("c", "12 34 !"), ("d", "qqqqqqqq"), ("e", "the of and that")],
                                 "pid string, text string")
    got = dict(with_language(rows, model).select("pid", "lang").collect())
    assert (got["a"], got["b"], got["c"]) == ("und",) * 3 and got["e"] == "en"
    none = fit_language(documents(spark, sf).limit(0))
    assert none.count() == 0
    assert {r.lang for r in with_language(rows, none).collect()} == {"und"}


def test_prompts_lose_their_fillers(spark, sf):
    base, _ = chat_prompts(spark, sf)
    assert base.where("lang <> 'und'").count() > 0.9 * base.count()
    res, ch = minimize_log(spark, sf)
    rows = res.join(ch.chosen.select("pid", "lang"), "pid").select("lang", "simplified").collect()
    assert rows
    for r in rows:
        words = set(r.simplified.lower().split())
        assert not words & set(FILLERS.get(r.lang, []))


ODD = [("a", "the cat, the CAT"), ("b", "Übung"), (None, "x yz"), ("a", ""), ("b", None), ("a", "12 !"), ("c", "\U00010428\U00010429 b"),
       ("c", "\u4e2d\u6587\u5b57 \u4e2d\u6587\u5b57"), ("a", "me@example.com and 1234567"), ("b", "q")]


@pytest.mark.parametrize("cells", [language.CELLS, 0])
def test_counts_leave_the_tasks(spark, monkeypatch, cells):
    """Trigram counts equal brute force by Spark's own columns, with either way of counting; what leaves a
    task are the different trigrams of its texts, not each place of one."""
    monkeypatch.setattr(language, "CELLS", cells)
    pairs = [language._pair_counts(np.array(k, np.int64), np.array(c, np.int64), 3, 9) for k, c in [([0, 2, 2, 2], [8, 1, 1, 0]), ([], [])]]
    assert [sorted(zip(*(x.tolist() for x in p))) for p in pairs] == [[(0, 8, 1), (2, 0, 1), (2, 1, 2)], []]
    rows = spark.createDataFrame([(k, t) for k, t in ODD for _ in range(50)], "lang string, text string").coalesce(1)
    want = collections.Counter()
    for r in rows.select("lang", language.letter_text("text").alias("t")).collect():
        want.update((r.lang, r.t[i:i + 3]) for i in range(len(r.t or "") - 2))
    parts = language._part_counts(rows, "lang", "text").collect()
    assert len(parts) == len(want)
    assert {(r.lang, r.gram): r.n for r in language._counted(rows, "lang").collect()} == want


def test_languages_are_identified_once(spark, sf):
    """The plan of the prompts reads what was identified and has no Python step of its own."""
    base, _ = chat_prompts(spark, sf)
    plan = base._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "(.{3})" not in plan
