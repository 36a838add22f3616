"""Hand rows for the grade-C semantics (FIXTURES.md)."""
import datetime as dt

from pyspark.sql import functions as F

from minimus.functions.text import clock, js_trim, word_count
from minimus.operators import messages as M
from minimus.operators.admission import single_flight
from minimus.operators.asof import asof_backward
from minimus.schema import MESSAGE, RESPONSE


def test_js_trim_and_blank(spark):
    df = spark.createDataFrame([("\t  x \n",), ("",), ("   ",), (" ",),
                                ("　a b﻿",)], "s string")
    got = [r.t for r in df.select(js_trim("s").alias("t")).collect()]
    assert got == ["x", "", "", "", "a b"]
    kept = M.non_blank(df, "s").collect()
    assert [r.s for r in kept] == ["\t  x \n", "　a b﻿"]


def test_level_default_and_quarantine(spark):
    df = spark.createDataFrame([(None,), ("medium",), ("HIGH",)], "simplify string")
    ok, bad = M.with_level(df)
    assert sorted(r.simplify for r in ok.collect()) == ["medium", "medium"]
    assert [r.simplify for r in bad.collect()] == ["HIGH"]


def test_words_and_clock(spark):
    df = spark.createDataFrame([("",), ("a  b ",)], "s string")
    assert [r.n for r in df.select(word_count("s").alias("n")).collect()] == [1, 4]
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 5, 9),),
                                (dt.datetime(2024, 1, 1, 23, 59, 59),)], "t timestamp_ntz")
    assert [r.c for r in ts.select(clock("t").alias("c")).collect()] == ["00:05:09", "23:59:59"]


def _msgs(spark, rows):
    return spark.createDataFrame(rows, MESSAGE)


def test_history_and_asof(spark):
    t = dt.datetime(2024, 1, 1, 10, 0, 0)
    rows = [
        (1, 0, "assistant", "hi", t, None, "first"),          # no earlier user -> own ts
        (1, 1, "user", "q", t + dt.timedelta(seconds=5), "low", None),
        (1, 2, "assistant", "a", t + dt.timedelta(seconds=9), None, None),   # NULL: dropped
        (1, 3, "assistant", "b", t + dt.timedelta(seconds=11), None, ""),    # '' kept
        (1, 4, "assistant", "c", t + dt.timedelta(seconds=13), None, "s"),
    ]
    msgs = _msgs(spark, rows)
    hist = M.history_rows(msgs).collect()
    assert sorted(r.turn for r in hist) == [0, 3, 4]
    for bucket in (None, F.col("turn") / 2):
        out = asof_backward(msgs, "conv_id", "turn",
                            target=(F.col("role") == "assistant")
                            & F.col("simplified_message").isNotNull(),
                            anchor=F.col("role") == "user", value="ts", out="d",
                            fallback="ts", bucket=bucket.cast("bigint") if bucket is not None
                            else None)
        got = {r.turn: r.d for r in out.collect()}
        assert got == {0: t, 3: t + dt.timedelta(seconds=5), 4: t + dt.timedelta(seconds=5)}


def test_single_flight_busy(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 0, "user", "a", t, "low", None), (1, 1, "user", "b", t, "low", None),
            (1, 2, "assistant", "r", t, None, None), (1, 3, "user", "c", t, "low", None)]
    got = sorted(r.turn for r in single_flight(_msgs(spark, rows)).collect())
    assert got == [0, 3]


def test_route_response_cases(spark):
    cases = [
        ("a1", '{"success":false}', [(M.TEXT_FAILED, None)]),
        ("a2", '{"success":false,"error":"x"}', [(M.TEXT_FAILED, None)]),
        ("a3", '{"success": tru', [(M.TEXT_FAILED, None)]),
        ("b1", '{"success":true}', [(M.TEXT_FAILED, None)]),
        ("b2", '{"success":true,"data":null}', [(M.TEXT_FAILED, None)]),
        ("c1", '{"success":true,"data":{}}', [(M.TEXT_NOT_APPROVED, None)]),
        ("c2", '{"success":true,"data":{"result":null}}', [(M.TEXT_NOT_APPROVED, None)]),
        ("c3", '{"success":true,"data":{"result":{"status":"rejected","answer":"x"}}}',
         [(M.TEXT_NOT_APPROVED, None)]),
        ("c4", '{"success":true,"data":{"result":{"status":"Approved","answer":"x"}}}',
         [(M.TEXT_NOT_APPROVED, None)]),
        ("d", '{"success":true,"data":{"result":{"status":"approved","simplifiedMessage":"s"}}}',
         [("", "s"), (M.TEXT_FAILED, None)]),
        ("e1", '{"success":true,"data":{"result":{"status":"approved","answer":"hi",'
               '"simplifiedMessage":"s"}}}', [("hi", "s")]),
        ("e2", '{"success":true,"data":{"result":{"status":"approved","answer":"hi"}}}',
         [("hi", None)]),
        ("e3", '{"success":true,"data":{"result":{"status":"approved","answer":""}}}',
         [("", None)]),
    ]
    df = spark.createDataFrame([(k, j) for k, j, _ in cases], "k string, j string")
    parsed = df.select("k", F.from_json("j", RESPONSE).alias("resp"))
    out = M.route_response(parsed).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.k, r.sub)):
        got.setdefault(r.k, []).append((r.content, r.simplified_message))
    assert got == {k: v for k, _, v in cases}
    errs = {r.k: r.error for r in parsed.select(
        "k", M.unwrap_response(F.col("resp"))["error"].alias("error")).collect()}
    assert errs["a1"] == "Pipeline failed" and errs["a2"] == "x" and errs["a3"] == "Pipeline failed"
    assert errs["e1"] is None
