"""O01 stored-log scan, O04 append sink, O05 payload sink."""
import json

from minimus.plans.queries_flow import q_finalize_payload
from minimus.session import scratch_path
from minimus.sources.json_io import append_to_log, write_payloads
from minimus.sources.messages import chat_log, read_messages


def test_append_and_read_back(spark, sf):
    log = chat_log(spark, sf)
    path = scratch_path(spark, "log-store")
    users = log.where("role = 'user'")
    replies = log.where("role = 'assistant'")
    append_to_log(users, path)
    append_to_log(replies, path)
    back = read_messages(spark, path)
    assert back.schema == log.schema
    assert sorted(back.collect()) == sorted(log.collect())


def test_payload_lines(spark, sf):
    pay = q_finalize_payload(spark, sf)
    path = scratch_path(spark, "payloads")
    write_payloads(pay, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert len(lines) == pay.count() > 0
    for line in lines:
        p = json.loads(line)
        assert p["status"] in ("approved", "rejected")
        assert "simplifiedMessage" in p and "review" in p
        hist = p["review"]["retryHistory"]
        assert 1 <= len(hist) <= 3 and [h["attempt"] for h in hist] == list(range(1, len(hist) + 1))
        assert hist[-1]["passed"] == (p["status"] == "approved")
