"""Plan shape checks: what must (not) shuffle, what must reach the scan."""
import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from minimus.plans.queries_text import document_chain


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_chain_reuses_pid_buckets(spark, sf):
    ch = document_chain(spark, sf)  # in a session without settings of ours
    plan = _plan(ch.round(1))
    assert "Bucketed: true" in plan
    assert "Exchange" not in _plan(ch.chosen)
    # after the masked stage the only shuffles are the tiny score histogram
    # (keyed by level); nothing re-partitions the per-prompt rows
    for line in plan.splitlines():
        if "Exchange hashpartitioning(" in line:
            assert "hashpartitioning(level" in line, line


def test_knn_top_k_is_partial_before_shuffle(spark, sf):
    plan = _plan(E.queries()["noisy_knn"](spark, sf))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_prune_and_push(spark, sf):
    plan = _plan(E.queries()["pii_findings"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = _plan(E.queries()["user_messages"](spark, sf))
    assert "role#" in plan and "IN (user,assistant)" in plan


def test_no_cross_joins_anywhere(spark, sf):
    for name in ["typo_corrections", "simplify_history", "asof_last_view", "response_routing",
                 "conversation_stats", "pii_findings"]:
        plan = _plan(E.queries()[name](spark, sf))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_stage_tables_leave_the_catalog(spark, sf):
    document_chain(spark, sf).masked.count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("minimus_stage")]


def test_buckets_follow_the_input(spark, sf, monkeypatch):
    from minimus import session
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.bucket_count(docs) == least
    monkeypatch.setattr(session, "BUCKET_BYTES", 1000)
    n = session.bucket_count(docs)
    assert n > least and session.bucket_count(docs, 3) > 2 * n
    monkeypatch.setattr(session, "MAX_BUCKETS", 50)
    assert session.bucket_count(docs) == 50


def test_a_bucket_fits_a_task(spark, sf, monkeypatch):
    """Each level's copy of the input gets buckets of its own, small enough to be sorted in memory."""
    from minimus import session
    monkeypatch.setattr(session, "input_bytes", lambda df: 6 << 30)
    n = session.bucket_count(spark.range(1), 3)
    assert (6 << 30) * 3 / n <= 64 << 20


def test_a_checkpoint_counts_by_its_files(spark, sf, monkeypatch):
    """What a join is estimated at, the product of its sides, is no size of the rows that it left behind."""
    from minimus import session
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    size = session.input_bytes(docs)
    kept = session.cut_lineage(docs.join(docs.withColumnRenamed("doc_id", "other"), F.col("doc_id") == F.col("other")))
    assert 0 < session.input_bytes(kept) <= 200 * docs.count()
    monkeypatch.setattr(session, "BUCKET_BYTES", 10 * size)
    assert session.bucket_count(docs.join(kept, "doc_id")) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_chat_prompts_get_buckets_by_their_size(spark, sf):
    """The identified languages are a checkpoint of joins; its estimate asked for thousands of buckets."""
    from minimus import session
    from minimus.plans.queries_flow import chat_prompts
    base, _ = chat_prompts(spark, sf)
    assert session.bucket_count(base) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cluster_needs_a_shared_folder():
    from minimus import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="share"):
        session.ensure_checkpoint_dir(Session())
    assert session.is_local("local[4]") and session.is_local("local")
    assert not session.is_local("local-cluster[2,1,1024]") and not session.is_local(None)


def test_running_settings_win(spark):
    from minimus.session import get_spark
    before = spark.conf.get("spark.sql.shuffle.partitions")
    get_spark(shuffle_partitions=777)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_public_view_moves_no_raw_text(spark, sf):
    plan = E.queries()["public_view"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    import re
    for exchange in re.findall(r"Exchange hashpartitioning[^\n]*\n\s*\+- [^\n]*", plan):
        assert not re.search(r"(?<![_a-z.])text#", exchange.split("AS")[0]), exchange
