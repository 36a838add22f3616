"""Signed-count corpus state against full rebuilds."""

import pytest
from pyspark.sql import functions as F

from minimus.operators.corpus_state import CorpusState
from minimus.operators.policy import policy_df
from minimus.operators.select import histogram, thresholds
from minimus.operators.vocab import build_vocab, corpus_sizes, idf_table
from minimus.plans.queries_text import document_base
from minimus.plans.simplify import attempt_plan, simplify_chain
from minimus.session import scratch_path


@pytest.fixture(scope="module")
def base(spark, sf):
    return document_base(spark, sf).cache()


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def rebuild(docs):
    return idf_table(build_vocab(docs), corpus_sizes(docs))


def thirds(base):
    h = F.pmod(F.xxhash64("pid"), F.lit(3))
    return [base.where(h == i) for i in range(3)]


def test_additions_and_removals_equal_a_rebuild(spark, base):
    a, b, c = thirds(base)
    state = CorpusState(spark, scratch_path(spark, "state"))
    assert state.vocab().count() == 0 and state.versions() == []
    assert state.apply(0, added=a) and state.apply(1, added=b) and state.apply(2, added=c, removed=a)
    assert rows(state.idf(0)) == rows(rebuild(a))
    assert rows(state.idf(1)) == rows(rebuild(a.unionByName(b)))
    assert rows(state.idf()) == rows(rebuild(b.unionByName(c)))
    assert not state.apply(2, added=c, removed=a)  # run again
    state.compact(1)
    assert rows(state.idf()) == rows(rebuild(b.unionByName(c))) and rows(state.idf(0)) == rows(rebuild(a))
    state.apply(3, removed=b.unionByName(c))
    assert state.idf().count() == 0 and state.sizes().count() == 0


def test_changed_documents(spark, base):
    state = CorpusState(spark, scratch_path(spark, "state"))
    changed = base.withColumn("text", F.concat("text", F.lit(" quixotic addendum")))
    state.apply(0, added=base)
    state.apply(1, added=changed, removed=base)
    assert rows(state.idf()) == rows(rebuild(changed))
    # a version that takes out what came in leaves no rows
    assert state.deltas["vocab"].read_epochs("delta", [1]).select("token").distinct().count() <= 2


def test_a_version_that_died_is_completed(spark, base, monkeypatch):
    """The vocabulary was appended, the sizes were not: the version does not count, and its
    rerun adds nothing twice."""
    a, b, _ = thirds(base)
    state = CorpusState(spark, scratch_path(spark, "state"))
    state.apply(0, added=a)
    real = state.deltas["sizes"].append
    monkeypatch.setattr(state.deltas["sizes"], "append", lambda *x: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        state.apply(1, added=b)
    assert state.versions() == [0] and rows(state.idf()) == rows(rebuild(a))
    monkeypatch.setattr(state.deltas["sizes"], "append", real)
    assert state.apply(1, added=b) and rows(state.idf()) == rows(rebuild(a.unionByName(b)))


def test_histogram_and_snapshot_chain(spark, base):
    """Thresholds from the merged histogram equal those of a rebuild, and a chain may run on a
    snapshot: its IDF table and its thresholds."""
    a, b, _ = thirds(base)
    policy = policy_df(spark)
    plan = attempt_plan(policy)
    state = CorpusState(spark, scratch_path(spark, "state"))
    state.apply(0, added=base)
    pin = state.idf(0)

    def scored(docs):
        return simplify_chain(docs, policy, idf=pin).scored
    state.apply(1, added_scores=scored(a.unionByName(b)), added=a.limit(0))
    state.apply(2, removed_scores=scored(b), removed=b)
    assert rows(state._merged("hist", None)) == rows(histogram(scored(a)))
    assert rows(state.thresholds(plan)) == rows(thresholds(scored(a), plan))
    whole = simplify_chain(a, policy, idf=pin)
    snapshot = simplify_chain(a, policy, idf=pin, score_thresholds=state.thresholds(plan))
    cols = ["pid", "level", "attempt", "simplified", "passed"]
    assert rows(snapshot.chosen.select(cols)) == rows(whole.chosen.select(cols))
