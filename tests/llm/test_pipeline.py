"""The pipeline against a plain version of each stage, on what the stage before kept."""

import duckdb
import numpy as np
import zlib

import corpus_pipeline as P
from minimus.llm import decontaminate, quality, queries
from minimus.llm.common import stage, table

from test_jaccard import brute


def test_stages(spark, sf):
    assert [n for n, _ in P.STAGES] == ["quality", "jaccard", "decontaminate", "mix", "tokens"]
    docs = table(spark, sf, "documents")
    steps = dict(P.STAGES)
    step = {}
    for name in ("quality", "jaccard", "decontaminate", "mix"):
        out = stage(steps[name](spark, docs, sf), f"test-{name}")
        assert out.columns == docs.columns
        step[name] = (docs.toPandas(), out.toPandas())
        docs = out

    before, after = step["quality"]
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{sf}/labels.parquet')").fetchall())
    kept = set(after.doc_id)
    known = [d for d in before.doc_id if d in labels]
    assert sum((d in kept) == bool(labels[d]) for d in known) >= 0.95 * len(known)

    before, after = step["jaccard"]
    want = brute(sorted(zip(before.doc_id, before.text)))
    assert sorted(after.doc_id) == sorted(d for d, (_, c) in want.items() if c == d)

    before, after = step["decontaminate"]
    con = duckdb.connect()
    con.register("documents", before)
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{sf}/benchmark.parquet')")
    bad = {r[0] for r in con.sql(decontaminate.FIND_SQL).fetchall()}
    assert sorted(after.doc_id) == sorted(set(before.doc_id) - bad)

    before, after = step["mix"]
    words = before.set_index("doc_id").text.str.split().str.len()
    total = words.sum()
    assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.value_counts().max() <= 2
    longest = words.max()
    assert abs(words[after.doc_id].sum() - 1.5 * total) <= before.source.nunique() * longest / 2

    from tokenizers import Tokenizer
    t = Tokenizer.from_file(queries.tokenizer_path())
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in steps["tokens"](spark, docs, sf).collect())
    start, want = 0, []
    for r in after.sort_values(["doc_id"], kind="stable").itertuples():
        ids = t.encode(r.text, add_special_tokens=False).ids + [2]
        want.append((start, r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert quality.CUT == 0.3


def test_odd_rows(spark, sf, make_docs):
    """Nulls, empty and repeated rows, a clashing column, and no rows at all, through all stages."""
    text = "plain words of a text that stands here for a document and goes on for some time"
    odd = [(1, None), (2, ""), (None, text), (None, None), (3, text), (3, text), (4, text + " more"), (5, " \n"),
           (6, "a"), (7, "x" * 30000), (8, text, None)]
    for rows in (odd, []):
        docs = make_docs(rows)
        columns = docs.columns
        for name, step in P.STAGES[:-1]:
            before = docs
            docs = stage(step(spark, docs, sf), f"test-odd-{name}")
            assert docs.columns == columns
            kept = docs.select("doc_id", "text").distinct()
            assert kept.exceptAll(before.select("doc_id", "text").distinct()).isEmpty()
        out = P.STAGES[-1][1](spark, docs, sf)
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == docs.count()
    # stage by stage on the odd rows themselves
    docs = make_docs(odd)
    one = P.keep_one_of_each(spark, docs, sf)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in one.collect() if r.text and r.text.startswith("plain")) == \
        [(False, 0), (True, 3), (True, 3)]
    assert P.keep_uncontaminated(spark, docs, sf).count() == len(odd)
    mixed = P.mix_sources(spark, docs, sf)
    assert all(r.text and r.text.strip() for r in mixed.collect())
