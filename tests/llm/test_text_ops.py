"""Mixing, token files, decontamination, chat formatting, quality, top-k."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from minimus.llm import chat, decontaminate, mix, quality, queries, token_files, topk
from minimus.session import scratch_path

TOKENIZER = queries.tokenizer_path()


def as_view(con, name, df):
    con.register(f"{name}_rows", df.toArrow())
    con.sql(f"CREATE VIEW {name} AS SELECT * FROM {name}_rows")


# ---- mixing

def test_mix_targets_and_repeats(make_docs):
    rows = [(i, "w " * (1 + 7 * i % 40), ["a", "b", "c", "d", None][i % 5 if i % 3 else 0]) for i in range(300)]
    docs = make_docs(rows)
    got = mix.mix_report(docs).collect()
    assert len(got) == len(rows)
    assert sorted(got) == sorted(mix.mix_report(docs.repartition(3)).collect())  # reruns agree
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.target, r.source_size), []).append(r.taken)
    assert abs(sum(t for t, _ in by) - 1.5 * total) < 1e-6
    for (target, size), taken in by.items():
        assert target <= 2 * size and abs(sum(taken) - target) <= 1


def test_mix_matches_sql(make_docs):
    docs = make_docs([(i, "w " * (i * i % 23), f"s{i % 7}") for i in range(120)] + [(500, None, "s1"), (501, "a", None)])
    con = duckdb.connect()
    as_view(con, "documents", docs.select("doc_id", "text", "source"))
    want = con.sql(mix.REPORT_SQL).fetchall()
    assert sorted(map(tuple, mix.mix_report(docs).collect())) == sorted(want)


def test_mix_odd_rows(make_docs):
    assert mix.mix_report(make_docs([])).collect() == []
    got = mix.mix_report(make_docs([(None, None, None), (1, "", "a"), (1, "", "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 3


def test_mixed_documents_are_whole(make_docs):
    docs = make_docs([(i, "w " * (10 + i % 5), "a" if i % 3 else "b") for i in range(60)])
    out = mix.mixed_documents(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    count = {}
    for r in out.collect():
        assert r.text == texts[r.doc_id]
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert max(count.values()) <= 2
    words = sum(len(texts[d].split()) * n for d, n in count.items())
    assert abs(words - 1.5 * sum(len(t.split()) for t in texts.values())) <= 2 * 14


# ---- token files

def test_token_files_round_trip(spark, make_docs, corpus):
    from tokenizers import Tokenizer
    rows = corpus + [(9001, "<|endoftext|> It's É.É ΟΔΟΣ. ﬁne ½ naïve?!, ªº\x85b"), (9002, "a" * 30000)]
    path = scratch_path(spark, "test-tokens")
    token_files.write_token_files(make_docs(rows), path, TOKENIZER)
    got = token_files.read_token_files(spark, path).collect()
    t = Tokenizer.from_file(TOKENIZER)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for doc_id, text in ordered:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), np.array(ids, "<u2").tobytes()))
        start += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in got) == [(w[1], w[0], w[2], w[3]) for w in want]
    few = token_files.read_token_files(spark, path, [9001, 9002, 77777]).collect()
    assert sorted(r.doc_id for r in few) == [9001, 9002]
    crc = {r.doc_id: r.ids_crc32 for r in token_files.checksums(token_files.read_token_files(spark, path, [9001])).collect()}
    ids = t.encode(rows[-2][1], add_special_tokens=False).ids + [2]
    assert crc == {9001: zlib.crc32(np.array(ids, "<u4").tobytes())}


def test_token_files_of_nothing(make_docs):
    assert token_files.token_output(make_docs([]), TOKENIZER).collect() == []
    got = token_files.token_output(make_docs([(5, None), (4, "")]), TOKENIZER).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in got) == [(4, 0, 1), (5, 1, 1)]


def test_token_files_are_read_by_one_worker(spark, make_docs, some):
    """The checksums are taken where the files are read: one Python step in a task, not two beside each other."""
    got = token_files.token_output(make_docs(some), TOKENIZER)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(make_docs(some), path, TOKENIZER)
    want = token_files.checksums(token_files.read_token_files(spark, path))
    assert sorted(got.collect()) == sorted(want.collect()) and got.columns == want.columns



def test_encoder_keeps_to_the_library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(TOKENIZER)
    rng = np.random.default_rng(4)
    alphabet = list("aBéÉßñ.,!?'s|<> \n\t0½ΣςİKǅ́ \x1f-")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(500)] + ["<|endoftext|>x <|startoftext|>."]
    enc = token_files.Encoder(TOKENIZER)
    for x, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, "<u2").tolist() == t.encode(x, add_special_tokens=False).ids + [2], repr(x)


def test_encoder_beyond_its_cache(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 3)
    one, many = token_files.Encoder(TOKENIZER), ["a b c", "d e f g", "a d zz, b!"]
    assert [one.encode([x])[0] for x in many] == token_files.Encoder(TOKENIZER).encode(many)


# ---- decontamination

def test_decontamination_matches_sql(spark, make_docs):
    rng = np.random.default_rng(6)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab, n))) for i, n in enumerate([40, 15, 59, 5, 4, 1, 12])]
    items += [(20, None), (21, " . "), (None, "lost item text of some words"), (0, "second row of the first item here")]
    rows = []
    for k in range(60):
        w = list(rng.choice(vocab, 80))
        x = items[k % 7][1].split()
        if k % 2:
            for _ in range(k % 5):
                x[rng.integers(len(x))] = "changed"
        rows.append((k, " ".join(w[:30]) + ". " + " ".join(x).title() + "! " + " ".join(w[30:])))
    rows += [(100, None), (101, ""), (None, items[0][1]), (3, "the same id again")]
    docs = make_docs(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    as_view(con, "documents", docs.select("doc_id", "text"))
    as_view(con, "benchmark", bench)
    want = sorted(con.sql(decontaminate.FIND_SQL).fetchall())
    assert len(want) > 20
    assert sorted(map(tuple, decontaminate.find_contamination(docs, bench).collect())) == want
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    short = {4, 5, 21}  # items under five words remove nothing
    bad = {d for d, i, *_ in want if i not in short}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in rows if d not in bad)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, none).collect() == []
    assert decontaminate.find_contamination(make_docs([]), bench).collect() == []


def test_short_items_and_repeated_ids(spark, make_docs):
    """A one-word item is found but removes nothing; each text of an item_id counts by itself."""
    whole = " ".join(f"held{i}" for i in range(20))
    other = " ".join(f"else{i}" for i in range(30))
    bench = spark.createDataFrame([(1, "yes"), (2, whole), (2, other), (2, whole)], "item_id long, text string")
    docs = make_docs([(1, "oh yes indeed"), (2, "so " + whole + " end"), (3, "no"), (4, whole[:60])])
    got = sorted(map(tuple, decontaminate.find_contamination(docs, bench).collect()))
    assert got == [(1, 1, 1, 1), (2, 2, 16, 16)]
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, bench, 1).collect()) == [3, 4]


# ---- chat formatting

TURNS = [(1, 0, "user", "hi"), (1, 1, "user", "there <|im_sep|> \\l \\e"), (1, 2, "assistant", "a<b\\n"),
         (1, 3, "assistant", ""), (1, 4, "system", None), (1, 5, "assistant", "<|im_end|>\n<|im_start|>user\nno"),
         (2, 0, None, "x"), (2, 0, None, "x"), (2, None, "odd\n<role", "y"), (None, 0, "assistant", "z" * 10000),
         (3, 1, "assistant", "é😀"), (3, 0, "user", "\n\n")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, 7) for t in TURNS], "conv_id long, turn long, role string, text string, turns long")
    out = {r.conv_id: r for r in chat.chat_report(df).collect()}
    text = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    for conv in {t[0] for t in TURNS}:
        mine = sorted((t for t in TURNS if t[0] == conv),
                      key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        lines = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine)
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        r = out[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(lines.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        f = text[conv].formatted
        assert r.formatted_chars == len(f)
        spans = [f[s.start:s.start + s.length].replace("\\l", "<").replace("\\e", "\\") for s in text[conv].loss_spans]
        assert spans == [t[3] or "" for t in mine if t[2] == "assistant"]
    assert text[1].formatted.count("<|im_start|>") == 4  # adjacent turns of a role are one block
    assert chat.chat_report(df.where("false")).collect() == []


# ---- quality

def test_quality_of_held_out_rows(spark, sf):
    con = duckdb.connect()
    rows = queries.op8_quality(spark, sf).collect()
    labels = dict(con.sql(f"SELECT doc_id, quality FROM read_parquet('{sf}/labels.parquet')").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) >= 10 and all(0 <= s <= 1 and p == (s >= 0.3) for s, p, _ in held)
    assert sum(p == y for _, p, y in held) / len(held) >= 0.9


def test_quality_odd_rows(spark, make_docs):
    docs = make_docs([(None, None), (1, ""), (2, "a b c"), (2, "a b c"), (3, "x" * 200000)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert len(quality.quality_report(docs, none).collect()) == 5
    some = spark.createDataFrame([(1, 1), (2, None), (None, 1), (2, 0)], "doc_id long, quality int")
    model, prior = quality.fit(docs, some)
    assert 0 < prior < 1
    out = quality.score(docs, model)
    assert out.columns == docs.columns + ["__score"] and all(0 <= r["__score"] <= 1 for r in out.collect())
    assert quality.quality_report(make_docs([]), some).collect() == []


def test_non_negative_risk_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(3)
    pos = rng.normal(1.5, 1, (1500, 3))
    unl = np.concatenate([rng.normal(1.5, 1, (1050, 3)), rng.normal(-1.5, 1, (450, 3))])
    w, b, mean, scale = quality.non_negative_pu(pos, unl, 0.7)
    z = (unl - mean) / scale @ w + b
    assert ((z > 0) == (np.arange(1500) < 1050)).mean() > 0.93


# ---- top-k

def brute_top_k(rows, queries_, k):
    out = []
    for q, v in queries_:
        s = []
        for c, u in rows:
            if c != q and len(u) == len(v):
                s.append((-sum(int(np.floor(256 * float(x))) * int(np.floor(256 * float(y))) for x, y in zip(v, u)), c))
        out += [(q, i + 1, c, -m) for i, (m, c) in enumerate(sorted(s)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4, 128])
def test_top_k_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "SHARD_BYTES", 4096)
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, 0.3, 6 if i % 9 else 4))]) for i in rng.permutation(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    fine = [r for r in rows]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2050, [float("inf")] * 6),
             (None, [0.5] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, dim int")
    got = topk.top_k(df.where("vec_id % 50 = 0"), df, 5)
    assert sorted(map(tuple, got.collect())) == brute_top_k(fine, [r for r in fine if r[0] % 50 == 0], 5)


def test_top_k_of_few_and_of_huge_values(spark):
    df = spark.createDataFrame([(0, [1e18, 2.0]), (1, [1e18, -1.0]), (50, [3.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df.where("vec_id % 50 = 0"), df, 5).collect()))
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 50), (50, 1, 0), (50, 2, 1)]
    assert got[0][3] == (1 << 63) - 1  # clipped
    assert topk.top_k(df.where("false"), df, 5).collect() == []
    assert topk.top_k(df, df.where("vec_id = 0"), 5).where("query_id = 0").collect() == []


def test_top_k_hands_on_one_best_a_lane_not_a_shard(spark, monkeypatch):
    """What a task hands on grows with the queries and lanes, not with the shards that it reads."""
    for name, value in (("BLOCK_ROWS", 4), ("VISIT_BLOCKS", 2), ("VISIT_QUERIES", 3), ("SHARD_BYTES", 8), ("LANES_A_CORE", 0)):
        monkeypatch.setattr(topk, name, value, raising=False)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda self: 1))
    given = topk.map_batches
    made = []
    monkeypatch.setattr(topk, "map_batches", lambda df, fn, schema: made.append(given(df, fn, schema)) or made[-1])
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, 0.3, 6))]) for i in range(500)]
    rows += [(100, rows[100][1])] * 3 + [(700 + i, rows[50][1]) for i in range(20)]  # own rows again, ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df.where("vec_id % 50 = 0"), df, 5)
    queries_ = {q: v for q, v in rows if q % 50 == 0}
    assert sorted(map(tuple, got.collect())) == brute_top_k(rows, sorted(queries_.items()), 5)
    shards = made[0].count()
    assert shards > 100 and made[-1].count() <= 5 * len(queries_)


def test_top_k_of_vectors_without_components(spark):
    df = spark.createDataFrame([(0, []), (1, []), (50, [3.0]), (51, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df.where("vec_id % 50 = 0"), df, 5).collect())) == [(50, 1, 51, 393216)]


# ---- the whole registry and the pipeline

@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    df = queries.QUERIES[name](spark, sf)
    order = sorted(df.columns)
    want = con.sql(queries.ORACLE[name]).df()[order].astype(object).map(repr).values.tolist()
    got = df.select(order).toPandas().astype(object).map(repr).values.tolist()
    assert sorted(got) == sorted(want)


def test_words_that_never_recur_are_not_kept():
    import pyarrow as pa

    from minimus.llm import token_files
    from minimus.llm.queries import tokenizer_path
    enc = token_files.Encoder(tokenizer_path())
    for i in range(3):
        ids, at = enc.ids(pa.array(["one Common word, q%dx z%dy" % (i, i)] * 2))
        assert [len(ids)] == list(at[-1:]) and list(ids[:at[1]]) == list(ids[at[1]:])
    assert {"one", "Common", "word,"} <= set(enc.cache)
    assert not [w for w in enc.cache if w[:1] in "qz"]


def test_lines_are_cut_once(spark, monkeypatch):
    from minimus.llm import line_dedup
    staged = {}
    keep = line_dedup.stage
    monkeypatch.setattr(line_dedup, "stage", lambda df, name: staged.setdefault(name, keep(df, name)))
    docs = spark.createDataFrame([(1, "a line of some length\nshort"), (2, "a line of some lengths\nshort")],
                                 "doc_id long, text string")
    assert sorted(r.n_removed for r in line_dedup.dedup_lines(docs).collect()) == [0, 2]
    cuts = staged["line-cuts"].select("doc_id", "b", "lo", "hi").distinct().collect()
    assert sorted(cuts) == sorted((d, b, lo, hi) for d, n in ((1, 21), (2, 22)) for b in (n, n - 1)
                                  for lo, hi in ((0, b // 2), (b // 2, b)))
