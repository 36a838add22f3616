"""Golden cases of the privacy rules, and the paths that large inputs take."""

import pytest
from pyspark.sql import functions as F

from minimus.functions.pii import mask_pii
from minimus.operators.knn import noisy_knn
from minimus.operators.policy import policy_df
from minimus.operators.typos import correct_typos, typo_corrections, typo_vocab
from minimus.operators.vocab import ENTRY_BYTES, build_vocab, frequent_from, lookup_bytes
from minimus.plans.queries_text import document_base
from minimus.plans.simplify import Chain, minimize

SECRET = 'token = "0123beade4567890abcd12"'  # one edit from "beads" inside


def masked(spark, text, level):
    df = spark.createDataFrame([(text, level)], "t string, l string")
    return df.select(mask_pii("t", "l").alias("m")).first().m


@pytest.mark.parametrize("level", ["low", "medium", "high"])
def test_secret_next_to_a_frequent_word(spark, level):
    rows = [(str(i), "Some beads are here and more beads there.", "en", level) for i in range(12)]
    rows.append(("x", f"The key is {SECRET} and nothing else is here.", "en", level))
    df = spark.createDataFrame(rows, "pid string, text string, lang string, level string")
    for r in minimize(df).collect():
        assert "4567890abcd12" not in r.simplified and "0123bead" not in r.simplified
    vocab = [r.token for r in typo_vocab(df).collect()] + [r.token for r in build_vocab(df).collect()]
    assert not {"beade", "abcd", "secret"} & set(vocab) and "beads" in vocab
    m = df.withColumn("text", mask_pii("text", "level"))
    fixed = correct_typos(m, typo_corrections(typo_vocab(df)))
    assert "<SECRET>" in fixed.where("pid = 'x'").first().text


def test_whole_card_runs(spark):
    long, inside = "1234567890123456789", "42222222222220001"
    for level in ("medium", "high"):
        assert masked(spark, f"a {long} b", level) == "a <CARD> b"
        assert masked(spark, f"a {inside} b", level) == "a <CARD> b"
        assert masked(spark, "9" * 40, level) == "<CARD>"
    assert masked(spark, "4222222222222 and 42222222222220001", "low") == "<CARD> and 42222222222220001"
    assert masked(spark, "6304000000000000000x6304000000000000001", "low").startswith("<CARD>x630")
    assert masked(spark, "9" * 25, "low") == "9" * 25


def test_unknown_level_masks_like_high(spark):
    for level in (None, "HIGH", ""):
        assert masked(spark, "n 123456 ip 10.0.0.1", level) == masked(spark, "n 123456 ip 10.0.0.1", "high") == "n <NUM> ip <IP>"


def test_no_row_vanishes(spark):
    rows = [("a", "First words here. Second words there.", "en", "low"), ("b", "Null level words.", "en", None),
            ("c", "Unknown level words.", "en", "HIGH"), ("d", "Null language words here.", None, "high"),
            ("e", "", "en", "medium")]
    df = spark.createDataFrame(rows, "pid string, text string, lang string, level string")
    chain = Chain(df, policy_df(spark))
    got = {r.pid: r for r in chain.chosen.collect()}
    assert set(got) == {"a", "b", "d", "e"} and got["b"].level == "medium" and got["d"].lang == "und"
    assert [r.pid for r in chain.quarantined.collect()] == ["c"]
    assert chain.idf.where("lang = 'und'").count() > 0


def test_fillers_leave_the_text(spark):
    df = spark.createDataFrame([("a", "The cat and the dog <EMAIL> of Rome.", "en")], "pid string, text string, lang string")
    out = minimize(df, "low").first()
    assert out.simplified == "cat dog <EMAIL> Rome."


def test_shuffled_lookups_give_the_same(spark, sf):
    base = document_base(spark, sf)
    cols = ["pid", "level", "attempt", "simplified", "similarity"]
    one = Chain(base, policy_df(spark), typos=True)
    two = Chain(base, policy_df(spark), typos=True, broadcast_max_bytes=0)
    assert one.idf_broadcast and not two.idf_broadcast
    assert sorted(one.chosen.select(cols).collect()) == sorted(two.chosen.select(cols).collect())
    fixes = typo_corrections(typo_vocab(base)).cache()
    a = correct_typos(base, fixes)
    b = correct_typos(base, fixes, max_broadcast_bytes=0)
    assert sorted(a.collect()) == sorted(b.collect())


def test_many_queries(spark):
    base = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(30)], "vec_id long, embedding array<double>")
    qs = spark.range(5000).select(F.col("id").alias("qid"), F.array(
        (F.col("id") % 5).cast("double"), F.lit(1.0), F.lit(2.0)).alias("qvec"))
    out = noisy_knn(qs, base, 2, 0.01, 1)
    assert out.count() == 10000


def test_a_large_idf_table_is_broadcast_in_part(spark, sf):
    """Only tokens of few documents are looked up by a shuffle; the rows are the same."""
    base = document_base(spark, sf)
    cols = ["pid", "level", "attempt", "simplified", "similarity", "missing"]
    one = Chain(base, policy_df(spark), attempts=2)
    limit = lookup_bytes(one.idf) // 2
    two = Chain(base, policy_df(spark), attempts=2, broadcast_max_bytes=limit)
    head, rest = two.idf_parts
    assert 0 < lookup_bytes(head) <= limit and head.count() + rest.count() == two.idf.count()
    assert head.agg(F.min("df")).first()[0] > rest.agg(F.max("df")).first()[0]
    assert sorted(one.scored.collect()) == sorted(two.scored.collect())
    assert sorted(one.chosen.select(cols).collect()) == sorted(two.chosen.select(cols).collect())
    assert not {"orig_tokens", "simp_tokens"} & set(two.rounds[0].columns)


def test_vocabulary_of_masked_prompts(spark):
    """The masked prompts give the vocabulary of the clean ones, whatever their levels."""
    texts = ["mail ab.cd@ef.org or +1 (555) 010-2345678901234 now", "card4111111111111111rest 4111111111111112x",
             'my token = "00beade0abcd1234" <NUM> <12NUM> at 10.20.30.40z', "a1234b \u039f\u03a31234 \u039f\u03a3.12345\u0392", None, ""]
    rows = [(f"{i}-{level}", "en", text, level) for level in ("low", "medium", "high", None) for i, text in enumerate(texts)]
    base = spark.createDataFrame(rows, "pid string, lang string, text string, level string")
    chain = Chain(base, policy_df(spark))
    assert sorted(chain.vocab.collect()) == sorted(build_vocab(chain.base).collect())
    assert {"ab", "beade", "num"} & {r.token for r in chain.vocab.collect()} == {"num"}


def test_stages_hold_what_later_steps_read(spark, sf):
    """Tokens of whole prompts are made for reviews alone; a stage has one file a bucket at most."""
    chain = Chain(document_base(spark, sf), policy_df(spark), attempts=1)
    chain.scored.count()
    assert "words" not in vars(chain) and "orig_tokens" not in chain.variants.columns
    chain.chosen.count()
    for stage in (chain.variants, chain.words, chain.uniq):
        files = stage.inputFiles()
        assert len(files) <= chain.buckets and all(f.endswith(".zstd.parquet") for f in files)


def test_frequent_tokens_fill_the_limit(spark):
    idf = spark.createDataFrame([("t%d" % d, d) for d in (1, 2, 3, 4, 7, 8, 9)], "token string, df long")
    each = 2 + ENTRY_BYTES
    assert [frequent_from(idf, n * each) for n in (7, 6, 5, 4, 3, 2, 1, 0)] == [1, 2, 4, 4, 8, 8, 16, 16]
