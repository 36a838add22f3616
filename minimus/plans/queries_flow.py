"""Registered end-to-end jobs: O21 typos, O49 minimise, O05 payload, O51 level
sweep, O28 report and O22 NoisyKNN over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.noise import sql_laplace
from ..functions.secret_noise import sql_draw, sql_value
from ..functions.pii import mask_pii, sql_class_counts, sql_mask_pii
from ..functions.text import clean_text, sql_clean_text, sql_word_count, word_count
from ..operators import messages as M
from ..operators.asof import pair_turns
from ..operators.budget import (EPS, SQL_ATTEMPT_TOTAL, attempt_total, compose, ledger, rho, sql_rho, sql_zcdp_eps,
                                steps_of)
from ..operators.knn import centroids, noisy_knn
from ..operators.language import fit_language, sql_identify, with_language
from ..operators.knn_pruned import pruned_knn
from ..operators.policy import DEFAULT_SEED, policy_df
from ..operators.review import retry_history
from ..operators.typos import correct_typos, typo_corrections, typo_vocab
from ..sources.messages import chat_log
from ..session import cut_lineage
from ..sources.tables import read_table
from .catalog import register
from .chain_sql import DOC_BASE, sql_fixed, typo_ctes, with_chain
from .queries_messages import LOG_SQL
from .queries_select import TEST_SALT, salted_noise
from .queries_text import document_base, document_chain
from .simplify import minimize, pii_total, simplify_chain

LEVEL_NAMES = ["low", "medium", "high"]
KNN_K = 5
KNN_SCALE = 0.05


# ---- O21 ----------------------------------------------------------------------

def typo_table(base: DataFrame) -> DataFrame:
    """O21 corrections over a prompt table; the vocabulary is checkpointed once
    because both sides of the deletion-key join read it."""
    return typo_corrections(cut_lineage(typo_vocab(base)))


_TYPO_SQL = f"WITH base AS ({DOC_BASE}),{typo_ctes().rstrip(',')}\n"


@register("typo_corrections", _TYPO_SQL + "SELECT lang, token, fix, fix_df FROM corr")
def q_typo_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Rare tokens with their frequent same-language neighbour at distance 1."""
    return typo_table(document_base(spark, sf)).select("lang", "token", "fix", "fix_df")


@register("preprocess_text", _TYPO_SQL + f"""
SELECT h.pid, {sql_fixed('h.m')} AS text
FROM (SELECT pid, lang, {sql_mask_pii('text', 'level')} AS m FROM base) h
LEFT JOIN fixes f ON h.pid = f.pid AND h.lang = f.lang""")
def q_preprocess_text(spark: SparkSession, sf: str) -> DataFrame:
    """The preprocess stage -- clean-up, masking, then typo fixes."""
    base = document_base(spark, sf)
    masked = base.withColumn("text", mask_pii("text", "level"))
    return correct_typos(masked, typo_table(base)).select("pid", "text")


# ---- O49 / O05: minimise the prompts of the chat log ---------------------------

def chat_prompts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(prompt table, log). Prompts are the user turns: pid 'conv:turn', cleaned text, the
    level the user picked, and the language that a model of ``documents`` identifies."""
    log = chat_log(spark, sf)
    users = M.by_role(log, "user")
    base = users.select(F.concat_ws(":", F.col("conv_id").cast("string"),
                                    F.col("turn").cast("string")).alias("pid"),
                        clean_text("content").alias("text"), F.col("simplify").alias("level"))
    return with_language(base, document_language_model(spark, sf)).select("pid", "lang", "text", "level"), log


def document_language_model(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents", ["text", "lang"], heavy=True)
    return fit_language(docs.select("lang", clean_text("text").alias("text")))


def minimize_log(spark: SparkSession, sf: str):
    """Preprocess (O41, O42, O21) -> simplify (O46) -> review / retry
    -> result per prompt with the assistant answer from the log (O19)."""
    base, log = chat_prompts(spark, sf)
    ch = simplify_chain(base, policy_df(spark), seed=DEFAULT_SEED, typos=True)
    pairs = pair_turns(log).select("conv_id", F.col("prompt_turn").alias("turn"),
                                   F.col("reply").alias("answer"))
    parts = F.split("pid", ":")
    res = (ch.chosen.select(parts[0].cast("bigint").alias("conv_id"),
                            parts[1].cast("bigint").alias("turn"),
                            "pid", "level", "attempt", "status", "simplified", "similarity",
                            "missing", "passed", "eps_threshold", "eps_hits", "eps_top_k", "eps_knn",
                            "spent_eps", "spent_rho_q", "spent_exact")
           .join(pairs, ["conv_id", "turn"], "left"))
    return res, ch


_CHAT_PROMPTS = f"""SELECT conv_id || ':' || turn AS pid, {sql_clean_text('content')} AS text,
  simplify AS level FROM ({LOG_SQL}) WHERE role = 'user'"""
_CHAT_LANGUAGE = sql_identify(_CHAT_PROMPTS, f"SELECT lang, {sql_clean_text('text')} AS text FROM documents")
CHAT_BASE = f"""SELECT p.pid, coalesce(l.lang, 'und') AS lang, p.text, p.level
FROM ({_CHAT_PROMPTS}) p LEFT JOIN ({_CHAT_LANGUAGE}) l ON l.pid = p.pid"""


@register("prompt_language", f"SELECT pid, lang FROM ({CHAT_BASE})")
def q_prompt_language(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every prompt of the chat log (for O44, O21 and O23)."""
    return chat_prompts(spark, sf)[0].select("pid", "lang")


@register("minimize_prompts", with_chain(f"""
, pairs AS (SELECT conv_id, turn, lead(content) OVER w AS answer, role,
                   lead(role) OVER w AS next_role
            FROM ({LOG_SQL}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT CAST(split_part(c.pid, ':', 1) AS BIGINT) AS conv_id,
       CAST(split_part(c.pid, ':', 2) AS BIGINT) AS turn,
       c.level, c.attempt, c.status, c.simplified, round(c.similarity, 6) AS similarity,
       p.answer
FROM chosen c LEFT JOIN pairs p
  ON p.conv_id = CAST(split_part(c.pid, ':', 1) AS BIGINT)
 AND p.turn = CAST(split_part(c.pid, ':', 2) AS BIGINT)
 AND p.role = 'user' AND p.next_role = 'assistant'""", base_sql=CHAT_BASE, typos=True))
def q_minimize_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """O49 over the chat log's user prompts."""
    res, _ = minimize_log(spark, sf)
    return res.select("conv_id", "turn", "level", "attempt", "status", "simplified",
                      F.round("similarity", 6).alias("similarity"), "answer")


@register("minimize_documents", with_chain(
    "SELECT pid, level, status, simplified, attempt, round(similarity, 6) AS similarity, "
    "array_to_string(missing, ',') AS missing, eps_threshold, eps_hits, eps_top_k, eps_knn, "
    f"spent_eps AS eps_total, {sql_zcdp_eps('spent_rho_q')} AS eps_zcdp, spent_exact AS exact_steps FROM chosen", typos=True))
def q_minimize_documents(spark: SparkSession, sf: str) -> DataFrame:
    """O49 over ``documents``, which hold PII and secrets, each at its own level."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text", "lang"], heavy=True)
    out = minimize(docs.select(F.col("doc_id").alias("pid"), "text", "lang", F.element_at(
        F.array(*[F.lit(x) for x in LEVEL_NAMES]), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")).alias("level")))
    return (out.withColumn("similarity", F.round("similarity", 6))
            .withColumn("missing", F.array_join("missing", ",")))


def finalize(res: DataFrame, history: DataFrame) -> DataFrame:
    """One JSON payload per prompt -- simplified question, answer, the review
    metadata (status, similarity, missing items, retry history) and the budget: of each step of
    the chosen attempt, of each attempt (in the retry history), and of all together. Numbers are decimals, so their text does not depend on the engine."""
    j = res.join(history, ["pid", "level"], "left")
    payload = F.to_json(F.struct(
        F.col("status"),
        F.col("simplified").alias("simplifiedMessage"),
        F.col("answer"),
        F.struct(F.round("similarity", 6).cast("decimal(8,6)").alias("similarity"),
                 F.col("missing").alias("missingItems"),
                 F.col("retry_history").alias("retryHistory")).alias("review"),
        F.struct(F.col("eps_threshold").alias("threshold"), F.col("eps_hits").alias("hits"),
                 F.col("eps_top_k").alias("topK"), F.col("eps_knn").alias("knn"),
                 F.col("attempt").alias("attempts"), F.col("spent_eps").alias("total"),
                 rho("spent_rho_q").alias("rho"), F.col("spent_exact").alias("exactSteps")).alias("epsilon")),
        {"ignoreNullFields": "false"})
    return j.select("conv_id", "turn", "level", payload.alias("payload"))


_PAIRS_SQL = f"""
, pairs AS (SELECT conv_id, turn, lead(content) OVER w AS answer, role,
                   lead(role) OVER w AS next_role
            FROM ({LOG_SQL}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@register("finalize_payload", with_chain(_PAIRS_SQL + f"""
, tries AS (SELECT pid, level, string_agg('{{"attempt":' || attempt || ',"similarity":'
               || CAST(round(similarity, 6) AS DECIMAL(8,6)) || ',"missing_items":' || to_json(missing)::VARCHAR
               || ',"passed":' || CAST(passed AS VARCHAR)
               || ',"epsilon":' || CAST({SQL_ATTEMPT_TOTAL} AS {EPS}) || '}}', ',' ORDER BY attempt) AS h
            FROM reviewed GROUP BY pid, level)
SELECT CAST(split_part(c.pid, ':', 1) AS BIGINT) AS conv_id,
       CAST(split_part(c.pid, ':', 2) AS BIGINT) AS turn, c.level,
       '{{"status":' || to_json(c.status)::VARCHAR || ',"simplifiedMessage":' || to_json(c.simplified)::VARCHAR
       || ',"answer":' || coalesce(to_json(p.answer)::VARCHAR, 'null')
       || ',"review":{{"similarity":' || CAST(round(c.similarity, 6) AS DECIMAL(8,6))
       || ',"missingItems":' || to_json(c.missing)::VARCHAR || ',"retryHistory":[' || h.h
       || ']}},"epsilon":{{"threshold":' || c.eps_threshold || ',"hits":' || c.eps_hits
       || ',"topK":' || coalesce(CAST(c.eps_top_k AS VARCHAR), 'null') || ',"knn":' || c.eps_knn
       || ',"attempts":' || c.attempt || ',"total":' || c.spent_eps || ',"rho":' || {sql_rho('c.spent_rho_q')}
       || ',"exactSteps":' || c.spent_exact || '}}}}' AS payload
FROM chosen c JOIN tries h ON h.pid = c.pid AND h.level = c.level
LEFT JOIN pairs p
  ON p.conv_id = CAST(split_part(c.pid, ':', 1) AS BIGINT)
 AND p.turn = CAST(split_part(c.pid, ':', 2) AS BIGINT)
 AND p.role = 'user' AND p.next_role = 'assistant'""", base_sql=CHAT_BASE, typos=True))
def q_finalize_payload(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON payloads of the chat log's prompts."""
    res, ch = minimize_log(spark, sf)
    return finalize(res, retry_history(ch.reviewed, extra=(attempt_total().alias("epsilon"),)))


# ---- budget: composition over steps and attempts, ledger over a conversation ----

@register("prompt_budget", with_chain("""
SELECT pid, level, 4 * count(*) AS n_steps, any_value(spent_eps) AS eps_total, any_value(spent_exact) AS exact_steps
FROM reviewed JOIN spent USING (pid, level) GROUP BY pid, level"""))
def q_prompt_budget(spark: SparkSession, sf: str) -> DataFrame:
    """O48 with the accountant: basic composition over the steps of all attempts of a prompt,
    from the long table of steps."""
    return compose(steps_of(document_chain(spark, sf).reviewed), "pid", "level")


@register("privacy_ledger", with_chain(f"""
SELECT CAST(split_part(pid, ':', 1) AS BIGINT) AS conv_id, count(*) AS n_prompts,
       CAST(sum(attempt) AS BIGINT) AS n_attempts, CAST(sum(spent_eps) AS {EPS}) AS eps_total,
       {sql_rho('sum(spent_rho_q)')} AS rho_total, {sql_zcdp_eps('sum(spent_rho_q)')} AS eps_zcdp,
       CAST(sum(spent_exact) AS BIGINT) AS exact_steps
FROM chosen GROUP BY 1""", base_sql=CHAT_BASE, typos=True))
def q_privacy_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """What the prompts of each conversation of the chat log have spent together."""
    res, _ = minimize_log(spark, sf)
    return ledger(res, "conv_id")


# ---- O51 / O28: level sweep and report -----------------------------------------

def sweep(spark: SparkSession, sf: str):
    base = document_base(spark, sf).drop("level")
    return simplify_chain(base, policy_df(spark), levels=LEVEL_NAMES, seed=DEFAULT_SEED, typos=True,
                          measure=True)


@register("level_sweep", with_chain(
    "SELECT pid, level, attempt, status, simplified, round(similarity, 6) AS similarity "
    "FROM chosen", sweep=True, typos=True))
def q_level_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Every document minimised at low, medium and high side by side."""
    return sweep(spark, sf).chosen.select("pid", "level", "attempt", "status", "simplified",
                                          F.round("similarity", 6).alias("similarity"))


def minimization_report(chosen: DataFrame) -> DataFrame:
    """Characters, words and PII matches before / after, approval rate,
    by level x language with subtotals (rollup). ``chosen`` comes from a chain that
    measures its unmasked input, so the raw text is not read again. Prompts compose in
    parallel, so eps_total is the largest of a group."""
    m = chosen.select("level", "lang", "cb", "wb", "pb", "spent_eps", "spent_exact",
                      F.length("simplified").alias("ca"), word_count("simplified").alias("wa"),
                      pii_total("simplified").alias("pa"), F.col("passed").cast("double").alias("ok"))
    return m.rollup("level", "lang").agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("n_prompts"),
        F.sum("cb").alias("chars_before"), F.sum("ca").alias("chars_after"),
        F.sum("wb").alias("words_before"), F.sum("wa").alias("words_after"),
        F.sum("pb").alias("pii_before"), F.sum("pa").alias("pii_after"),
        F.round(F.avg("ok"), 6).alias("approval_rate"),
        F.max("spent_eps").alias("eps_total"), F.max("spent_exact").alias("exact_steps"))


def _sql_pii_total(e: str) -> str:
    return " + ".join(f"({x})" for _, x in sql_class_counts(e))


@register("minimization_report", with_chain(f"""
, m AS (SELECT c.level, c.lang, length(b.text) AS cb, length(c.simplified) AS ca,
               {sql_word_count('b.text')} AS wb, {sql_word_count('c.simplified')} AS wa,
               {_sql_pii_total('b.text')} AS pb, {_sql_pii_total('c.simplified')} AS pa,
               CAST(c.passed AS DOUBLE) AS ok, c.spent_eps, c.spent_exact
        FROM chosen c JOIN base b ON c.pid = b.pid)
SELECT level, lang, CAST(GROUPING(level, lang) AS BIGINT) AS gid, count(*) AS n_prompts,
       CAST(sum(cb) AS BIGINT) AS chars_before, CAST(sum(ca) AS BIGINT) AS chars_after,
       CAST(sum(wb) AS BIGINT) AS words_before, CAST(sum(wa) AS BIGINT) AS words_after,
       CAST(sum(pb) AS BIGINT) AS pii_before, CAST(sum(pa) AS BIGINT) AS pii_after,
       round(avg(ok), 6) AS approval_rate, max(spent_eps) AS eps_total, max(spent_exact) AS exact_steps
FROM m GROUP BY ROLLUP (level, lang)""", sweep=True, typos=True))
def q_minimization_report(spark: SparkSession, sf: str) -> DataFrame:
    """O28 over the level sweep of ``documents``."""
    return minimization_report(sweep(spark, sf).chosen)


# ---- O22: NoisyKNN over embeddings ----------------------------------------------

def knn_job(spark: SparkSession, sf: str, noise_on: str) -> DataFrame:
    emb = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    qs = centroids(emb).select(F.col("label").alias("qid"), F.col("centroid").alias("qvec"))
    if noise_on == "private":
        noise = salted_noise(spark, {"scale": [repr(KNN_SCALE)]})
        out = noisy_knn(qs, emb, KNN_K, KNN_SCALE, DEFAULT_SEED, noise=noise)
        return out.select("qid", F.col("rank").cast("bigint").alias("rank"), "vec_id", "distance")
    out = noisy_knn(qs, emb, KNN_K, KNN_SCALE, DEFAULT_SEED, noise_on=noise_on)
    return out.select("qid", F.col("rank").cast("bigint").alias("rank"), "vec_id",
                      F.round("distance", 6).alias("distance"))


def _sql_knn(noise_on: str) -> str:
    s = DEFAULT_SEED
    value, out = str, "round(distance, 6)"
    if noise_on == "private":
        q, value, out = "q0", sql_value, "distance"
        noise = sql_draw(TEST_SALT, [repr(KNN_SCALE)], "scale", "knn", "qid", "vec_id")
    elif noise_on == "vector":
        q = (f"list_transform(q0, lambda x, i: x + "
             f"{sql_laplace(repr(KNN_SCALE), s, chr(39) + 'vec' + chr(39), 'qid', 'i - 1')})")
        noise = "0.0"
    else:
        q = "q0"
        noise = sql_laplace(repr(KNN_SCALE), s, "'knn'", "qid", "vec_id")
    return f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
co AS (SELECT label, dim, avg(x) AS m
       FROM (SELECT label, unnest(range(len(v))) AS dim, unnest(v) AS x FROM e)
       GROUP BY label, dim),
cent AS (SELECT label AS qid, list(m ORDER BY dim) AS q0 FROM co GROUP BY label),
qv AS (SELECT qid, {q} AS q FROM cent),
d AS (SELECT qid, vec_id, {value('1.0 - list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v)))')}
             + {noise} AS distance
      FROM (SELECT *, CAST({KNN_SCALE!r} AS DOUBLE) AS scale FROM qv, e))
SELECT qid, rank, vec_id, {out} AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank FROM d)
WHERE rank <= {KNN_K}"""


@register("noisy_knn", _sql_knn("distance"))
def q_noisy_knn(spark: SparkSession, sf: str) -> DataFrame:
    """K nearest embeddings to each label centroid, Laplace noise on distances."""
    return knn_job(spark, sf, "distance")


@register("noisy_knn_private", _sql_knn("private"))
def q_noisy_knn_private(spark: SparkSession, sf: str) -> DataFrame:
    """K nearest embeddings to each label centroid, discrete Laplace draws under a salt."""
    return knn_job(spark, sf, "private")


def pruned_job(spark: SparkSession, sf: str, noise_on: str) -> DataFrame:
    emb = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    qs = centroids(emb).select(F.col("label").alias("qid"), F.col("centroid").alias("qvec"))
    out = pruned_knn(qs, emb, KNN_K, KNN_SCALE, DEFAULT_SEED, noise_on=noise_on)
    return out.select("qid", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"))


@register("knn_pruned", _sql_knn("distance"))
def q_knn_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """O22 by pivots and blocks, noise on distances: the rows of ``noisy_knn``."""
    return pruned_job(spark, sf, "distance")


@register("knn_pruned_vector", _sql_knn("vector"))
def q_knn_pruned_vector(spark: SparkSession, sf: str) -> DataFrame:
    """O22 by pivots and blocks, noise per coordinate: the rows of ``noisy_knn_vector``."""
    return pruned_job(spark, sf, "vector")


@register("noisy_knn_vector", _sql_knn("vector"))
def q_noisy_knn_vector(spark: SparkSession, sf: str) -> DataFrame:
    """K nearest embeddings to each noisy label centroid (noise per coordinate)."""
    return knn_job(spark, sf, "vector")


# ---- O05 flat form: the payload read back, field by field -------------------------

PAYLOAD_SCHEMA = ("status string, simplifiedMessage string, answer string, "
                  "review struct<similarity: double, missingItems: array<string>, "
                  "retryHistory: array<struct<attempt: int, similarity: double, "
                  "missing_items: array<string>, passed: boolean>>>")


@register("payload_fields", with_chain(_PAIRS_SQL + """
, tries AS (SELECT pid, level, count(*) AS n_attempts,
                  string_agg(CAST(passed AS VARCHAR), ',' ORDER BY attempt) AS passed_seq
           FROM reviewed GROUP BY pid, level)
SELECT CAST(split_part(c.pid, ':', 1) AS BIGINT) AS conv_id,
       CAST(split_part(c.pid, ':', 2) AS BIGINT) AS turn,
       c.status, c.simplified, p.answer, round(c.similarity, 6) AS similarity,
       array_to_string(c.missing, ',') AS missing, h.n_attempts, h.passed_seq
FROM chosen c JOIN tries h ON h.pid = c.pid AND h.level = c.level
LEFT JOIN pairs p
  ON p.conv_id = CAST(split_part(c.pid, ':', 1) AS BIGINT)
 AND p.turn = CAST(split_part(c.pid, ':', 2) AS BIGINT)
 AND p.role = 'user' AND p.next_role = 'assistant'""", base_sql=CHAT_BASE, typos=True))
def q_payload_fields(spark: SparkSession, sf: str) -> DataFrame:
    """O05, flat form: each JSON payload parsed back with an explicit schema."""
    pay = q_finalize_payload(spark, sf)
    p = F.from_json("payload", PAYLOAD_SCHEMA)
    hist = p["review"]["retryHistory"]
    return pay.select(
        "conv_id", "turn", p["status"].alias("status"),
        p["simplifiedMessage"].alias("simplified"), p["answer"].alias("answer"),
        p["review"]["similarity"].alias("similarity"),
        F.array_join(p["review"]["missingItems"], ",").alias("missing"),
        F.size(hist).cast("bigint").alias("n_attempts"),
        F.array_join(F.transform(hist, lambda h: h["passed"].cast("string")), ",")
        .alias("passed_seq"))
