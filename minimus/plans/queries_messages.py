"""Registered grade-C queries over the chat log derived from ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pii import sql_mask_pii
from ..functions.text import (clean_text, clock, epoch_millis_ntz, js_trim, sql_clean_text,
                              sql_clock, sql_js_trim, sql_lit, sql_word_count, word_count)
from ..operators import messages as M
from ..operators.admission import single_flight
from ..operators.asof import asof_backward, pair_turns
from ..schema import REQUEST, RESPONSE
from ..sources.json_io import decode_request, encode_request
from ..sources.messages import SQL_CHAT_LOG, chat_log, other_turns
from ..sources.tables import read_table
from .catalog import register
from .history import conversation_stats, simplify_history

LOG_SQL = SQL_CHAT_LOG.format(
    clean_prev=sql_mask_pii(sql_clean_text("lag(text) OVER w"), "'high'"))
WITH_LOG = f"WITH log AS ({LOG_SQL})\n"


@register("messages_scan", WITH_LOG + """
SELECT conv_id, turn, role, content, (epoch_us(ts) // 1000) AS ts_ms, simplify, simplified_message
FROM log""")
def q_messages_scan(spark: SparkSession, sf: str) -> DataFrame:
    """O01 + O35: the chat log in conversation order."""
    log = chat_log(spark, sf)
    return M.ordered(log.select("conv_id", "turn", "role", "content",
                                epoch_millis_ntz("ts").alias("ts_ms"),
                                "simplify", "simplified_message"))


@register("other_turns", """
SELECT role, count(*) AS n FROM conversations
WHERE role IS NULL OR role NOT IN ('user', 'assistant') GROUP BY role""")
def q_other_turns(spark: SparkSession, sf: str) -> DataFrame:
    """The turns that the chat log leaves out, counted by role."""
    return other_turns(read_table(spark, sf, "conversations", ["role"]))


@register("trimmed_prompts", WITH_LOG + f"""
SELECT conv_id, turn, 'user' AS role, {sql_js_trim('content')} AS content,
       (epoch_us(ts) // 1000) AS ts_ms, simplify
FROM log WHERE role = 'user' AND {sql_js_trim('content')} <> ''""")
def q_trimmed_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """O06 + O07 + O09: user rows built from the prompts, blank ones dropped."""
    log = chat_log(spark, sf)
    users = M.build_user_rows(M.by_role(log, "user"), text="content")
    return M.non_blank(users, "content").select(
        "conv_id", "turn", "role", "content", epoch_millis_ntz("ts").alias("ts_ms"), "simplify")


# Requested levels as a client would send them: the derived level, sometimes
# left out (NULL) and sometimes upper-cased (outside the enum).
def _requested_level(conv_id: str = "conv_id", turn: str = "turn"):
    k = F.pmod(F.col(conv_id) * 7 + F.col(turn), F.lit(5))
    return (F.when(k == 0, F.lit(None).cast("string"))
             .when(k == 1, F.upper("simplify"))
             .otherwise(F.col("simplify")))


SQL_REQUESTED = ("CASE WHEN (conv_id * 7 + turn) % 5 = 0 THEN NULL "
                 "WHEN (conv_id * 7 + turn) % 5 = 1 THEN upper(simplify) ELSE simplify END")


@register("level_check", WITH_LOG + f"""
SELECT conv_id, turn, coalesce(({SQL_REQUESTED}), 'medium') AS simplify,
       coalesce(({SQL_REQUESTED}), 'medium') IN ('low', 'medium', 'high') AS level_ok
FROM log WHERE role = 'user'""")
def q_level_check(spark: SparkSession, sf: str) -> DataFrame:
    """Default the level, flag values outside the enum (quarantine)."""
    users = M.by_role(chat_log(spark, sf), "user")
    req = users.select("conv_id", "turn", _requested_level().alias("simplify"))
    return M.level_checked(req)


@register("level_quarantine", WITH_LOG + f"""
SELECT conv_id, turn, ({SQL_REQUESTED}) AS simplify
FROM log WHERE role = 'user'
  AND coalesce(({SQL_REQUESTED}), 'medium') NOT IN ('low', 'medium', 'high')""")
def q_level_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """The quarantined rows (level outside the enum)."""
    users = M.by_role(chat_log(spark, sf), "user")
    req = users.select("conv_id", "turn", _requested_level().alias("simplify"))
    _, bad = M.with_level(req)
    return bad


@register("user_messages", WITH_LOG + """
SELECT conv_id, turn, content FROM log WHERE role = 'user'""")
def q_user_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Role branch."""
    return M.by_role(chat_log(spark, sf), "user").select("conv_id", "turn", "content")


@register("history_rows", WITH_LOG + """
SELECT conv_id, turn, simplified_message FROM log
WHERE role = 'assistant' AND simplified_message IS NOT NULL""")
def q_history_rows(spark: SparkSession, sf: str) -> DataFrame:
    """O11."""
    return M.history_rows(chat_log(spark, sf)).select("conv_id", "turn", "simplified_message")


@register("level_labels", WITH_LOG + """
SELECT conv_id, turn, role, simplify,
       CASE WHEN role = 'user' THEN CASE simplify WHEN 'low' THEN 'Low mode'
            WHEN 'medium' THEN 'Medium mode' WHEN 'high' THEN 'High mode' END END AS label
FROM log""")
def q_level_labels(spark: SparkSession, sf: str) -> DataFrame:
    """O15."""
    log = chat_log(spark, sf)
    return log.select("conv_id", "turn", "role", "simplify", M.level_label().alias("label"))


@register("row_keys", WITH_LOG + """
SELECT conv_id, turn,
       CAST((epoch_us(ts) // 1000) AS VARCHAR) || '-' ||
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS VARCHAR) AS row_key
FROM log""")
def q_row_keys(spark: SparkSession, sf: str) -> DataFrame:
    """O16."""
    return M.row_key(chat_log(spark, sf)).select("conv_id", "turn", "row_key")


@register("public_view", WITH_LOG + """
SELECT conv_id, turn, role, simplified_message FROM log""")
def q_public_view(spark: SparkSession, sf: str) -> DataFrame:
    """Only allow-listed columns leave the job (raw content never does)."""
    return M.public_view(chat_log(spark, sf),
                         ["conv_id", "turn", "role", "simplified_message"])


@register("word_counts", WITH_LOG + f"""
SELECT conv_id, turn, {sql_word_count('content')} AS n_words FROM log""")
def q_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Words as the client splits them (one space)."""
    log = chat_log(spark, sf)
    return log.select("conv_id", "turn", word_count("content").cast("bigint").alias("n_words"))


@register("clock_text", WITH_LOG + f"""
SELECT conv_id, turn, {sql_clock('ts')} AS clock FROM log""")
def q_clock_text(spark: SparkSession, sf: str) -> DataFrame:
    """O40."""
    log = chat_log(spark, sf)
    return log.select("conv_id", "turn", clock("ts").alias("clock"))


@register("asof_last_view", """
SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ts_ms,
       (epoch_us(prev_view) // 1000) AS last_view_ts_ms
FROM (SELECT *, last(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER (
        PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_view
      FROM events)
WHERE event_type = 'purchase'""")
def q_asof_last_view(spark: SparkSession, sf: str) -> DataFrame:
    """O18 on real timestamps: the last ``view`` before each ``purchase`` of a user."""
    ev = read_table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type"])
    # two-level scan over minute buckets: a very active user is split by time
    minute = F.timestamp_diff("MINUTE", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                              F.col("ts"))
    t = asof_backward(ev, group="user_id", order=["ts", "event_id"],
                      target=F.col("event_type") == "purchase",
                      anchor=F.col("event_type") == "view",
                      value="ts", out="prev_view", bucket=minute)
    return t.select("event_id", "user_id", epoch_millis_ntz("ts").alias("ts_ms"),
                    epoch_millis_ntz("prev_view").alias("last_view_ts_ms"))


@register("simplify_history", WITH_LOG + f"""
SELECT conv_id, turn, simplified_message,
       (epoch_us(coalesce(prev_user, ts)) // 1000) AS display_ts_ms,
       {sql_clock('coalesce(prev_user, ts)')} AS clock
FROM (SELECT *, last(CASE WHEN role = 'user' THEN ts END IGNORE NULLS) OVER (
        PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_user
      FROM log)
WHERE role = 'assistant' AND simplified_message IS NOT NULL""")
def q_simplify_history(spark: SparkSession, sf: str) -> DataFrame:
    """O50 = O11 + O18 + O40."""
    return simplify_history(chat_log(spark, sf))


@register("turn_pairs", WITH_LOG + """
SELECT conv_id, prompt_turn, prompt, reply_turn, reply FROM (
  SELECT conv_id, turn AS prompt_turn, role, content AS prompt,
         lead(role) OVER w AS next_role, lead(turn) OVER w AS reply_turn,
         lead(content) OVER w AS reply
  FROM log WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND next_role = 'assistant'""")
def q_turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """O19."""
    return pair_turns(chat_log(spark, sf))


@register("conversation_stats", WITH_LOG + """
SELECT conv_id, count(*) AS n_messages,
       count(*) FILTER (WHERE role = 'user') AS n_user,
       count(*) FILTER (WHERE role = 'assistant') AS n_assistant,
       count(*) FILTER (WHERE role = 'assistant' AND simplified_message IS NOT NULL) AS n_history
FROM log GROUP BY conv_id""")
def q_conversation_stats(spark: SparkSession, sf: str) -> DataFrame:
    """O24."""
    return conversation_stats(chat_log(spark, sf))


@register("single_flight", WITH_LOG + """
SELECT conv_id, turn, content FROM (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM log)
WHERE role = 'user' AND (prev IS NULL OR prev = 'assistant')""")
def q_single_flight(spark: SparkSession, sf: str) -> DataFrame:
    """O30 (batch)."""
    return single_flight(chat_log(spark, sf)).select("conv_id", "turn", "content")


# ---- O02 / O03 / O12: request and response envelopes ----------------------------
# Responses are derived from each (prompt, reply) pair; an md5 bucket of the pair
# key picks which envelope shape the "server" sent, so all routing cases occur.

def _case_bucket(conv_id: str = "conv_id", turn: str = "prompt_turn"):
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(
        "|", F.lit("route"), F.col(conv_id).cast("string"), F.col(turn).cast("string"))),
        1, 2), 16, 10).cast("int"), F.lit(16))


SQL_CASE_BUCKET = ("((('0x' || substr(md5(concat_ws('|', 'route', CAST(conv_id AS VARCHAR), "
                   "CAST(prompt_turn AS VARCHAR))), 1, 2))::INTEGER) % 16)")


def _envelope_json(pairs: DataFrame) -> DataFrame:
    k = _case_bucket()
    s = clean_text("prompt")
    null_s = F.lit(None).cast("string")

    def result(status, answer, simplified):
        return F.struct(status.alias("status"), answer.alias("answer"),
                        simplified.alias("simplifiedMessage"))

    def env(success, error=None, data=None):
        return F.to_json(F.struct(
            F.lit(success).alias("success"),
            (error if error is not None else null_s).alias("error"),
            (data if data is not None else F.lit(None).cast(RESPONSE["data"].dataType))
            .alias("data")))

    def data(res):
        return F.struct(res.alias("result"))

    ok = F.lit(M.APPROVED)
    js = (F.when(k == 0, F.lit('{"success":true,"data":{"result":{"status":"approved"'))
           .when(k == 1, env(False, F.lit("upstream timeout")))
           .when(k == 2, env(False))
           .when(k == 3, env(True))
           .when(k == 4, env(True, data=F.struct(F.lit(None).cast(
               RESPONSE["data"].dataType["result"].dataType).alias("result"))))
           .when(k == 5, env(True, data=data(result(F.lit("rejected"), F.col("reply"), s))))
           .when(k == 6, env(True, data=data(result(F.lit("Approved"), F.col("reply"), s))))
           .when(k == 7, env(True, data=data(result(ok, null_s, s))))
           .when(k == 8, env(True, data=data(result(ok, F.col("reply"), null_s))))
           .otherwise(env(True, data=data(result(ok, F.col("reply"), s)))))
    return pairs.select("conv_id", "prompt_turn", "reply_turn", js.alias("response_json"))


def _sql_envelope() -> str:
    s = sql_clean_text("prompt")
    k = SQL_CASE_BUCKET

    def res(status, answer, simp):
        return f"json_object('status', {status}, 'answer', {answer}, 'simplifiedMessage', {simp})"
    return f"""pairs AS (
  SELECT conv_id, prompt_turn, prompt, reply_turn, reply FROM (
    SELECT conv_id, turn AS prompt_turn, role, content AS prompt,
           lead(role) OVER w AS next_role, lead(turn) OVER w AS reply_turn,
           lead(content) OVER w AS reply
    FROM log WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant'),
env AS (
  SELECT conv_id, prompt_turn, reply_turn, CASE {k}
    WHEN 0 THEN '{{"success":true,"data":{{"result":{{"status":"approved"'
    WHEN 1 THEN json_object('success', false, 'error', 'upstream timeout')::VARCHAR
    WHEN 2 THEN json_object('success', false)::VARCHAR
    WHEN 3 THEN json_object('success', true)::VARCHAR
    WHEN 4 THEN json_object('success', true, 'data', json_object('result', NULL))::VARCHAR
    WHEN 5 THEN json_object('success', true, 'data', json_object('result', {res("'rejected'", 'reply', s)}))::VARCHAR
    WHEN 6 THEN json_object('success', true, 'data', json_object('result', {res("'Approved'", 'reply', s)}))::VARCHAR
    WHEN 7 THEN json_object('success', true, 'data', json_object('result', {res("'approved'", 'NULL', s)}))::VARCHAR
    WHEN 8 THEN json_object('success', true, 'data', json_object('result', {res("'approved'", 'reply', 'NULL')}))::VARCHAR
    ELSE json_object('success', true, 'data', json_object('result', {res("'approved'", 'reply', s)}))::VARCHAR
  END AS j FROM pairs),
parsed AS (
  SELECT conv_id, prompt_turn, reply_turn,
         CASE WHEN json_valid(j) THEN coalesce(TRY_CAST(json_extract(j, '$.success') AS BOOLEAN), false) ELSE false END AS ok,
         CASE WHEN json_valid(j) THEN json_extract_string(j, '$.error') END AS err,
         CASE WHEN json_valid(j) THEN coalesce(json_type(j, '$.data'), 'NULL') <> 'NULL' ELSE false END AS has_data,
         CASE WHEN json_valid(j) THEN coalesce(json_type(j, '$.data.result'), 'NULL') <> 'NULL' ELSE false END AS has_result,
         CASE WHEN json_valid(j) THEN json_extract_string(j, '$.data.result.status') END AS status,
         CASE WHEN json_valid(j) THEN json_extract_string(j, '$.data.result.answer') END AS answer,
         CASE WHEN json_valid(j) THEN json_extract_string(j, '$.data.result.simplifiedMessage') END AS simplified_message
  FROM env)
"""


@register("response_unwrap", WITH_LOG.rstrip("\n") + ",\n" + _sql_envelope() + """
SELECT conv_id, prompt_turn, ok,
       CASE WHEN NOT ok THEN coalesce(err, 'Pipeline failed') END AS error,
       has_data, has_result, status, answer, simplified_message
FROM parsed""")
def q_response_unwrap(spark: SparkSession, sf: str) -> DataFrame:
    """O03 on JSON responses (decoded with an explicit schema; malformed ->
    all fields NULL -> failure)."""
    env = _envelope_json(pair_turns(chat_log(spark, sf)))
    parsed = F.from_json("response_json", RESPONSE)
    cols = M.unwrap_response(parsed)
    return env.select("conv_id", "prompt_turn",
                      *[v.alias(k) for k, v in cols.items()])


@register("response_routing", WITH_LOG.rstrip("\n") + ",\n" + _sql_envelope() + f"""
, routed AS (
  SELECT conv_id, reply_turn AS turn, r.sub AS sub, r.content AS content,
         r.simplified_message AS simplified_message
  FROM (SELECT conv_id, reply_turn, unnest(CASE
          WHEN NOT ok OR NOT has_data THEN [{{'sub': 0, 'content': {sql_lit(M.TEXT_FAILED)}, 'simplified_message': NULL::VARCHAR}}]
          WHEN NOT has_result OR coalesce(status = 'approved', false) = false
            THEN [{{'sub': 0, 'content': {sql_lit(M.TEXT_NOT_APPROVED)}, 'simplified_message': NULL::VARCHAR}}]
          WHEN answer IS NULL THEN [{{'sub': 0, 'content': '', 'simplified_message': simplified_message}},
                                    {{'sub': 1, 'content': {sql_lit(M.TEXT_FAILED)}, 'simplified_message': NULL::VARCHAR}}]
          ELSE [{{'sub': 0, 'content': answer, 'simplified_message': simplified_message}}]
        END) AS r FROM parsed))
SELECT conv_id, turn, 0 AS sub, 'user' AS role, content, NULL::VARCHAR AS simplified_message
FROM log WHERE role = 'user'
UNION ALL
SELECT conv_id, turn, sub, 'assistant' AS role, content, simplified_message FROM routed""")
def q_response_routing(spark: SparkSession, sf: str) -> DataFrame:
    """O12 + O13 + O04: replay the log -- user prompts, then the assistant rows
    that routing each response produces, appended to one log."""
    log = chat_log(spark, sf)
    env = _envelope_json(pair_turns(log))
    routed = M.route_response(
        env.select("conv_id", F.col("reply_turn").alias("turn"),
                   F.from_json("response_json", RESPONSE).alias("resp")))
    users = (M.by_role(log, "user")
             .select("conv_id", "turn", F.lit(0).alias("sub"), "role", "content",
                     F.lit(None).cast("string").alias("simplified_message")))
    return M.append_messages(users, routed.select(
        "conv_id", "turn", F.col("sub").cast("int").alias("sub"), "role", "content",
        "simplified_message"))


@register("request_roundtrip", WITH_LOG + f"""
SELECT conv_id, turn, {sql_js_trim('content')} AS message, simplify
FROM log WHERE role = 'user'""")
def q_request_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Encode each prompt as a JSON request, decode it back."""
    users = M.by_role(chat_log(spark, sf), "user")
    enc = encode_request(users.select("conv_id", "turn", js_trim("content").alias("message"),
                                      "simplify"))
    return decode_request(enc, "request_json").select("conv_id", "turn", "message", "simplify")
