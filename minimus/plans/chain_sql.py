"""DuckDB SQL for the simplify chain, one CTE per Spark stage (oracle only)."""

from __future__ import annotations

from ..functions.noise import sql_gumbel, sql_laplace
from ..functions.pii import sql_mask_pii, sql_vocabulary_text
from ..functions.secret_noise import sql_draw, sql_value
from ..functions.text import (sql_clean_text, sql_distinct_tokens, sql_js_trim, sql_lit,
                              sql_segment_array)
from ..operators.budget import EPS, SQL_ATTEMPT_TOTAL, sql_costs
from ..operators.policy import (DEFAULT_SEED, MAX_ATTEMPTS, noise_scales, sql_attempt_params,
                                sql_fillers_of, sql_policy_values)
from ..operators.segments import NORM_DROP
from ..operators.select import N_BINS, N_BUCKETS
from ..operators.typos import MIN_TARGET_DF, MIN_TYPO_LEN, PIECES
from ..operators.vocab import NIDF_SCALE

LEVELS_SQL = "['low', 'medium', 'high']"

DOC_BASE = f"""SELECT CAST(doc_id AS VARCHAR) AS pid, lang, {sql_clean_text('text')} AS text,
       {LEVELS_SQL}[(doc_id % 3) + 1] AS level
FROM documents"""


DISTANCE_SQL = """1.0 - (CASE WHEN sqrt(CAST(ss AS DOUBLE) * CAST(pp AS DOUBLE)) > 0
                                      THEN dot / sqrt(CAST(ss AS DOUBLE) * CAST(pp AS DOUBLE))
                                      ELSE 0.0 END)"""


def sql_content_tokens(e: str, lang: str) -> str:
    return (f"list_filter({sql_distinct_tokens(e)}, "
            f"lambda t: NOT list_contains({sql_fillers_of(lang)}, t))")


def sql_strip_filler(e: str, lang: str) -> str:
    kept = (f"list_filter(regexp_extract_all({e}, {sql_lit(PIECES)}), "
            f"lambda p: NOT list_contains({sql_fillers_of(lang)}, lower(p)))")
    return f"trim(regexp_replace(array_to_string({kept}, ''), ' {{2,}}', ' ', 'g'))"


def typo_ctes() -> str:
    """CTEs from ``base`` to ``corr`` (corrections) and ``fixes`` (one map per document)."""
    keys = ("list_transform(range(0, length(token) + 1), lambda i: {'k': CASE WHEN i = 0 "
            "THEN token ELSE substring(token, 1, i - 1) || substring(token, i + 1, length(token)) "
            "END, 'kpos': i})")
    return f"""
tv AS (SELECT lang, token, count(*) AS df, min(pid) AS doc
       FROM (SELECT lang, pid, unnest({sql_distinct_tokens(sql_vocabulary_text('text'))}) AS token FROM base)
       GROUP BY lang, token),
cands AS (SELECT lang, token, doc, kk.k AS k, kk.kpos AS kpos
          FROM (SELECT lang, token, doc, unnest({keys}) AS kk FROM tv
                WHERE df = 1 AND length(token) >= {MIN_TYPO_LEN})),
tgts AS (SELECT lang, token AS fix, df AS fix_df, kk.k AS k, kk.kpos AS kpos
         FROM (SELECT lang, token, df, unnest({keys}) AS kk FROM tv
               WHERE df >= {MIN_TARGET_DF} AND length(token) >= {MIN_TYPO_LEN - 1})),
pairs_ AS (SELECT DISTINCT c.lang, c.token, c.doc, t.fix, t.fix_df
          FROM cands c JOIN tgts t ON c.lang = t.lang AND c.k = t.k
          WHERE (c.kpos = t.kpos AND c.kpos > 0) OR ((c.kpos = 0) <> (t.kpos = 0))),
corr AS (SELECT lang, token, doc, fix, fix_df FROM (
           SELECT *, row_number() OVER (PARTITION BY lang, token ORDER BY fix_df DESC, fix) AS rn
           FROM pairs_) WHERE rn = 1),
fixes AS (SELECT lang, doc AS pid, map_from_entries(list({{'k': token, 'v': fix}})) AS fx
          FROM corr GROUP BY lang, doc),"""


def sql_fixed(e: str) -> str:
    """``e`` with the fixes of the map ``f.fx`` (NULL: none)."""
    return f"""CASE WHEN f.fx IS NULL THEN {e} ELSE array_to_string(
            list_transform(regexp_extract_all({e}, {sql_lit(PIECES)}), lambda p: coalesce(
              CASE WHEN substring(p, 1, 1) <> lower(substring(p, 1, 1))
                   THEN upper(substring(f.fx[lower(p)], 1, 1))
                        || substring(f.fx[lower(p)], 2, length(f.fx[lower(p)]))
                   ELSE f.fx[lower(p)] END, p)), '') END"""


def chain_ctes(base_sql: str = DOC_BASE, sweep: bool = False, seed: int = DEFAULT_SEED,
               topk_noise: str | None = None, typos: bool = False, salt: bytes | None = None) -> str:
    """CTE list (without the leading WITH) ending in ``chosen``. ``salt``: a private run's."""
    s = seed
    rank_by = "score"
    keys = ("pid", "level", "attempt")
    value, lap = str, sql_laplace
    if salt is not None:
        topk_noise, value = "geometric", sql_value

        def lap(scale, _, purpose, *names, two_sided=True):
            return sql_draw(salt, noise_scales()[scale], scale, purpose.strip("'"), *names, two_sided=two_sided)
        rank_by = f"({value('score')} + {lap('b', s, 'topk', *keys, 'pos', two_sided=False)})"
    if topk_noise == "gumbel":
        rank_by = f"(score + {sql_gumbel('b', s, chr(39) + 'topk' + chr(39), 'pid', 'level', 'attempt', 'pos')})"
    prompts = ("SELECT pid, lang, text, unnest(" + LEVELS_SQL + ") AS level FROM base"
               if sweep else "SELECT pid, lang, text, level FROM base")
    nidf = "ln((n_docs + 1) / (df + 1)) / ln(n_docs + 1)"
    fixed = "SELECT * FROM hidden"
    if typos:
        fixed = (f"SELECT h.pid, h.lang, h.level, {sql_fixed('h.m')} AS m "
                 "FROM hidden h LEFT JOIN fixes f ON h.pid = f.pid AND h.lang = f.lang")
    return f"""
base AS ({base_sql}),
vocab AS (SELECT lang, token, count(*) AS df
          FROM (SELECT lang, unnest({sql_distinct_tokens(sql_vocabulary_text('text'))}) AS token FROM base)
          GROUP BY lang, token),
sizes AS (SELECT lang, count(*) AS n_docs FROM base GROUP BY lang),
idf AS (SELECT lang, token, df, n_docs, ln((n_docs + 1) / (df + 1)) AS idf, {nidf} AS nidf,
               CAST(floor({nidf} * {NIDF_SCALE}) AS BIGINT) AS nidf_q
        FROM vocab JOIN sizes USING (lang)),
prompts AS ({prompts}),{typo_ctes() if typos else ''}
hidden AS (SELECT pid, lang, level, {sql_mask_pii('text', 'level')} AS m FROM prompts),
fixed AS ({fixed}),
masked AS (SELECT pid, lang, level, m AS masked, {sql_content_tokens('m', 'lang')} AS orig_tokens FROM fixed),
segs AS (SELECT pid, lang, level, pos, {sql_js_trim('raw')} AS seg
         FROM (SELECT pid, lang, level, unnest(range(len(a))) AS pos, unnest(a) AS raw
               FROM (SELECT pid, lang, level, {sql_segment_array('masked')} AS a FROM masked))
         WHERE {sql_js_trim('raw')} <> ''),
uniq AS (SELECT pid, lang, level, min(pos) AS pos, arg_min(seg, pos) AS seg
         FROM (SELECT *, trim(regexp_replace(lower(seg), {sql_lit(NORM_DROP)}, ' ', 'g')) AS norm
               FROM segs)
         GROUP BY pid, lang, level, norm),
toks AS (SELECT pid, lang, level, pos, token,
                count(*) OVER (PARTITION BY pid, lang, level, bucket) AS p_b,
                count(*) OVER (PARTITION BY pid, lang, level, pos, bucket) AS s_b
         FROM (SELECT *, (('0x' || substr(md5(token), 1, 8))::BIGINT) % {N_BUCKETS} AS bucket
               FROM (SELECT pid, lang, level, pos, unnest({sql_content_tokens('seg', 'lang')}) AS token
                     FROM uniq))),
agg AS (SELECT pid, lang, level, pos,
               sum(nidf_q) / (count(nidf_q) * {NIDF_SCALE}) AS score,
               CAST(sum(p_b) AS BIGINT) AS dot, CAST(sum(s_b) AS BIGINT) AS ss
        FROM toks LEFT JOIN idf USING (lang, token)
        GROUP BY pid, lang, level, pos),
scored AS (SELECT u.pid, u.lang, u.level, u.pos, u.seg,
                  coalesce(a.score, 0.0) AS score,
                  coalesce(a.dot, 0) AS dot, coalesce(a.ss, 0) AS ss,
                  count(*) OVER (PARTITION BY u.pid, u.level) AS n_seg,
                  CAST(sum(coalesce(a.dot, 0)) OVER (PARTITION BY u.pid, u.level) AS BIGINT) AS pp
           FROM uniq u LEFT JOIN agg a
             ON u.pid = a.pid AND u.lang = a.lang AND u.level = a.level AND u.pos = a.pos),
plan AS (SELECT *, {sql_attempt_params('attempt')}
         FROM (SELECT policy.*, CAST(r.attempt AS INTEGER) AS attempt
               FROM {sql_policy_values()} CROSS JOIN range(1, {MAX_ATTEMPTS + 1}) AS r(attempt))),
hist AS (SELECT level, CAST(least(floor(score * {N_BINS}), {N_BINS - 1}) AS BIGINT) AS bin,
                count(*) AS n
         FROM scored GROUP BY ALL),
thr AS (SELECT level, attempt, CAST(min(bin) AS DOUBLE) / {float(N_BINS)} AS t
        FROM (SELECT level, bin,
                     sum(n) OVER (PARTITION BY level ORDER BY bin
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
                     sum(n) OVER (PARTITION BY level) AS total
              FROM hist) h JOIN plan USING (level)
        WHERE cum >= q_att * total
        GROUP BY level, attempt),
rows_ AS (SELECT s.*, p.attempt, p.b_thr, p.b, p.c_att, p.k_att, p.knn_att, t.t
          FROM scored s JOIN plan p ON s.level = p.level
          JOIN thr t ON t.level = p.level AND t.attempt = p.attempt),
svt AS (SELECT * EXCLUDE (above, hits_before) FROM (
          SELECT *, coalesce(sum(CAST(above AS INTEGER)) OVER (
                   PARTITION BY pid, level, attempt ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hits_before
          FROM (SELECT *, ({value('score')} + {lap('b', s, "'nu'", 'pid', 'level', 'attempt', 'pos')})
                          >= ({value('t')} + {lap('b_thr', s, "'rho'", 'pid', 'level', 'attempt')}) AS above
                FROM rows_))
        WHERE above AND hits_before < greatest(1, CAST(ceil(c_att * n_seg) AS BIGINT))),
topk AS (SELECT * EXCLUDE (rn) FROM (
           SELECT *, row_number() OVER (PARTITION BY pid, level, attempt
                                        ORDER BY {rank_by} DESC, pos) AS rn FROM svt)
         WHERE rn <= greatest(1, CAST(ceil(k_att * n_seg) AS BIGINT))),
knn AS (SELECT * EXCLUDE (rn, d) FROM (
          SELECT *, row_number() OVER (PARTITION BY pid, level, attempt ORDER BY d, pos) AS rn
          FROM (SELECT *, {value(DISTANCE_SQL)}
                          + {lap('b', s, "'knn'", 'pid', 'level', 'attempt', 'pos')} AS d
                FROM topk))
        WHERE rn <= greatest(1, CAST(ceil(knn_att * n_seg) AS BIGINT))),
rebuilt AS (SELECT pid, level, attempt, string_agg(seg, ' ' ORDER BY pos) AS simplified,
                   count(*) AS n_kept
            FROM knn GROUP BY pid, level, attempt),
req AS (SELECT pid, level, list_sort(list(token)) AS required FROM (
          SELECT pid, level, token, row_number() OVER (
                   PARTITION BY pid, level ORDER BY nidf_q DESC, token) AS rn
          FROM (SELECT pid, lang, level, unnest(orig_tokens) AS token FROM masked) x
          JOIN idf USING (lang, token))
        WHERE rn <= 5 GROUP BY pid, level),
segcount AS (SELECT pid, level, max(n_seg) AS n_seg FROM scored GROUP BY pid, level),
att AS (SELECT m.pid, m.lang, m.level, p.attempt, m.orig_tokens, p.pass_score, p.max_missing,
               {sql_costs(topk_noise, 'g.n_seg')},
               coalesce(r.simplified, '') AS simplified, coalesce(r.n_kept, 0) AS n_kept,
               coalesce(q.required, []::VARCHAR[]) AS required
        FROM masked m JOIN plan p ON m.level = p.level
        LEFT JOIN rebuilt r ON r.pid = m.pid AND r.level = m.level AND r.attempt = p.attempt
        LEFT JOIN req q ON q.pid = m.pid AND q.level = m.level
        LEFT JOIN segcount g ON g.pid = m.pid AND g.level = m.level),
tried AS (SELECT *, (similarity >= pass_score AND len(missing) <= max_missing) AS passed
             FROM (SELECT *,
                     list_sort(list_filter(required, lambda x: NOT list_contains(simp_tokens, x))) AS missing,
                     CASE WHEN len(orig_tokens) = 0 THEN 1.0
                          ELSE len(list_intersect(orig_tokens, simp_tokens)) / len(orig_tokens) END
                       AS similarity
                   FROM (SELECT *, {sql_content_tokens('simplified', 'lang')} AS simp_tokens FROM att))),
reviewed AS (SELECT * EXCLUDE (before) FROM (
               SELECT *, coalesce(max(CAST(passed AS INTEGER)) OVER (
                 PARTITION BY pid, level ORDER BY attempt
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tried)
             WHERE before = 0),
spent AS (SELECT pid, level, CAST(sum({SQL_ATTEMPT_TOTAL}) AS {EPS}) AS spent_eps,
                 CAST(sum(rho_q) AS BIGINT) AS spent_rho_q, CAST(sum(exact_steps) AS BIGINT) AS spent_exact
          FROM reviewed GROUP BY pid, level),
chosen AS (SELECT * EXCLUDE (simplified, rn), {sql_strip_filler('simplified', 'lang')} AS simplified,
                  CASE WHEN passed THEN 'approved' ELSE 'rejected' END AS status
           FROM (SELECT *, row_number() OVER (PARTITION BY pid, level ORDER BY attempt DESC) AS rn
                 FROM reviewed) JOIN spent USING (pid, level)
           WHERE rn = 1)
"""


def with_chain(select_sql: str, base_sql: str = DOC_BASE, sweep: bool = False,
               topk_noise: str | None = None, typos: bool = False, salt: bytes | None = None) -> str:
    return ("WITH " + chain_ctes(base_sql, sweep, topk_noise=topk_noise, typos=typos, salt=salt).strip() + "\n"
            + select_sql)

