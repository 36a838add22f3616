"""Chat formatting with DataFrame expressions only.

The turns of a conversation are collected as structs and sorted; runs of adjacent turns
with the same role become one block; the blocks are concatenated to one string:

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n ...

Control strings start with ``<``, and texts and roles hold none after escaping:
``\\`` becomes ``\\e`` and ``<`` becomes ``\\l`` (in roles also a line end ``\\n``), which
is undone piece by piece. The loss mask is a list of (start, length) spans in code points
over the formatted string: one span per assistant turn, its escaped text without
markers.

One conversation is one output string, so its turns meet in one task by definition; the
partial collect runs before the shuffle, and nothing is gathered over conversations.

Defined results: a null text is an empty one; a null role is an empty role; rows with the
same turn are kept, ordered by role and text; a null turn comes first; rows with a null
conv_id form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: What the loss is taken on.
LEARNED = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from rows (conv_id, turn, role, text)."""
    rows = turns.select(
        "conv_id", "turn",
        escape_role(F.coalesce(F.col("role"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    convs = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def opens(i: Column) -> Column:  # a block starts at turn i
        return (i == 0) | (F.get("turns", i).role != F.get("turns", i - 1).role)

    def closes(i: Column) -> Column:
        return (i == F.size("turns") - 1) | (F.get("turns", i).role != F.get("turns", i + 1).role)

    # each turn: what stands before its text, the text, what stands after it
    merged = convs.select("conv_id", F.transform("turns", lambda t, i: F.struct(
        F.when(opens(i), F.concat(F.lit(START), t.role, F.lit("\n"))).otherwise(F.lit(SEP)).alias("pre"),
        t.text.alias("text"),
        F.when(closes(i), F.lit(END)).otherwise(F.lit("")).alias("post"),
        (t.role == LEARNED).alias("learned"))).alias("parts"))
    measured = merged.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p.pre, p.text, p.post)), "").alias("formatted"),
        F.transform("parts", lambda p: F.struct(
            F.length(p.pre).cast("long").alias("pre"), F.length(p.text).cast("long").alias("text"),
            F.length(p.post).cast("long").alias("post"), p.learned.alias("learned"))).alias("sizes"))
    walk = F.aggregate(
        "sizes",
        F.struct(F.lit(0).cast("long").alias("at"),
                 F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc.at + p.pre + p.text + p.post).alias("at"),
            F.when(p.learned, F.concat(acc.spans, F.array(F.struct(
                (acc.at + p.pre).alias("start"), p.text.alias("length")))))
            .otherwise(acc.spans).alias("spans")),
        lambda acc: acc.spans)
    return measured.select("conv_id", "formatted", walk.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text), unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substr(b, F.locate("\n", b) + 1), r"<\|im_sep\|>"),
        lambda t: F.struct(
            unescape_role(F.substr(b, F.lit(len(START) + 1), F.locate("\n", b) - len(START) - 1)).alias("role"),
            unescape(t).alias("text")))))


def read_learned(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(
        F.substr(formatted, (s.start + 1).cast("int"), s.length.cast("int"))))


def chat_report(turns: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations and their loss masks."""
    out = format_conversations(turns)
    back = out.select("conv_id", read_turns(F.col("formatted")).alias("turns"),
                      F.array_join(read_learned(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
                      F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")


REPORT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, replace(replace(replace(role, '\', '\e'), '<', '\l'), chr(10), '\n') AS erole,
    replace(replace(text, '\', '\e'), '<', '\l') AS etext FROM rows),
neighbours AS (
  SELECT *, lag(erole) OVER w AS before FROM escaped
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, erole, etext))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, erole, etext)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, erole, etext) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(etext) + CASE WHEN before IS NOT DISTINCT FROM erole THEN 10 ELSE 24 + length(erole) END)::BIGINT AS formatted_chars
FROM neighbours GROUP BY conv_id
"""
