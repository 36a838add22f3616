"""Conversation structure repair: the cheapest edits that make the roles ``(s?(ua)+)?``.

Each row of a conversation may be kept (K, cost 0), given the role user or assistant (R, 1) or
deleted (D, 2); an empty user or assistant turn may be inserted anywhere (I, 5). Blank rows
and rows whose role and text came earlier must go; a truncated row that stays costs 5
more. Roles count by their first character. Of all cheapest edits the one whose letters are
least in ASCII order is taken: a state (nothing yet, after s, after u, after a) and a letter
tell the next state, so a forward walk that takes the least letter still on a cheapest way
finds it, given the cost-to-go of every state.

Costs-to-go run backward, the walk runs forward, and a conversation may be as long as the
table. So they are kept at checkpoints only: a conversation of m rows is cut into blocks of
max(``BLOCK``, sqrt(m)) rows. A block's effect on costs is a 4 x 4 min-plus matrix, found in any
task. The matrices of one conversation (sqrt(m) at most) give the cost vectors at its block
ends. Each block then recomputes its own vectors from the checkpoint at its end and walks
forward from each of the four states it may be entered in; the exits chain up to the one
that counts, and the block is walked once more to write its edits. No task holds more than a
block or the checkpoints of a conversation. Only the digest of a repaired conversation, a
SHA-256 over all its text, reads a conversation in one task, as a stream.

Defined results: a null role or text is one space; a null turn comes first; rows of the same
turn stand in the order of role and text; identical rows (conversation, turn, role, text)
stand together; rows without conv_id form one conversation; an empty table gives no rows.
Other columns of the input are ignored. Texts with equal SHA-256 count as equal.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import map_batches, stage

#: White space of the texts.
SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: Rows of a block, at least.
BLOCK = 4096
#: Classes of roles by first character, states, faults.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
FINE, GONE, CUT = range(3)
NEVER = 1 << 40

#: State after an inserted turn; the state also names the role that it adds.
ADD = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: State after keeping a row of a class, by (class, state).
KEEP = {(SYSTEM, NOTHING): AFTER_S, (USER, NOTHING): AFTER_U, (USER, AFTER_S): AFTER_U,
        (USER, AFTER_A): AFTER_U, (ASSISTANT, AFTER_U): AFTER_A}
#: Cost-to-go of the states after the last row, insertions included.
END = (0, 2 * INSERT, INSERT, 0)
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
LEGAL = np.zeros((4, 4), bool)
LEGAL[[SYSTEM, USER, ASSISTANT], [USER, ASSISTANT, USER]] = True


def before_row(after, kind: int, fault: int):
    """Cost-to-go of the states before a row, given those after it."""
    best = [DELETE + x for x in after]
    if fault != GONE:
        extra = TRUNCATED if fault == CUT else 0
        for s in range(4):
            stay = KEEP.get((kind, s))
            if stay is not None and after[stay] + extra < best[s]:
                best[s] = after[stay] + extra
            if after[ADD[s]] + REROLE + extra < best[s]:
                best[s] = after[ADD[s]] + REROLE + extra
    u, a = best[AFTER_U], best[AFTER_A]
    best[AFTER_U], best[AFTER_A] = min(u, a + INSERT), min(a, u + INSERT)
    best[NOTHING] = min(best[NOTHING], best[AFTER_U] + INSERT)
    best[AFTER_S] = min(best[AFTER_S], best[AFTER_U] + INSERT)
    return best


def row_matrices() -> np.ndarray:
    """(class, fault, state before, state after): least cost over one row."""
    out = np.full((4, 3, 4, 4), NEVER, np.int64)
    for kind in range(4):
        for fault in range(3):
            for t in range(4):
                unit = [NEVER] * 4
                unit[t] = 0
                out[kind, fault, :, t] = np.minimum(before_row(unit, kind, fault), NEVER)
    return out


ROWS = row_matrices()


def block_matrix(kinds: np.ndarray, faults: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """The min-plus product of a block's rows; further copies of a row are deleted."""
    m = ROWS[kinds, faults] + (DELETE * (copies - 1))[:, None, None]
    while len(m) > 1:
        if len(m) % 2:
            unit = np.where(np.eye(4, dtype=bool), 0, NEVER)[None]
            m = np.concatenate([m, unit])
        m = np.minimum((m[0::2, :, :, None] + m[1::2, None, :, :]).min(axis=2), NEVER)
    return m[0]


def vectors(kinds, faults, copies, after) -> list:
    """Cost-to-go before each row of a block and after its last."""
    out = [list(after)]
    for kind, fault, n in zip(reversed(kinds), reversed(faults), reversed(copies), strict=True):
        out.append([x + DELETE * (n - 1) for x in before_row(out[-1], kind, fault)])
    return out[::-1]


def walk(kinds, faults, copies, costs, state: int, last: bool):
    """Exit state, and per row (letters, new roles): the letters of its insertions and of the
    row itself, without further copies; roles in the order of I and R."""
    edits = []
    for i, (kind, fault, n) in enumerate(zip(kinds, faults, copies, strict=True)):
        here, after = costs[i], costs[i + 1]
        letters, roles = "", []
        extra = DELETE * (n - 1) + (TRUNCATED if fault == CUT else 0)
        while True:
            if here[state] == after[state] + DELETE * n:
                letters += "D"
                break
            if here[state] == here[ADD[state]] + INSERT:
                letters += "I"
                state = ADD[state]
                roles.append(ROLE[state])
                continue
            stay = KEEP.get((kind, state))
            if stay is not None and here[state] == after[stay] + extra:
                letters += "K"
                state = stay
                break
            letters += "R"
            state = ADD[state]
            roles.append(ROLE[state])
            break
        edits.append((letters, roles))
    if last:
        tail = []
        while state not in (NOTHING, AFTER_A):
            state = ADD[state]
            tail.append(ROLE[state])
    else:
        tail = []
    return state, edits, tail


def _key(conv: Column) -> Column:
    """A conversation's id as a string that joins find, null included."""
    return F.concat(F.when(conv.isNull(), "n").otherwise("v"), F.coalesce(conv.cast("string"), F.lit("")))


class Repair(NamedTuple):
    #: One row per distinct row of the input in its order: key, conv_id, pos, turn, role, text, copies, fault
    #: ('', 'blank', 'duplicate', 'truncated'), letters, roles, tail (roles added after the last row).
    rows: DataFrame
    #: Per conversation: key, cost, illegal (adjacent rows whose roles may not follow each other).
    conversations: DataFrame


def _ordered(turns: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies and a position that rises with turn, role
    and text. Equal rows are counted before the shuffle; the range sort splits long conversations."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    space = F.lit(" ")
    rows = (turns.select(_key(F.col("conv_id")).alias("key"), "conv_id", "turn",
                         F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
            .groupBy("key", "conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
            .repartitionByRange(n, "key", "turn", "role", F.left("text", F.lit(64)))
            .sortWithinPartitions("key", "turn", "role", "text"))
    trimmed = F.rtrim("text", F.lit(SPACE))
    kind = F.left("role", F.lit(1))
    return stage(rows.select(
        "*", F.monotonically_increasing_id().alias("pos"), F.sha2("text", 256).alias("digest"),
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.when(kind == "s", SYSTEM).when(kind == "u", USER).when(kind == "a", ASSISTANT).otherwise(OTHER).alias("kind")),
        "repair-rows")


def _numbered(rows: DataFrame, block: int) -> DataFrame:
    """Light rows (key, pos, kind, fault code, copies, idx, block)."""
    part = F.shiftright("pos", 33)
    light = rows.select("key", "pos", part.alias("part"), "kind", "copies", "blank", "cut")
    of_part = light.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("pos").alias("low"))
    before = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    places = of_part.select("key", "part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
                            F.sum("n").over(W.partitionBy("key")).alias("m"))
    first = rows.groupBy("key", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    size = F.greatest(F.lit(block), F.ceil(F.sqrt(F.col("m").cast("double"))).cast("long"))
    idx = F.col("base") + F.col("pos") - F.col("low")
    seen = F.col("first").isNull()
    return (light.join(first, "pos", "left").join(places, ["key", "part"]).select(
        "key", "pos", "kind", "copies", idx.alias("idx"), F.floor(idx / size).alias("block"),
        F.when(F.col("blank"), "blank").when(seen, "duplicate").when(F.col("cut"), "truncated").otherwise("").alias("fault"),
        F.when(F.col("blank") | seen, GONE).when(F.col("cut"), CUT).otherwise(FINE).alias("code")))


def _rows_of(cell):
    """kinds, faults, copies, positions of a block's sorted array of structs."""
    flat = cell.values
    return [flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("kind", "code", "copies", "pos")]


def _batch(rows: list[dict], schema: pa.Schema):
    for k in range(0, len(rows), 512):
        yield pa.RecordBatch.from_pylist(rows[k:k + 512], schema)


LONGS = pa.list_(pa.int64())


def _matrices(batches):
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("matrix", LONGS), ("first", pa.int64()),
                        ("last", pa.int64()), ("illegal", pa.int64())])
    for b in batches:
        out = []
        for r in range(b.num_rows):
            kinds, faults, copies, _ = _rows_of(b.column("rows")[r])
            wrong = int((~LEGAL[kinds[:-1], kinds[1:]]).sum() + (copies - 1).sum())
            out.append({"key": b.column("key")[r].as_py(), "block": b.column("block")[r].as_py(),
                        "matrix": block_matrix(kinds, faults, copies).ravel().tolist(),
                        "first": int(kinds[0]), "last": int(kinds[-1]), "illegal": wrong})
        yield from _batch(out, schema)


def _checkpoints(batches):
    """Per conversation, from its blocks' matrices: the cost vector after each block."""
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("after", LONGS), ("last", pa.bool_()),
                        ("cost", pa.int64()), ("illegal", pa.int64())])
    for b in batches:
        for r in range(b.num_rows):
            blocks = sorted(b.column("blocks")[r].as_py(), key=lambda x: x["block"])
            v, out = np.array(END, np.int64), []
            wrong = sum(x["illegal"] for x in blocks)
            wrong += sum(not LEGAL[x["last"], y["first"]] for x, y in zip(blocks, blocks[1:], strict=False))
            for x in reversed(blocks):
                out.append({"key": b.column("key")[r].as_py(), "block": x["block"], "after": v.tolist(),
                            "last": x is blocks[-1], "cost": None, "illegal": None})
                v = (np.array(x["matrix"], np.int64).reshape(4, 4) + v[None, :]).min(axis=1)
            out[-1] |= {"cost": int(v[NOTHING]), "illegal": int(wrong)}  # on the first block
            yield from _batch(out, schema)


def _exits(batches):
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("exits", LONGS)])
    for b in batches:
        out = []
        for r in range(b.num_rows):
            rows = [x.tolist() for x in _rows_of(b.column("rows")[r])[:3]]
            costs = vectors(*rows, b.column("after")[r].as_py())
            out.append({"key": b.column("key")[r].as_py(), "block": b.column("block")[r].as_py(),
                        "exits": [walk(*rows, costs, s, False)[0] for s in range(4)]})
        yield from _batch(out, schema)


def _entries(batches):
    """Per conversation: the state in which the walk enters each block."""
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("state", pa.int64())])
    for b in batches:
        for r in range(b.num_rows):
            state, out = NOTHING, []
            for x in sorted(b.column("blocks")[r].as_py(), key=lambda x: x["block"]):
                out.append({"key": b.column("key")[r].as_py(), "block": x["block"], "state": state})
                state = x["exits"][state]
            yield from _batch(out, schema)


def _edits(batches):
    texts = pa.list_(pa.string())
    schema = pa.schema([("pos", pa.int64()), ("letters", pa.string()), ("roles", texts), ("tail", texts)])
    for b in batches:
        for r in range(b.num_rows):
            *rows, places = (x.tolist() for x in _rows_of(b.column("rows")[r]))
            costs = vectors(*rows, b.column("after")[r].as_py())
            _, edits, tail = walk(*rows, costs, b.column("state")[r].as_py(), b.column("last")[r].as_py())
            yield from _batch([{"pos": p, "letters": x, "roles": y, "tail": tail if p == places[-1] else []}
                               for p, (x, y) in zip(places, edits, strict=True)], schema)


def repair(turns: DataFrame, block: int = BLOCK) -> Repair:
    """The edits of every row of ``turns`` (conv_id, turn, role, text)."""
    rows = _ordered(turns)
    numbered = stage(_numbered(rows, block), "repair-numbered")
    blocks = numbered.groupBy("key", "block").agg(
        F.array_sort(F.collect_list(F.struct("idx", "kind", "code", "copies", "pos"))).alias("rows"))
    blocks = stage(blocks, "repair-blocks")
    matrices = map_batches(blocks, _matrices, "key string, block long, matrix array<long>, first long, last long, illegal long")
    whole = matrices.groupBy("key").agg(F.collect_list(F.struct("block", "matrix", "first", "last", "illegal")).alias("blocks"))
    marks = stage(map_batches(whole, _checkpoints, "key string, block long, after array<long>, last boolean, cost long, illegal long"),
                  "repair-checkpoints")
    marked = blocks.join(marks.select("key", "block", "after", "last"), ["key", "block"])
    exits = map_batches(marked, _exits, "key string, block long, exits array<long>")
    chained = exits.groupBy("key").agg(F.collect_list(F.struct("block", "exits")).alias("blocks"))
    entries = stage(map_batches(chained, _entries, "key string, block long, state long"), "repair-entries")
    edits = map_batches(marked.join(entries, ["key", "block"]), _edits,
                        "pos long, letters string, roles array<string>, tail array<string>")
    faults = numbered.select("pos", "fault")
    out = (rows.select("key", "conv_id", "pos", "turn", "role", "text", "copies")
           .join(faults, "pos").join(edits, "pos"))
    return Repair(out, marks.where(F.col("cost").isNotNull()).select("key", "cost", "illegal"))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(key, conv_id, pos, step, role, text): the repaired conversations, in the order of
    pos and step, from the edits."""
    letters = F.filter(F.split(F.concat("letters", F.repeat(F.lit("I"), F.size("tail"))), ""), lambda x: x.isin(*"IKR"))
    each = F.transform(letters, lambda x, i: F.struct(i.alias("step"), x.alias("edit")))
    turns = rows.select("key", "conv_id", "pos", "role", "text", F.concat("roles", "tail").alias("made"),
                        F.array_position(letters, "K").alias("kept"), F.explode(each).alias("e"))
    # the row's own turn, if it is kept, takes none of the made roles
    own = F.when((F.col("kept") > 0) & (F.col("e.step") >= F.col("kept")), 1).otherwise(0)
    return turns.select(
        "key", "conv_id", "pos", F.col("e.step").alias("step"),
        F.when(F.col("e.edit") == "K", F.col("role")).otherwise(F.get("made", F.col("e.step") - own)).alias("role"),
        F.when(F.col("e.edit") == "I", F.lit("")).otherwise(F.col("text")).alias("text"))


def _digest(batches):
    """Rows sorted by key and pos: per key the audit and the digest of the repaired text."""
    names = ["key", "audit", "repaired_sha256"]
    now, audit, sha, lines = None, [], None, 0

    def done():
        return pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (now, "".join(audit), sha.hexdigest())], names)

    for b in batches:
        cols = [b.column(n).to_pylist() for n in ("key", "role", "text", "copies", "letters", "roles", "tail")]
        for key, role, text, copies, letters, roles, tail in zip(*cols, strict=True):
            if key != now:
                if now is not None:
                    yield done()
                now, audit, sha, lines = key, [], hashlib.sha256(), 0
            audit += [letters, "D" * (copies - 1), "I" * len(tail)]
            new = iter(roles)
            out = [role if x == "K" else next(new) for x in letters if x != "D"]
            out = [f"{r}:{text if x != 'I' else ''}" for r, x in zip(out, letters.replace("D", ""), strict=True)]
            for line in out + [f"{r}:" for r in tail]:
                sha.update((("\n" if lines else "") + line).encode())
                lines += 1
    if now is not None:
        yield done()


def repair_report(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conv_id of ``conversations``: faults, cost, audit and digest of the repair
    of ``turns``."""
    fixed = repair(turns, block)
    rows = stage(fixed.rows, "repair-edits")
    copies = F.col("copies")

    def faulty(name: str) -> Column:
        return F.sum(F.when(F.col("fault") == name, 1).otherwise(0)).alias(name)

    more = F.sum(F.when(F.col("fault").isin("blank", "duplicate"), copies).otherwise(copies - 1)
                 - F.when(F.col("fault") == "blank", copies).otherwise(0)).alias("duplicate")
    blank = F.sum(F.when(F.col("fault") == "blank", copies).otherwise(0)).alias("blank")
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    stats = rows.groupBy("key").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    stats = stats.join(rows.groupBy("key").agg(blank, more, faulty("truncated")), "key").join(fixed.conversations, "key")
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digests = map_batches(
        rows.select("key", "pos", "role", "text", "copies", "letters", "roles", "tail")
        .repartition(n, "key").sortWithinPartitions("key", "pos"), _digest, "key string, audit string, repaired_sha256 string")
    every = conversations.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    zero = F.lit(0).cast("long")
    return (every.join(stats, "key", "left").join(digests, "key", "left").select(
        "conv_id", *[F.coalesce(F.col(c).cast("long"), zero).alias(c)
                     for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


def damage(turns: DataFrame) -> DataFrame:
    """The rows that op11 repairs: by crc32 of conversation and turn, modulo 20, a row is dropped (0),
    loses its text (1) or its sentence marks (2), comes twice (3) or is said by the user (4)."""
    space = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                        F.pmod(F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                                                F.coalesce(F.col("turn").cast("string"), space)).cast("binary")),
                               F.lit(20)).alias("hit"))
    hit = F.col("hit")
    return rows.where(hit != 0).select(
        "conv_id", "turn", F.when(hit == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


REPORT_SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (
  SELECT *, xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
        lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 20 AS h
  FROM src),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE h <> 0),
convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
rows AS (
  SELECT c, turn, role, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    left(role, 1) AS kind,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged d JOIN convs v ON d.conv_id IS NOT DISTINCT FROM v.conv_id),
faults AS (
  SELECT *, CASE WHEN body = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(kind) OVER (PARTITION BY c ORDER BY i) AS before
  FROM rows),
stats AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || kind NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY c),
added(s, letters, t, lines) AS (VALUES
  ('0', '', '0', ''), ('0', 'I', 'u', chr(10) || 'user:'), ('0', 'II', 'a', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('s', '', 's', ''), ('s', 'I', 'u', chr(10) || 'user:'), ('s', 'II', 'a', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('u', '', 'u', ''), ('u', 'I', 'a', chr(10) || 'assistant:'), ('a', '', 'a', ''), ('a', 'I', 'u', chr(10) || 'user:')),
edit(t, letter, fee, kind, s) AS (VALUES
  ('0', 'K', 0, 's', 's'), ('0', 'K', 0, 'u', 'u'), ('s', 'K', 0, 'u', 'u'), ('a', 'K', 0, 'u', 'u'), ('u', 'K', 0, 'a', 'a'),
  ('0', 'R', 1, NULL, 'u'), ('s', 'R', 1, NULL, 'u'), ('a', 'R', 1, NULL, 'u'), ('u', 'R', 1, NULL, 'a'),
  ('0', 'D', 2, NULL, '0'), ('s', 'D', 2, NULL, 's'), ('u', 'D', 2, NULL, 'u'), ('a', 'D', 2, NULL, 'a')),
way AS (
  SELECT c, 0::BIGINT AS i, '0' AS s, {'cost': 0::BIGINT, 'audit': '', 'lines': ''} AS best FROM convs
  UNION ALL
  SELECT w.c, w.i + 1, e.s, min({
    'cost': w.best.cost + 5 * length(a.letters) + e.fee + CASE WHEN e.letter <> 'D' AND r.fault = 'truncated' THEN 5 ELSE 0 END,
    'audit': w.best.audit || a.letters || e.letter,
    'lines': w.best.lines || a.lines || CASE e.letter WHEN 'D' THEN ''
      WHEN 'K' THEN chr(10) || r.role || ':' || r.text
      ELSE chr(10) || CASE e.s WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text END})
  FROM way w JOIN faults r ON r.c = w.c AND r.i = w.i + 1
  JOIN added a ON a.s = w.s
  JOIN edit e ON e.t = a.t AND (e.kind IS NULL OR e.kind = r.kind) AND (e.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
  GROUP BY w.c, w.i + 1, e.s),
ends AS (
  SELECT w.c, min({'cost': w.best.cost + 5 * length(a.letters), 'audit': w.best.audit || a.letters,
    'lines': w.best.lines || a.lines}) AS best
  FROM way w JOIN added a ON a.s = w.s AND a.t IN ('0', 'a') LEFT JOIN stats t ON t.c = w.c
  WHERE w.i = coalesce(t.n, 0) GROUP BY w.c)
SELECT v.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, e.best.cost AS cost, e.best.audit AS audit,
  sha256(substr(e.best.lines, 2)) AS repaired_sha256
FROM convs v JOIN ends e ON e.c = v.c LEFT JOIN stats t ON t.c = v.c
"""
