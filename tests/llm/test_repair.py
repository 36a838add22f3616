"""Conversation repair: brute force over edits, SQL, blocks of any size."""

import hashlib
import itertools
import random

import duckdb
import pytest
from pyspark.sql import types as T

from minimus.llm import repair

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
                      + [T.StructField(c, T.StringType()) for c in ("key", "pos", "copies", "letters", "block")])


@pytest.fixture(scope="module")
def make_turns(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def some_turns(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Hello.", "Is it?", "no end", "", "  \n", None, f"Text {rng.randint(0, 4)}!", "end. \t"])
            rows.append((c if c else None, rng.choice([t, t, t, t + 1, None]), role, text))
    return rows


def brute(rows):
    """Audit and lines of one conversation's damaged rows, over all sequences of edits."""
    def go(i, state, cost):
        """All (cost, audit, lines) from row i on."""
        if i == len(rows) and state in "0a":
            yield cost, "", ()
        if cost > 2 * len(rows):  # deleting all is cheaper
            return
        nxt = {"0": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[nxt]
        for c, audit, lines in go(i, nxt, cost + 5):
            yield c, "I" + audit, (name + ":", *lines)
        if i == len(rows):
            return
        role, text, fault = rows[i]
        for c, audit, lines in go(i + 1, state, cost + 2):
            yield c, "D" + audit, lines
        if fault in ("blank", "duplicate"):
            return
        extra = 5 if fault == "truncated" else 0
        first = role[:1]
        if (state, first) in {("0", "s"), ("0", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
            for c, audit, lines in go(i + 1, first, cost + extra):
                yield c, "K" + audit, (f"{role}:{text}", *lines)
        for c, audit, lines in go(i + 1, nxt, cost + 1 + extra):
            yield c, "R" + audit, (f"{name}:{text}", *lines)
    return min(go(0, "0", 0), key=lambda x: (x[0], x[1]))


def prepared(rows):
    """Per conversation the rows with their first fault."""
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role if role is not None else " ", text if text is not None else " "))
    out = {}
    for c, some in convs.items():
        seen, fixed = set(), []
        for _, _, role, text in sorted(some):
            body = text.rstrip(repair.SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            fixed.append((role, text, fault))
        out[c] = fixed
    return out


def test_against_all_edits(make_turns):
    rows = some_turns(1, 60, 4)
    turns = make_turns(rows)
    got = {r.conv_id: r for r in repair.repair_report(turns, turns).collect()}
    want = prepared(rows)
    assert got.keys() == want.keys()
    for c, some in want.items():
        cost, audit, lines = brute(some)
        r = got[c]
        assert (r.cost, r.audit) == (cost, audit), some
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        for name in ("blank", "duplicate", "truncated"):
            assert getattr(r, name) == sum(x[2] == name for x in some)
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(some))


def sql_rows(turns):
    con = duckdb.connect()
    con.register("t", turns.toArrow())
    con.sql("CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM t")
    return sorted(con.sql(repair.REPORT_SQL).fetchall(), key=str)


def test_matches_sql(make_turns):
    turns = make_turns(some_turns(2, 40, 12) + [(900, 1, "user", "Only.")] * 7)
    got = repair.repair_report(repair.damage(turns), turns)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sql_rows(turns)


@pytest.mark.parametrize("block", [1, 7])
def test_blocks(make_turns, block):
    """Short blocks: checkpoints, exits and entries meet. One long conversation."""
    rng = random.Random(block)
    rows = [(1, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", "C!", f"{t}."])) for t in range(300)]
    turns = make_turns(rows + some_turns(3, 10, 6))
    whole = sorted(repair.repair_report(turns, turns).collect(), key=str)
    assert sorted(repair.repair_report(turns, turns, block=block).collect(), key=str) == whole


def test_repaired_turns(make_turns):
    turns = make_turns(some_turns(4, 30, 8))
    rows = repair.repair(turns).rows
    by_conv = {}
    for r in repair.repaired_turns(rows).orderBy("key", "pos", "step").collect():
        by_conv.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in repair.repair_report(turns, turns).collect():
        lines = by_conv.get(r.conv_id, [])
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        roles = "".join(x[:1] for x in lines)
        assert roles.removeprefix("s").replace("ua", "") == "" and roles != "s"


def test_odd_tables(make_turns):
    empty = make_turns([])
    assert repair.repair_report(repair.damage(empty), empty).collect() == []
    turns = make_turns([(5, None, None, None), (5, None, None, None)])
    row = repair.repair_report(turns, turns).collect()[0]
    assert tuple(row)[:8] == (5, 0, 2, 0, 0, 1, 4, "DD")
    gone = repair.repair_report(empty, turns).collect()[0]
    assert tuple(gone) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    many = make_turns([(1, 0, "user", "Same.")] * 500 + [(1, 1, "assistant", "Yes.")])
    row = repair.repair_report(many, many).collect()[0]
    assert (row.duplicate, row.cost, row.audit) == (499, 998, "K" + "D" * 499 + "K")
