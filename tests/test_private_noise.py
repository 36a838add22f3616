"""Discrete noise under a secret salt, and the budget accountant."""

import hmac
import math
import os
import subprocess
import sys
from collections import Counter
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from minimus.functions import secret_noise as S
from minimus.operators import budget
from minimus.session import scratch_path

SALT = b"another public salt for these tests"
SCALES = {"b": ["0.025", "0.2"]}


@pytest.fixture(scope="module")
def noise(spark):
    path = scratch_path(spark, "noise-key")
    S.write_key(spark, path, SALT)
    return S.SecretNoise(spark, path, SCALES)


def test_thresholds_are_the_digits_of_a_geometric():
    for scale in ("0.025", "0.05", "0.2"):
        t = Decimal(scale) * S.GRID
        got = S.thresholds(scale)
        assert all(isinstance(x, int) for x in got)
        for j, x in enumerate(got):
            assert abs(x / 2**60 - 1 / (1 + math.exp(2**j / float(t)))) < 1e-12
        # probability of a value from its digits: q^k (1 - q)
        q = math.exp(-1 / float(t))
        for k in (0, 1, 5, 100):
            p = 1.0
            for j, x in enumerate(got):
                p *= x / 2**60 if k >> j & 1 else 1 - x / 2**60
            assert math.isclose(p, q**k * (1 - q), rel_tol=1e-9)


def test_stream_is_hmac(spark, noise):
    row = spark.range(1).select(noise._mac(F.lit("some message")).alias("h")).first()
    assert row.h == hmac.new(SALT, b"some message", "sha256").hexdigest()
    long = spark.range(1).select(F.lit(1)).first()
    assert long and S.pads(b"x" * 100) == S.pads(__import__("hashlib").sha256(b"x" * 100).digest())


def test_distribution(spark, noise):
    n = 20_000
    rows = spark.range(n).withColumn("b", F.lit(0.025))
    two = [r.x for r in noise.draws(rows, "b", "x", "nu", "id").select("x").collect()]
    sd = S.standard_deviation("0.025")
    assert abs(sum(two) / n) < 5 * sd / math.sqrt(n)
    assert abs(math.sqrt(sum(x * x for x in two) / n) / sd - 1) < 0.05
    t = 0.025 * S.GRID
    q = math.exp(-1 / t)
    for low, high in ((-10, 10), (0, 50), (100, 400)):
        p = sum((1 - q) / (1 + q) * q ** abs(k) for k in range(low, high))
        got = sum(low <= x < high for x in two) / n
        assert abs(got - p) < 5 * math.sqrt(p * (1 - p) / n)
    one = [r.x for r in noise.draws(rows, "b", "x", "top", "id", two_sided=False).select("x").collect()]
    assert min(one) >= 0 and abs(sum(one) / n - q / (1 - q)) < 5 * t / math.sqrt(n)


@pytest.mark.parametrize("scales", [["0.025", "0.2"], ["0.025", "0.1"]])  # 16 digits, and 15: blocks hold both signs
def test_at_least_is_the_whole_draw_compared(spark, noise, monkeypatch, scales):
    """the highest digits decide most comparisons, the answer is that of all digits."""
    monkeypatch.setattr(noise, "scales", {"b": scales})
    monkeypatch.setattr(noise, "digits", {s: S.thresholds(s) for s in scales})
    rows = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, float(scales[1])).otherwise(float(scales[0])).alias("b"))
    rows = noise.draws(rows, "b", "x", "nu", "id")
    near = (F.col("id") % 7 - 3) * F.element_at(F.array(*[F.lit(k) for k in (0, 1, 20, 300, 5000, 1 << 20)]), (F.col("id") % 6 + 1).cast("int"))
    rows = rows.withColumn("least", F.when(F.col("id") % 50 != 9, F.when(F.col("id") % 3 == 0, near).otherwise(F.col("x") + near)))
    got = noise.at_least(rows, "b", "above", F.col("least"), "nu", "id").collect()
    assert all(r.above == (None if r.least is None else r.x >= r.least) for r in got)
    assert {r.above for r in got} == {True, False, None} and set(got[0].asDict()) == {"id", "b", "x", "least", "above"}
    with pytest.raises(Exception, match="a noise scale without thresholds"):
        noise.at_least(rows.withColumn("b", F.lit(9.0)), "b", "above", F.lit(1 << 40), "nu", "id").collect()


def test_private_draws_are_generated_in_parts(spark, sf):
    """A generated method of over 8,000 bytes is never compiled; a private run had one per draw."""
    from minimus.plans.queries_select import private_chain
    private_chain(spark, sf)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_draws_depend_on_keys_only(spark, noise):
    rows = spark.range(200).select("id", (F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 == 0, 0.2).otherwise(0.025).alias("b"))
    a = dict(noise.draws(rows, "b", "x", "nu", "id", "k").select("id", "x").collect())
    b = dict(noise.draws(rows.repartition(7), "b", "x", "nu", "id", "k").select("id", "x").collect())
    assert a == b
    assert a != dict(noise.draws(rows, "b", "x", "rho", "id", "k").select("id", "x").collect())
    con = duckdb.connect()
    con.register("r", rows.toArrow())
    sql = S.sql_draw(SALT, SCALES["b"], "b", "nu", "id", "k")
    assert dict(con.sql(f"SELECT id, {sql} FROM r").fetchall()) == a


def test_keys_do_not_run_together(spark, noise):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a|b|c", None)], "p string, q string").withColumn("b", F.lit(0.2))
    assert len({r.x for r in noise.draws(rows, "b", "x", "nu", "p", "q").collect()}) == 3


def test_unknown_scale_fails(spark, noise):
    with pytest.raises(Exception, match="without thresholds"):
        noise.draws(spark.range(1).withColumn("b", F.lit(0.3)), "b", "x", "nu", "id").collect()


def test_salt_stays_out_of_plans_and_event_logs(spark, tmp_path):
    """A job of its own with an event log: neither the salt nor the padded keys are in it."""
    key = scratch_path(spark, "log-key")
    S.write_key(spark, key, SALT)
    code = f"""
import sys; sys.path.insert(0, {os.getcwd()!r})
from pyspark.sql import SparkSession, functions as F
from minimus.functions.secret_noise import SecretNoise
s = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
     .config("spark.eventLog.compress", "false").config("spark.eventLog.dir", "file://{tmp_path}").getOrCreate())
df = SecretNoise(s, {key!r}, {SCALES!r}).draws(s.range(50).withColumn("b", F.lit(0.2)), "b", "x", "nu", "id").where("x > -100000")
df.write.format("noop").mode("overwrite").save()
print(df._jdf.queryExecution().toString(), df.collect()[0])
s.stop()
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True).stdout
    logs = b"".join(p.read_bytes() for p in tmp_path.rglob("*") if p.is_file())
    assert b"SparkListenerSQLExecutionStart" in logs and "ubquery" in out
    inner, outer = S.pads(SALT)
    for secret in (SALT, inner, outer):
        for form in (secret, secret.hex().encode(), secret.hex().upper().encode(), secret[:40]):
            assert form not in logs and form.decode("latin-1") not in out
    spaced = " ".join(f"{x:02X}" for x in inner[:8]).encode()
    assert spaced not in logs and spaced.decode() not in out


# ---- accountant

def attempt(spark, rows):
    return spark.createDataFrame(rows, "pid string, level string, attempt int, b_thr double, b double, c_att double, "
                                       "k_att double, knn_att double, n_seg long")


def test_three_attempts_add_up(spark):
    att = attempt(spark, [("p", "low", n, 0.5, 1.0, 0.5, 0.25, 0.25, 8) for n in (1, 2, 3)])
    cost = budget.with_costs(att, "geometric")
    row = budget.compose(budget.steps_of(cost), "pid", "level").first()
    # threshold 2, hits 2*4, top-k 2*2, knn 2*2
    assert (row.n_steps, row.eps_total, row.exact_steps) == (12, Decimal(3 * 18), 0)
    exact = budget.compose(budget.steps_of(budget.with_costs(att, None)), "pid").first()
    assert (exact.eps_total, exact.exact_steps) == (Decimal(3 * 14), 3)
    assert cost.first().rho_q == (10 * 10 // 2 + 4 * 4 // 2 + 4 * 4 // 2) * 10**6
    assert budget.with_costs(att, "gumbel").first().rho_q == (50 + 8 + 1) * 10**6  # k / (2 b b)


def test_running_totals_equal_the_aggregate(spark):
    first = budget.add_spent(budget.with_costs(attempt(spark, [("p", "low", 1, 0.5, 1.0, 0.5, 0.25, 0.25, 8)]), "gumbel"), False)
    second = attempt(spark, [("p", "low", 2, 0.25, 2.0, 0.5, 0.25, 0.25, 8)]).join(
        first.select("pid", *budget.spent_before(first)), "pid")
    second = budget.add_spent(budget.with_costs(second, "gumbel"), True)
    last = second.first()
    both = first.unionByName(second)
    assert last.spent_eps == budget.compose(budget.steps_of(both), "pid").first().eps_total
    assert last.spent_rho_q == both.agg(F.sum("rho_q")).first()[0]


def test_ledger(spark):
    rows = [(c, 1 + c % 2, Decimal(c), 10**6 * c, 0) for c in range(1, 5)]
    df = spark.createDataFrame(rows, "conv long, attempt int, spent_eps decimal(18,6), spent_rho_q long, spent_exact long")
    row = budget.ledger(df.withColumn("all", F.lit(1)), "all").first()
    assert (row.n_prompts, row.n_attempts, row.eps_total, row.rho_total, row.exact_steps) == (4, 6, Decimal(10), Decimal(10), 0)
    assert row.eps_zcdp == round(10 + 2 * math.sqrt(10 * math.log(1e6)), 4)
    assert Counter(budget.ledger(df, "conv").columns) == Counter(
        ["conv", "n_prompts", "n_attempts", "eps_total", "rho_total", "eps_zcdp", "exact_steps"])


def test_no_segments_count_as_one(spark):
    row = budget.with_costs(attempt(spark, [("p", "low", 1, 1.0, 1.0, 0.5, 0.5, 0.5, None)]), "gumbel").first()
    assert (row.eps_hits, row.eps_top_k, row.eps_knn) == (2, 2, 2)


def test_a_draw_can_be_made_for_some_rows_only(spark, noise):
    """The noisy threshold of a prompt is drawn once, not once a segment."""
    rows = spark.range(40).withColumn("b", F.lit(0.2))
    every = {r.id: r.x for r in noise.draws(rows, "b", "x", "nu", "id").collect()}
    some = {r.id: r.x for r in noise.draws(rows, "b", "x", "nu", "id", only=F.col("id") % 4 == 0).collect()}
    assert some == {i: x if i % 4 == 0 else None for i, x in every.items()}
