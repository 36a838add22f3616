"""Discrete noise for private runs: integers only, from a keyed bit stream under a secret salt.

``noise`` draws doubles from a seed that every plan shows. Here a draw is a sum of fair digits:
a geometric variable with ratio q = exp(-1/t) has independent binary digits, digit j being 1
with probability 1 / (1 + exp(2^j / t)). Each digit compares 60 bits of the stream with an
integer threshold; the thresholds come from 60-digit decimals, so no double takes part. The
difference of two geometric draws is a discrete Laplace draw of scale t (in grid units of
1 / ``GRID``); one draw alone is the one-sided noise of permute-and-flip (McKenna and Sheldon
2020), which takes the place of Gumbel noise: the k largest noisy values are a set with
eps 2 k / b, as each selected value passes the others' maximum with a probability that changes
by at most exp(2 / b).

A digit's probability is off by less than 2^-60 and the digits beyond the last one by less
than that together, so a draw of 2 x 16 digits differs from the exact law by less than
2^-54 in total variation.

The stream is HMAC-SHA256 over (purpose, keys, block), keys written with their lengths so that
no two lists of keys are the same message. It is a pure function of the salt and the keys: a
retried task, another partitioning or another engine draws the same numbers. The salt is a
32-byte file that ``write_key`` turns into the two padded keys of the HMAC; jobs read them from
that file into a scalar subquery, so plans and event logs show the file's path, never its content.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Grid units of one: scores, thresholds and distances become floor(GRID * x).
GRID = 4096
DIGIT_BITS = 60
#: Bits of the stream in one block, as hexadecimal digits: four 60-bit numbers.
PER_BLOCK = 4
HEX = 15


def thresholds(scale: str) -> list[int]:
    """The integer thresholds of the digits of a geometric draw of ``scale`` (a decimal)."""
    getcontext().prec = 60
    t = Decimal(scale) * GRID
    if t <= 0:
        raise ValueError("a scale must be above 0")
    one = Decimal(1 << DIGIT_BITS)
    out: list[int] = []
    while not out or out[-1] > 0:
        x = Decimal(1 << len(out)) / t
        out.append(int(one / (1 + x.exp())) if x < 200 else 0)
    return out[:-1] or [0]


def pads(salt: bytes) -> tuple[bytes, bytes]:
    """Inner and outer padded key of HMAC-SHA256."""
    key = (hashlib.sha256(salt).digest() if len(salt) > 64 else salt).ljust(64, b"\0")
    return bytes(x ^ 0x36 for x in key), bytes(x ^ 0x5C for x in key)


KEY_SCHEMA = T.StructType([T.StructField("inner", T.BinaryType(), False), T.StructField("outer", T.BinaryType(), False)])


def write_key(spark: SparkSession, path: str, salt: bytes) -> None:
    """Write the key file of a salt (at least 32 random bytes, kept from the jobs' readers)."""
    if len(salt) < 32:
        raise ValueError("a salt needs 32 bytes")
    inner, outer = pads(salt)
    spark.createDataFrame([(bytearray(inner), bytearray(outer))], KEY_SCHEMA).coalesce(1).write.parquet(path)


class SecretNoise:
    """Draws under the key file at ``path``. ``scales`` maps a name to the decimal scales that
    rows may have under it: {"b": ["0.05", "0.1"]}; a row's own is in the column of that name."""

    #: What ``budget`` calls the noise of top-k under this class.
    top_noise = "geometric"

    def __init__(self, spark: SparkSession, path: str, scales: dict[str, list[str]]):
        key = spark.read.schema(KEY_SCHEMA).parquet(path)
        self.inner = key.select("inner").scalar()
        self.outer = key.select("outer").scalar()
        self.scales = {n: sorted(set(x)) for n, x in scales.items()}
        self.digits = {s: thresholds(s) for x in self.scales.values() for s in x}

    def _mac(self, message: Column) -> Column:
        first = F.unhex(F.sha2(F.concat(self.inner, message.cast("binary")), 256))
        return F.sha2(F.concat(self.outer, first), 256)

    def value(self, c: Column) -> Column:
        """A score on the grid, as an integer."""
        return F.floor(c * F.lit(GRID)).cast("bigint")

    def _digit_limits(self, name: str) -> Column:
        """The thresholds of the row's scale; an unknown scale has none and fails the job."""
        out = None
        for s in self.scales[name]:
            limits = F.array(*[F.lit(f"{x:0{HEX}x}") for x in self.digits[s]])
            hit = F.col(name) == F.lit(float(s))
            out = F.when(hit, limits) if out is None else out.when(hit, limits)
        return out.otherwise(F.raise_error(F.lit("a noise scale without thresholds")).cast("array<string>"))

    def draws(self, rows: DataFrame, name: str, out: str, purpose: str, *keys: str, two_sided: bool = True,
              only: Column | None = None) -> DataFrame:
        """``rows`` with a draw of the scale in column ``name``, as bigint column ``out``. Rows that
        are not ``only`` get none (null), and no hash runs for them.

        Numbers and thresholds are compared as hexadecimal digits of one width."""
        n = max(len(self.digits[s]) for s in self.scales[name])
        need = n * (2 if two_sided else 1)
        message = F.concat(*[_field(F.lit(purpose))] + [_field(F.col(k).cast("string")) for k in keys])
        blocks = [f"__mac{i}" for i in range(-(-need // PER_BLOCK))]
        macs = [self._mac(F.concat("__msg", F.lit(str(i)))) for i in range(len(blocks))]
        if only is not None:
            macs = [F.when(only, x) for x in macs]
        df = rows.withColumn("__msg", message).withColumn("__limits", self._digit_limits(name))
        df = df.select("*", *[x.alias(c) for x, c in zip(macs, blocks, strict=True)])
        zero = F.lit(0).cast("bigint")
        total = zero
        for i in range(need):
            number = F.substring(blocks[i // PER_BLOCK], 1 + HEX * (i % PER_BLOCK), HEX)
            worth = F.lit((-1 if i >= n else 1) << (i % n)).cast("bigint")
            total = total + F.when(number < F.get("__limits", F.lit(i % n)), worth).otherwise(zero)
        if only is not None:
            total = F.when(only, total)
        return df.withColumn(out, total).drop("__msg", "__limits", *blocks)


    def at_least(self, rows: DataFrame, name: str, out: str, least: Column, purpose: str, *keys: str) -> DataFrame:
        """``rows`` with a boolean column ``out``: whether the two-sided draw of ``draws`` is ``least`` or more.

        Digits are read from the highest down, as many to a step as a block holds; a step's hashes
        run for the rows only that the digits below could still turn. The answer is that of the whole draw."""
        n = max(len(self.digits[s]) for s in self.scales[name])
        message = F.concat(*[_field(F.lit(purpose))] + [_field(F.col(k).cast("string")) for k in keys])
        df = rows.withColumn("__msg", message).withColumn("__limits", self._digit_limits(name)).withColumn("__least", least)
        zero = F.lit(0).cast("bigint")
        # reads the limits of every row, so that an unknown scale fails the job
        df = df.withColumn("__sum", F.when(F.size("__limits") > 0, zero))
        made: set[str] = set()
        for low in reversed(range(0, n, PER_BLOCK)):
            places = [(i, 1 << i) for i in range(low, min(n, low + PER_BLOCK))]
            places += [(n + i, -worth) for i, worth in places]
            rest = (1 << min(n, low + PER_BLOCK)) - 1  # what the digits from here on can add or take
            gap = F.col("__least") - F.col("__sum")
            open_ = (gap > -rest) & (gap <= rest) & (F.size("__limits") > low)
            blocks = {i: f"__mac{i}" for i in sorted({place // PER_BLOCK for place, _ in places})}
            macs = {c: self._mac(F.concat("__msg", F.lit(str(i)))) for i, c in blocks.items()}
            # a block that the step before has read in part serves again where it was hashed
            macs = {c: F.when(F.col("__open"), F.coalesce(F.col(c), x) if c in made else x) for c, x in macs.items()}
            df = df.withColumn("__open", open_).withColumns(macs)
            made |= set(macs)
            step = zero
            for place, worth in places:
                number = F.substring(blocks[place // PER_BLOCK], 1 + HEX * (place % PER_BLOCK), HEX)
                step = step + F.when(number < F.get("__limits", F.lit(place % n)), F.lit(worth).cast("bigint")).otherwise(zero)
            df = df.withColumn("__sum", F.col("__sum") + F.when(F.col("__open"), step).otherwise(zero))
        return (df.withColumn(out, F.col("__sum") >= F.col("__least"))
                .drop("__msg", "__limits", "__least", "__sum", "__open", *made))


def _field(c: Column) -> Column:
    """A key with its length before it (null: a mark of its own)."""
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))


# ---- the same draw in DuckDB SQL, under a test salt --------------------------

def sql_value(e: str) -> str:
    return f"CAST(floor(({e}) * {GRID}) AS BIGINT)"


def sql_draw(salt: bytes, scales: list[str], name: str, purpose: str, *keys: str, two_sided: bool = True) -> str:
    inner, outer = (x.hex() for x in pads(salt))
    digits = {s: thresholds(s) for s in sorted(set(scales))}
    n = max(map(len, digits.values()))
    need = n * (2 if two_sided else 1)

    def field(e: str) -> str:
        return f"coalesce(length({e})::VARCHAR || ':' || {e}, '-')"

    message = " || ".join([field(f"'{purpose}'")] + [field(f"CAST({k} AS VARCHAR)") for k in keys])
    limits = "CASE " + " ".join(f"WHEN {name} = CAST({float(s)!r} AS DOUBLE) THEN {x!r}::BIGINT[]" for s, x in digits.items()) + " END"

    def mac(i: int) -> str:
        return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(m || '{i}'))))"

    macs = "[" + ", ".join(mac(i) for i in range(-(-need // PER_BLOCK))) + "]"
    # h: the blocks, l: the thresholds; one number per digit
    number = f"('0x' || substr(h[i // {PER_BLOCK} + 1], 1 + {HEX} * (i % {PER_BLOCK}), {HEX}))::BIGINT"
    each = (f"list_sum(list_transform(range({need}), lambda i: CASE WHEN {number} < coalesce(l[i % {n} + 1], 0) "
            f"THEN (CASE WHEN i >= {n} THEN -1 ELSE 1 END) * (1::BIGINT << (i % {n})) ELSE 0 END))::BIGINT")
    return f"(SELECT {each} FROM (SELECT {macs} AS h, l FROM (SELECT {message} AS m, {limits} AS l)))"


def standard_deviation(scale: str) -> float:
    """Of the discrete Laplace draw, in grid units (for tests)."""
    q = math.exp(-1 / (float(scale) * GRID))
    return math.sqrt(2 * q) / (1 - q)
