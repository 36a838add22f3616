"""O42 PII / secret masking by class and privacy level (pure Column functions).

Classes are applied in a fixed order; placeholders contain no digit and no dot,
so masking twice changes nothing and sentence segmentation stays safe.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of

# Class patterns (ours, SURVEY §2.12) in Java/RE2-common syntax,
# in application order, with their placeholders.
SECRET = r'token = "[0-9a-f]{16,}"'
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
CARD = r"[0-9]{13,}"
PHONE = r"[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}"
IPV4 = r"(?:[0-9]{1,3}[.]){3}[0-9]{1,3}"
NUMBER = r"[0-9]{4,}"
# Digit runs long enough for a card, shorter ones, and what stands between them;
# a card is decided on a whole run and put back in its place.
RUNS = r"[0-9]{13,}|[0-9]{1,12}|[^0-9]+"
MIN_CARD, MAX_CARD = 13, 19

PLACEHOLDER = {
    "secret": "<SECRET>",
    "email": "<EMAIL>",
    "card": "<CARD>",
    "phone": "<PHONE>",
    "ip": "<IP>",
    "number": "<NUM>",
}
# What masking leaves in a text; never a word of a vocabulary or of a typo fix.
PLACEHOLDER_RE = "<(?:" + "|".join(p.strip("<>") for p in PLACEHOLDER.values()) + ")>"


# A cheap test that must hold for a class pattern to match at all. Regexes
# only run on texts that pass it (most texts hold no PII at all). It is applied
# to the *original* text: masking never adds an '@', a digit or these literals,
# so a text without them cannot gain a match later in the chain -- and guarding
# on the original keeps the partially masked text out of the CASE condition.
def _may_match(t: Column, cls: str) -> Column:
    if cls == "secret":
        return F.instr(t, 'token = "') > 0
    if cls == "email":
        return F.instr(t, "@") > 0
    if cls == "phone":
        return F.instr(t, "+1 (") > 0
    return F.regexp_like(t, F.lit("[0-9]"))


PATTERN = {
    "secret": SECRET,
    "email": EMAIL,
    "card": CARD,
    "phone": PHONE,
    "ip": IPV4,
    "number": NUMBER,
}
CLASS_ORDER = ("secret", "email", "card", "phone", "ip", "number")

# Classes masked per level. low masks only Luhn-valid cards (13 to 19
# digits); medium every run of 13+ digits plus IPv4; high also every run of 4+ digits.
LEVELS = ("low", "medium", "high")
LEVEL_CLASSES = {
    "low": ("secret", "email", "card_luhn", "phone"),
    "medium": ("secret", "email", "card", "phone", "ip"),
    "high": ("secret", "email", "card", "phone", "ip", "number"),
}


def luhn_ok(x: Column) -> Column:
    """A whole digit run that can be a card number."""
    return F.when(F.length(x).between(MIN_CARD, MAX_CARD),
                  F.call_function("luhn_check", x)).otherwise(F.lit(False))


def _let(value: Column, fn) -> Column:
    """fn(value) with ``value`` written once in the expression, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), 0)


def _mask_luhn_cards(t: Column, orig: Column) -> Column:
    pieces = F.transform(
        F.regexp_extract_all(t, F.lit(RUNS), 0),
        lambda x: F.when(F.regexp_like(x, F.lit(r"\A[0-9]{13,}\z")) & luhn_ok(x),
                         F.lit(PLACEHOLDER["card"])).otherwise(x))
    return F.when(_may_match(orig, "card"), F.array_join(pieces, "")).otherwise(t)


def _sub(t: Column, cls: str, orig: Column | None = None) -> Column:
    guard = _may_match(t if orig is None else orig, cls)
    return F.when(guard, F.regexp_replace(t, PATTERN[cls], PLACEHOLDER[cls])).otherwise(t)


def mask_pii(c, level) -> Column:
    """Mask ``c`` at ``level``: one of 'low' / 'medium' / 'high' (a literal;
    Catalyst then folds the CASE branches away), or a column name / Column
    holding the level per row. A missing or unknown level masks like 'high'.
    """
    lv = F.lit(level) if level in LEVELS else col_of(level)

    def mask(o: Column) -> Column:
        t = _let(_sub(o, "secret", o), lambda x: _sub(x, "email", o))
        t = _let(t, lambda x: F.when(lv == "low", _mask_luhn_cards(x, o)).otherwise(_sub(x, "card", o)))
        t = _let(t, lambda x: _sub(x, "phone", o))
        t = _let(t, lambda x: F.when(lv == "low", x).otherwise(_sub(x, "ip", o)))
        return _let(t, lambda x: F.when(lv.isin("low", "medium"), x).otherwise(_sub(x, "number", o)))

    return _let(col_of(c), mask)


def vocabulary_text(c) -> Column:
    """What vocabularies are built from: the text masked at 'high', placeholders left
    out, so that no part of a secret becomes a token."""
    return without_placeholders(mask_pii(c, "high"))


def without_placeholders(c) -> Column:
    """A masked text without its placeholders. Levels differ in what they mask of digits
    only, so that its letter runs are those of ``vocabulary_text`` whatever the level was."""
    return F.regexp_replace(col_of(c), PLACEHOLDER_RE, " ")


def class_counts(c) -> list[tuple[str, Column]]:
    """O26 helper: matches per class, each counted on the text left after the
    classes before it were masked (the high-level order); card split by Luhn."""
    o = col_of(c)
    t = o
    out = []
    for cls in CLASS_ORDER:
        found = F.regexp_extract_all(t, F.lit(PATTERN[cls]), 0)
        zero = F.lit(0)
        may = _may_match(o, cls)
        if cls == "card":
            out.append(("card_luhn", F.when(may, F.size(F.filter(found, luhn_ok))).otherwise(zero)))
            out.append(("card_other", F.when(may, F.size(
                F.filter(found, lambda x: ~luhn_ok(x)))).otherwise(zero)))
        else:
            out.append((cls, F.when(may, F.size(found)).otherwise(zero)))
        t = _sub(t, cls, o)
    return out


# ---- DuckDB SQL spelling of the same masking (oracle only).

def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_luhn_ok(x: str) -> str:
    d = f"CAST(substr({x}, i + 1, 1) AS INTEGER)"
    term = (f"CASE WHEN (length({x}) - 1 - i) % 2 = 1 "
            f"THEN (CASE WHEN 2 * {d} > 9 THEN 2 * {d} - 9 ELSE 2 * {d} END) ELSE {d} END")
    return (f"(length({x}) BETWEEN {MIN_CARD} AND {MAX_CARD} AND "
            f"list_sum(list_transform(range(length({x})), lambda i: {term})) % 10 = 0)")


def _sql_sub(t: str, cls: str) -> str:
    return f"regexp_replace({t}, {_sql_lit(PATTERN[cls])}, {_sql_lit(PLACEHOLDER[cls])}, 'g')"


def sql_mask_pii(e: str, level: str) -> str:
    """``level`` is a SQL expression (a column or a quoted literal)."""
    t = _sql_sub(_sql_sub(e, "secret"), "email")
    if level == "'high'":
        for cls in ("card", "phone", "ip", "number"):
            t = _sql_sub(t, cls)
        return t
    runs = f"regexp_extract_all({t}, {_sql_lit(RUNS)})"
    luhn = (f"array_to_string(list_transform({runs}, lambda x: CASE WHEN regexp_full_match(x, '[0-9]{{13,}}') "
            f"THEN (CASE WHEN {sql_luhn_ok('x')} THEN '<CARD>' ELSE x END) ELSE x END), '')")
    t = f"(CASE WHEN {level} = 'low' THEN {luhn} ELSE {_sql_sub(t, 'card')} END)"
    t = _sql_sub(t, "phone")
    t = f"(CASE WHEN {level} = 'low' THEN {t} ELSE {_sql_sub(t, 'ip')} END)"
    return f"(CASE WHEN {level} IN ('low', 'medium') THEN {t} ELSE {_sql_sub(t, 'number')} END)"


def sql_vocabulary_text(e: str) -> str:
    return f"regexp_replace({sql_mask_pii(e, repr('high'))}, {_sql_lit(PLACEHOLDER_RE)}, ' ', 'g')"


def sql_class_counts(e: str) -> list[tuple[str, str]]:
    t = e
    out = []
    for cls in CLASS_ORDER:
        found = f"regexp_extract_all({t}, {_sql_lit(PATTERN[cls])})"
        if cls == "card":
            out.append(("card_luhn", f"len(list_filter({found}, lambda x: {sql_luhn_ok('x')}))"))
            out.append(("card_other", f"len(list_filter({found}, lambda x: NOT {sql_luhn_ok('x')}))"))
        else:
            out.append((cls, f"len({found})"))
        t = _sql_sub(t, cls)
    return out
