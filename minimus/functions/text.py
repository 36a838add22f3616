"""Pure Column functions for text (shared by batch and streaming jobs).

All patterns use only the regex syntax that Java (Spark) and RE2 share, so the
same expression can be checked against DuckDB: no ``\\b``, no look-around,
code points spelled ``\\x{..}``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters JavaScript's String.prototype.trim removes
# (WhiteSpace + LineTerminator of ECMA-262): TAB, LF, VT, FF, CR, SPACE, NBSP,
# U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000, U+FEFF.
JS_WS_CLASS = (r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]")
JS_TRIM_PATTERN = rf"\A{JS_WS_CLASS}+|{JS_WS_CLASS}+\z"
# The same set as plain characters, for Spark's character-set trim.
JS_WS_CHARS = ("\t\n\x0b\f\r \xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000\ufeff")

# Clean-up patterns (our preprocessing definition).
JUNK_RUN = r"[#$%&*]{2,}"          # runs such as ###, $$$, %%%, &&&, ***
BANG_RUN = r"!{2,}"                # !! and longer -> !
HSPACE_RUN = r"[\t\f\x{0B} \x{A0}]+"  # horizontal blanks -> one space
SPACE_AROUND_NL = r" ?\n ?"        # after collapsing: at most one each side
# Same effect as the two rules above, written so that text already in shape
# (single spaces, bare newlines) is not matched at all: the regex engine then
# scans without rewriting every word boundary.
HSPACE_FIX = r"[\t\f\x{0B}\x{A0}][\t\f\x{0B} \x{A0}]*| [\t\f\x{0B} \x{A0}]+"
NL_FIX = r" \n ?|\n "

LETTERS = r"\p{L}+"                # token definition
SEGMENT = r"[^.!?\n]+[.!?]?"       # sentence-ish segment


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """Trim exactly like JS ``String.trim``. Plain ``F.trim(c)`` strips
    only U+0020; the character-set form strips the whole JS set (the regex
    form of the same thing, ``JS_TRIM_PATTERN``, is what the SQL oracle uses)."""
    return F.trim(col_of(c), F.lit(JS_WS_CHARS))


def is_blank(c) -> Column:
    """O07 predicate: true when nothing is left after a JS trim."""
    return js_trim(c) == F.lit("")


def words(c) -> Column:
    """JS ``text.split(" ")`` -- one space, empty words kept, '' -> ['']."""
    return F.split(col_of(c), " ", -1)


def word_count(c) -> Column:
    return F.size(words(c))


def clock(c) -> Column:
    """24 h ``HH:mm:ss`` (en-GB, two digits each) of a wall-clock timestamp."""
    return F.date_format(col_of(c), "HH:mm:ss")


def clean_text(c) -> Column:
    """Drop junk punctuation runs, collapse blanks, keep newlines, JS-trim."""
    t = F.regexp_replace(col_of(c), JUNK_RUN, "")
    t = F.regexp_replace(t, BANG_RUN, "!")
    t = F.regexp_replace(t, HSPACE_FIX, " ")
    t = F.regexp_replace(t, NL_FIX, "\n")
    return js_trim(t)


def tokens(c) -> Column:
    """Lower-cased letter runs (the token definition of SURVEY §2.12)."""
    return F.regexp_extract_all(F.lower(col_of(c)), F.lit(LETTERS), 0)


def distinct_tokens(c) -> Column:
    return F.array_distinct(tokens(c))


def segment_array(c) -> Column:
    """O43 helper: the raw segments of a text, in order."""
    return F.regexp_extract_all(col_of(c), F.lit(SEGMENT), 0)


def epoch_millis_ntz(c) -> Column:
    """Milliseconds since 1970 of a TIMESTAMP_NTZ, independent of session zone."""
    return F.timestamp_diff("MILLISECOND",
                            F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            col_of(c))


# ---- The same functions in DuckDB SQL (for the oracle; RE2 needs the 'g' flag
# to replace every match). Arguments and results are SQL expressions.

def sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_js_trim(e: str) -> str:
    return f"regexp_replace({e}, {sql_lit(JS_TRIM_PATTERN)}, '', 'g')"


def sql_clean_text(e: str) -> str:
    t = f"regexp_replace({e}, {sql_lit(JUNK_RUN)}, '', 'g')"
    t = f"regexp_replace({t}, {sql_lit(BANG_RUN)}, '!', 'g')"
    t = f"regexp_replace({t}, {sql_lit(HSPACE_RUN)}, ' ', 'g')"
    t = f"regexp_replace({t}, {sql_lit(SPACE_AROUND_NL)}, chr(10), 'g')"
    return sql_js_trim(t)


def sql_tokens(e: str) -> str:
    return f"regexp_extract_all(lower({e}), {sql_lit(LETTERS)})"


def sql_distinct_tokens(e: str) -> str:
    return f"list_distinct({sql_tokens(e)})"


def sql_word_count(e: str) -> str:
    return f"len(string_split({e}, ' '))"


def sql_clock(e: str) -> str:
    return f"strftime({e}, '%H:%M:%S')"


def sql_segment_array(e: str) -> str:
    return f"regexp_extract_all({e}, {sql_lit(SEGMENT)})"
