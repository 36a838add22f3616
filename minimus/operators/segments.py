"""Segments of a prompt: O43 split, O32 repeats, O44 filler, O45 rebuild.

A prompt table has ``pid`` (string key), ``lang``, ``text`` and ``level``.
Segment rows are keyed by (pid, level, pos); pos is the 0-based position of the
segment in the masked text, so it also gives the rebuild order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_of, tokens
from .policy import filler_map

# Fixed value: what a segment is compared by when dropping repeats -- lower
# case, every run of characters other than letters, digits and the placeholder
# brackets collapsed to one space, trimmed.
NORM_DROP = r"[^\p{L}\p{N}<>]+"


def norm_segment(seg) -> Column:
    return F.trim(F.regexp_replace(F.lower(col_of(seg)), NORM_DROP, " "))


def drop_repeats(segs: DataFrame, keys=("pid", "lang", "level")) -> DataFrame:
    """Keep the first (lowest pos) of equal normalised segments per prompt.
    An aggregate rather than a window: map-side partial aggregation collapses a
    prompt that repeats one line many times before anything is shuffled."""
    firsts = (segs.withColumn("norm", norm_segment("seg"))
                  .groupBy(*keys, "norm")
                  .agg(F.min(F.struct("pos", "seg")).alias("m")))
    return firsts.select(*keys, "m.pos", "m.seg")


def content_tokens(seg, lang) -> Column:
    """Distinct tokens of a segment without the language's filler words."""
    # array_except keeps first occurrences in order and drops duplicates, i.e.
    # distinct tokens minus fillers -- without a per-token lambda
    return F.array_except(tokens(seg), fillers(lang))


def fillers(lang) -> Column:
    """The filler words of a language (none for an unknown one)."""
    return F.coalesce(F.try_element_at(filler_map(), col_of(lang)), F.array().cast("array<string>"))


def strip_filler(text, lang) -> Column:
    """O44 on the text itself: filler words removed, blanks collapsed."""
    from .typos import PIECES
    fill = fillers(lang)
    kept = F.filter(F.regexp_extract_all(col_of(text), F.lit(PIECES), 0),
                    lambda p: ~F.array_contains(fill, F.lower(p)))
    return F.trim(F.regexp_replace(F.array_join(kept, ""), " {2,}", " "))


def rebuild(kept: DataFrame, keys=("pid", "level"), out: str = "simplified") -> DataFrame:
    """Kept segments back in original order, joined by one space.
    One group per prompt; its size is bounded by the prompt itself."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "seg")))
    return kept.groupBy(*keys).agg(
        F.array_join(F.transform(parts, lambda x: x["seg"]), " ").alias(out),
        F.count(F.lit(1)).alias("n_kept"))
