"""Text helpers whose results do not depend on a regex engine's idea of a word.

Java's plain classes are ASCII only, so white space, words and word borders are
spelled out here once and used everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode sees it, inside a character class.
WS = r"\s\p{Z}\x1c-\x1f\x85"
#: Word characters, inside a character class.
WORD = r"\p{L}\p{N}_"
#: No word character before, none after.
NOT_IN_WORD = rf"(?<![{WORD}])"
WORD_ENDS = rf"(?![{WORD}])"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """The text without white space of any kind at both ends."""
    # White space at the end is tried only where a run of it begins, so long runs inside cost no more than their length.
    return F.regexp_replace(col(x), rf"^[{WS}]+|(?<![{WS}])[{WS}]+$", "")


def unix_lines(x: Column | str) -> Column:
    """Line ends of all systems as one, stripped."""
    return strip(F.regexp_replace(col(x), r"\r\n?", "\n"))


def filled(x: Column | str) -> Column:
    """Null for an empty text."""
    return F.nullif(col(x), F.lit(""))


def best_text(*columns: Column | str) -> Column:
    """The first text that is neither null nor empty; null if there is none."""
    return F.coalesce(*(filled(c) for c in columns))


def word_count(x: Column | str) -> Column:
    """Runs of non-white characters; null gives 0."""
    return F.coalesce(F.regexp_count(col(x), F.lit(rf"[^{WS}]+")), F.lit(0))


def preview(x: Column | str, most: int = 120) -> Column:
    """The first characters, with dots if more follow."""
    c = col(x)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def has_text(x: Column | str) -> Column:
    return F.coalesce(F.length(strip(x)) > 0, F.lit(False))


def joined_in_order(items: Column, separator: str) -> Column:
    """Texts of an array of (order, text) structs, joined in their order; null texts are left out."""
    return F.array_join(F.transform(F.array_sort(items), lambda s: s["text"]), separator)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
