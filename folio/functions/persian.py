"""Persian orthography and typography as native column expressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folio.functions.text import NOT_IN_WORD, WORD_ENDS, WS, col, let

ZWNJ = "‌"
# Fixed values.
LATIN_DIGITS = "0123456789"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
#: Letters of the Arabic alphabet and what Persian writes instead.
ARABIC_LETTERS = ("يىكؤإأة", "ییکوااه")
HEH_WITH_YEH = ("ۀ", "هٔ")
TATWEEL = "ـ"
DIACRITICS = "ًٌٍَُِّْٰ"
LETTER = r"[\x{0621}-\x{06CC}]"
BE_WORDS = ("عنوان", "گونه‌ای", "طوری", "اصطلاح", "طور", "ویژه", "راحتی", "سادگی", "خودی", "مراتب", "شدت", "ندرت", "تنهایی")
SUFFIXES = ("هایشان", "هایتان", "هایمان", "هایش", "هایت", "هایم", "هایی", "های", "ترین", "تر", "ها")
POSSESSIVES = ("مان", "تان", "شان", "ام", "ات", "اش")


def persian_digits(x: Column | str) -> Column:
    return F.translate(col(x), LATIN_DIGITS + ARABIC_DIGITS, PERSIAN_DIGITS * 2)


def latin_digits(x: Column | str) -> Column:
    return F.translate(col(x), PERSIAN_DIGITS + ARABIC_DIGITS, LATIN_DIGITS * 2)


def persian_letters(x: Column | str) -> Column:
    return F.replace(F.translate(col(x), *ARABIC_LETTERS), F.lit(HEH_WITH_YEH[0]), F.lit(HEH_WITH_YEH[1]))


def without_tatweel(x: Column | str) -> Column:
    return F.replace(col(x), F.lit(TATWEEL), F.lit(""))


def without_diacritics(x: Column | str) -> Column:
    return F.translate(col(x), DIACRITICS, "")


def joined_verbs(x: Column | str) -> Column:
    """A non-joiner between the prefixes mi, nemi and the verb."""
    return F.regexp_replace(col(x), rf"{NOT_IN_WORD}(ن?می)[{WS}]+({LETTER}{{2,}})", f"$1{ZWNJ}$2")


def joined_prefixes(x: Column | str) -> Column:
    """A non-joiner after be before listed words, and after bi before any word."""
    words = F.regexp_replace(col(x), rf"{NOT_IN_WORD}(به)[{WS}]+({'|'.join(BE_WORDS)}){WORD_ENDS}", f"$1{ZWNJ}$2")
    return F.regexp_replace(words, rf"{NOT_IN_WORD}(بی)[{WS}]+({LETTER}{{2,}}){WORD_ENDS}", f"$1{ZWNJ}$2")


def joined_suffixes(x: Column | str) -> Column:
    """A non-joiner before endings of plural and comparison."""
    return F.regexp_replace(col(x), rf"({LETTER}+)[{WS}]+({'|'.join(SUFFIXES)}){WORD_ENDS}", f"$1{ZWNJ}$2")


def joined_possessives(x: Column | str) -> Column:
    """A non-joiner before possessive endings of words that end in heh."""
    return F.regexp_replace(col(x), rf"({LETTER}+[هة])[{WS}]+({'|'.join(POSSESSIVES)}){WORD_ENDS}", f"$1{ZWNJ}$2")


def persian_quotes(x: Column | str) -> Column:
    """Straight quotes in turn as opening and closing guillemets; a single one stays."""

    def turned(text: Column) -> Column:
        parts = F.split(text, '"', -1)
        marked = F.transform(parts, lambda p, k: F.when(k == 0, p).when(k % 2 == 1, F.concat(F.lit("«"), p)).otherwise(F.concat(F.lit("»"), p)))
        return F.when(F.regexp_count(text, F.lit('"')) > 1, F.array_join(marked, "")).otherwise(text)

    return let(col(x), turned)


def persian_punctuation(x: Column | str) -> Column:
    """Question marks, semicolons, commas beside Persian letters, em dashes (with blanks around) and quotes in Persian form."""
    marks = F.translate(col(x), "?;", "؟؛")
    after = F.regexp_replace(marks, rf"({LETTER})[{WS}]*,[{WS}]*", "$1، ")
    before = F.regexp_replace(after, rf",[{WS}]*({LETTER})", "، $1")
    return persian_quotes(F.regexp_replace(before, r"(?:(?<![ \t])[ \t]+)?—[ \t]*", "، "))


def punctuation_spacing(x: Column | str) -> Column:
    """No blank before marks, one after them unless a mark, digit, closer or Markdown sign follows; runs of blanks become one."""
    # A run of blanks is tried from its begin only.
    close = F.regexp_replace(col(x), r"(?<![ \t])[ \t]+([،؛؟!.:])", "$1")
    spaced = F.regexp_replace(close, rf"""([،؛؟!:])(?=[^{WS}\p{{Nd}}،؛؟!:.)\]}}»"'/*_`~])""", "$1 ")
    return F.regexp_replace(spaced, r"[ \t]{2,}", " ")


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Canonical composition (NFC), which Spark has no function for."""
    return texts.str.normalize("NFC")


def composed_where_needed(x: Column | str) -> Column:
    """NFC for texts with a combining mark; others are composed already and stay out of Python."""
    c = col(x)
    # Spark calls the function for all rows whatever the branch, so the others are sent as null.
    return F.coalesce(composed(F.when(c.rlike(r"\p{M}"), c)), c)


#: Steps of the clean-up in their order; each relies on the ones before.
STEPS = (persian_letters, without_tatweel, joined_verbs, joined_prefixes, joined_suffixes, joined_possessives, persian_punctuation, punctuation_spacing)


def clean_prose(x: Column | str) -> Column:
    """All rules for Persian prose, without composition (see ``composed_where_needed``); null stays null."""
    return reduce(lambda c, step: step(c), STEPS, col(x))
