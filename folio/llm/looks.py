"""One form for texts that look the same.

Two texts get the same form if a reader sees the same: width, kind of space and
invisible characters do not matter, nor does the way an accent is encoded, nor
letters of other scripts or code blocks that have the very same glyph. Case,
accents, digits, marks, spaces and the joins between letters do matter: a
zero-width non-joiner is dropped where its neighbours would not join anyway and
kept where it shows.

DuckDB runs inside each Arrow partition; the whole mapping is one SQL expression
of ``translate``, ``nfc_normalize`` and ``regexp_replace`` (RE2 has no lookaround,
so rules that look at a neighbour capture it and run twice).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.store import spread

# Fixed values.
#: Never seen, whatever the neighbours: soft hyphen, directional and other format characters, variation selectors.
INVISIBLE = r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E0FFF}"
#: Spaces of one kind or another.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Letters of other scripts with the glyph of a Latin letter.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "ϳ": "j",
    "Ͻ": "Ɔ", "Ё": "Ë", "ё": "ë", "Ї": "Ï", "ї": "ï",
}
#: Arabic-Indic digits with the glyph of the Persian digit; 4, 5 and 6 look different.
DIGITS = ("٠١٢٣٧٨٩", "۰۱۲۳۷۸۹")
#: Arabic letters that never join, and those that join only the letter before; all others join both.
JOIN_NONE = "ءٴۥۦ"
JOIN_BEFORE = "آأؤإاةدذرزوٱٲٳٵٶٷڈډڊڋڌڍڎڏڐڑڒړڔڕږڗژڙۀۃۄۅۆۇۈۉۊۋۍۏےۓەۮۯ"
#: Marks that neither join nor keep letters from joining.
MARKS = r"\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E4}\x{06E7}\x{06E8}\x{06EA}-\x{06ED}"
NON_JOINER, JOINER = "\u200c", "\u200d"
#: Stand for a kept non-joiner and a kept joiner while the others are dropped; noncharacters, which no text may hold.
KEPT = ("\ufdd0", "\ufdd1")


def arabic_letters() -> str:
    return "".join(c for c in map(chr, (*range(0x0620, 0x06FF), *range(0x0750, 0x0780))) if unicodedata.category(c) in ("Lo", "Lm"))


@lru_cache(maxsize=1)
def classes() -> tuple[str, str]:
    """Classes of Arabic letters: those that join the letter after, those that join the letter before."""
    letters = [c for c in arabic_letters() if c not in JOIN_NONE]
    return "".join(c for c in letters if c not in JOIN_BEFORE), "".join(letters)


@lru_cache(maxsize=1)
def wide_forms() -> dict[str, str]:
    """Characters that differ from another one only in width (from Unicode's compatibility tags)."""
    table = {}
    for c in map(chr, (*range(0xFF01, 0xFFF0),)):
        tag, _, rest = unicodedata.decomposition(c).partition(" ")
        if tag in ("<wide>", "<narrow>") and " " not in rest:
            table[c] = chr(int(rest, 16))
    return table


@lru_cache(maxsize=1)
def shaped_forms() -> dict[str, str]:
    """Presentation forms as letters, with non-joiners where the glyph has no join."""
    table = {}
    for c in map(chr, (*range(0xFB50, 0xFE00), *range(0xFE70, 0xFEFD))):
        tag, _, rest = unicodedata.decomposition(c).partition(" ")
        if tag not in ("<isolated>", "<final>", "<initial>", "<medial>") or "0020" in rest.split():
            continue
        letters = "".join(chr(int(x, 16)) for x in rest.split())
        if len(letters) > 2 or (len(letters) == 2 and "ل" != letters[0]):
            continue
        table[c] = (NON_JOINER if tag in ("<isolated>", "<initial>") else "") + letters + (NON_JOINER if tag in ("<isolated>", "<final>") else "")
    return table


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache(maxsize=1)
def steps() -> tuple[str, ...]:
    """The SQL expressions that lead to the form, one after the other; § stands for the column."""
    forward, backward = classes()
    one = wide_forms() | LOOK_ALIKES | dict(zip(*DIGITS, strict=True)) | {c: " " for c in SPACES}
    shaped = "§"
    for c, letters in shaped_forms().items():
        shaped = f"replace({shaped}, {quoted(c)}, {quoted(letters)})"
    keep = f"'([{forward}][{MARKS}]*){NON_JOINER}+([{backward}])', '\\1{KEPT[0]}\\2', 'g'"
    show = f"'([{forward}][{MARKS}]*){JOINER}+([^{backward}{JOINER}]|$)', '\\1{KEPT[1]}\\2', 'g'"
    found = [
        f"regexp_replace(§, '[{INVISIBLE}]+', '', 'g')",
        r"CASE WHEN contains(§, chr(13)) THEN regexp_replace(§, '\r\n?', chr(10), 'g') ELSE § END",
        f"translate(§, {quoted(''.join(one))}, {quoted(''.join(one.values()))})",
        # Presentation forms are rare, so one test keeps most texts from the long chain.
        f"CASE WHEN regexp_matches(§, '[\\x{{FB50}}-\\x{{FDCF}}\\x{{FE70}}-\\x{{FEFC}}]') THEN {shaped} ELSE § END",
        "replace(replace(nfc_normalize(§), '\u06c0', '\u0647\u0654'), '\u06c2', '\u06c1\u0654')",
        # A joiner shows only after a letter that could join and before something that could not.
        f"CASE WHEN contains(§, '{JOINER}') THEN regexp_replace(regexp_replace(§, {show}), '{JOINER}+', '', 'g') ELSE § END",
        f"CASE WHEN contains(§, '{NON_JOINER}') THEN regexp_replace(regexp_replace(regexp_replace(§, {keep}), {keep}), '{NON_JOINER}+', '', 'g') ELSE § END",
    ]
    # Yeh and kaf of the two alphabets look the same inside a word and different at its end; alef maksura the other way round.
    for arabic, persian in (("\u064a", "\u06cc"), ("\u0643", "\u06a9")):
        rule = f"'{arabic}([{MARKS}]*)([{backward}{KEPT[1]}])', '{persian}\\1\\2', 'g'"
        found.append(f"CASE WHEN contains(§, '{arabic}') THEN regexp_replace(regexp_replace(§, {rule}), {rule}) ELSE § END")
    found.append(f"CASE WHEN contains(§, '\u0649') THEN regexp_replace(§, '\u0649([{MARKS}]*)([^{backward}{MARKS}{KEPT[1]}]|$)', '\u06cc\\1\\2', 'g') ELSE § END")
    found.append(f"translate(§, {quoted(''.join(KEPT))}, '{NON_JOINER}{JOINER}')")
    return tuple(found)


def select_sql(columns: list[str], forms: dict[str, str]) -> str:
    """A query over ``batch`` that keeps ``columns`` and adds the form of others under new names."""
    inner = f"SELECT {', '.join(columns + [f'{c} AS {n}' for c, n in forms.items()])} FROM batch"
    for step in steps():
        inner = f"SELECT {', '.join(columns + [f'{step.replace("§", n)} AS {n}' for n in forms.values()])} FROM ({inner})"
    return inner


def with_forms(df: DataFrame, key: str, columns: list[str], where: str = "") -> DataFrame:
    """``key`` and, for each of ``columns``, ``<column>_form``.

    Null stays null, '' stays ''; rows are neither joined nor dropped (unless
    ``where``, a condition in DuckDB's SQL over the forms, drops them); other
    columns are left out. One pass over the scan without a shuffle.
    """
    source = spread(df.select(F.col(key).alias("k"), *(F.col(c).alias(f"c{n}") for n, c in enumerate(columns))))
    names = {f"c{n}": f"f{n}" for n in range(len(columns))}
    sql = f"SELECT k{''.join(f', {n}' for n in names.values())} FROM ({select_sql(['k'], names)})" + (f" WHERE {where}" if where else "")
    out = pa.schema([("k", pa.string()), *((n, pa.string()) for n in names.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1}) as connection:
            for rows in batches:
                connection.register("batch", pa.Table.from_batches([rows]))
                made = connection.sql(sql).to_arrow_table().cast(out)
                connection.unregister("batch")
                yield from made.to_batches()

    made = source.mapInArrow(run, "k string, " + ", ".join(f"{n} string" for n in names.values()))
    return made.select(F.col("k").alias(key), *(F.col(f"f{n}").alias(f"{c}_form") for n, c in enumerate(columns)))


def same_look(pages: DataFrame, key: str = "id", left: str = "latest_translation", right: str = "approved_text") -> DataFrame:
    """``page_id`` of rows whose two texts are not identical but look the same.

    Rows with a null or empty text are no case. Rows repeated verbatim count once.
    """
    cases = pages.where((F.col(left) != "") & (F.col(right) != "") & (F.col(left) != F.col(right)))
    return with_forms(cases, key, [left, right], where="f0 = f1").select(F.col(key).alias("page_id")).distinct()
