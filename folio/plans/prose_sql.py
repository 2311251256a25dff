"""The rules for Persian prose and for Markdown around it said once more in SQL, as chains of common table expressions.

Its engine knows no lookaround: borders are captured and rules with two borders run twice.
"""

from __future__ import annotations

W = r"[^\p{L}\p{N}_]"
S = r"[\s\p{Z}\x1c-\x1f\x{85}]"
L = r"[\x{0621}-\x{06CC}]"
Z = "‌"
SHIELD = ""
BE = "عنوان|گونه‌ای|طوری|اصطلاح|طور|ویژه|راحتی|سادگی|خودی|مراتب|شدت|ندرت|تنهایی"
PLURALS = "هایشان|هایتان|هایمان|هایش|هایت|هایم|هایی|های|ترین|تر|ها"
OWNERS = "مان|تان|شان|ام|ات|اش"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def words(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, '[^\\s\\p{{Z}}\\x1c-\\x1f\\x{{85}}]+')), 0)::INT"


def rule(pattern: str, to: str) -> str:
    return f"regexp_replace(t, '{pattern}', '{to}', 'g')"


SPACING = (
    rule(r"[ \t]+([،؛؟!.:])", r"\1"),
    rule(rf"""([،؛؟!:])([^{S[1:-1]}\p{{Nd}}،؛؟!:.)\]}}»"''/*_`~])""", r"\1 \2"),
    rule(r"[ \t]{2,}", " "),
)
PROSE = (
    "replace(replace(translate(t, 'يىكؤإأة', 'ییکوااه'), 'ۀ', 'هٔ'), 'ـ', '')",
    rule(f"(^|{W})(ن?می){S}+({L}{{2,}})", rf"\1\2{Z}\3"),
    *[rule(f"(^|{W})(به){S}+({BE})($|{W})", rf"\1\2{Z}\3\4")] * 2,
    *[rule(f"(^|{W})(بی){S}+({L}{{2,}})($|{W})", rf"\1\2{Z}\3\4")] * 2,
    rule(f"({L}+){S}+({PLURALS})($|{W})", rf"\1{Z}\2\3"),
    rule(f"({L}+[هة]){S}+({OWNERS})($|{W})", rf"\1{Z}\2\3"),
    "translate(t, '?;', '؟؛')",
    rule(f"({L}){S}*,{S}*", r"\1، "),
    rule(f",{S}*({L})", r"، \1"),
    rule(r"[ \t]*—[ \t]*", "، "),
    """CASE WHEN len(string_split(t, '"')) > 2 THEN array_to_string(list_transform(range(1, len(string_split(t, '"')) + 1), lambda k: CASE WHEN k = 1 THEN '' WHEN k % 2 = 0 THEN '«' ELSE '»' END || string_split(t, '"')[k]), '') ELSE t END""",
    *SPACING,
)
#: Emphasis that is well set already only has the blanks after the signs of lists closed up.
LISTS = rule(r"(?m)^([ \t]*[-*+])[ \t]+", r"\1 ")
_KEPT = r"```[\s\S]*?```|\$\$[\s\S]*?\$\$|\$[^$\n]+?\$|`[^`\n]+?`|\[\[(?:CODE|IMAGE)_BLOCK_[0-9]+\]\]|!\[[\s\S]*?\]\([^)]+\)|https?://[^\s)]+|<[^>]+>|&(?:#[0-9]+|#x[0-9a-fA-F]+|[A-Za-z0-9_]+);"


def chain(name: str, source: str, keys: str, steps: tuple[str, ...], start: str = "t") -> str:
    """Common table expressions that take ``t`` of ``source`` through steps; the last one is called ``name``."""
    made, before, first = [], source, start
    for k, step in enumerate((first, *steps)):
        here = name if k == len(steps) else f"{name}{k}"
        made.append(f"{here} AS (SELECT {keys}, {step} AS t FROM {before})")
        before = here
    return ", ".join(made)


def clean(name: str, source: str, keys: str) -> str:
    """Common table expressions for the Markdown-safe clean-up of ``t`` in ``source``; emphasis must be well set."""
    held = f"list_transform(regexp_extract_all(t, '{_KEPT}|\\]\\([^)]+\\)|{SHIELD}'), lambda x: CASE WHEN starts_with(x, '](') THEN substr(x, 2) ELSE x END)"
    shielded = f"regexp_replace(t, '(?:{_KEPT}|{SHIELD})|(\\])\\([^)]+\\)', '\\1{SHIELD}', 'g')"
    number = rf"(?m)^({S}*)(\p{{Nd}}+)\.{S}+"
    # Digits are turned one after the other, from the left, up to three.
    two = "t"
    for _ in range(3):
        for d in range(10):
            two = f"regexp_replace({two}, '(?m)^({S}*[۰-۹]*){d}([0-9]*\\.{S})', '\\1{chr(1776 + d)}\\2', 'g')"
    dots = f"CASE WHEN regexp_matches(t, '{number}') THEN regexp_replace({two}, '{number}', '\\1\\2. ', 'g') ELSE t END"
    restored = f"array_to_string(list_transform(range(1, len(string_split(t, '{SHIELD}')) + 1), lambda k: CASE WHEN k = 1 THEN '' ELSE held[k - 1] END || string_split(t, '{SHIELD}')[k]), '')"
    start = f"{name}_s AS (SELECT {keys}, nfc_normalize({LISTS}) AS t FROM {source}), {name}_h AS (SELECT {keys}, {held} AS held, {shielded} AS t FROM {name}_s)"
    return f"{start}, {chain(f'{name}_p', f'{name}_h', f'{keys}, held', (*PROSE, dots))}, {name}_r AS (SELECT {keys}, {restored} AS t FROM {name}_p), {name} AS (SELECT {keys}, {LISTS} AS t FROM {name}_r)"
