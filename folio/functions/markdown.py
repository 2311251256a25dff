"""Recognising, masking and tidying pieces of Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import WS, col, strip

# Fixed values.
FENCED = r"```[a-zA-Z0-9_-]*\n[\s\S]*?```"
IMAGE = r"!\[[\s\S]*?\]\([^\n]*?\)"
DEFAULT_ALT = "Figure/Diagram"
TAIL_TITLES = ("Summary", rf"Chapter[{WS}]+Summary", rf"Concluding[{WS}]+Remarks", "Conclusion", rf"In[{WS}]+Summary", "References", "Bibliography", rf"Further[{WS}]+Reading", rf"Works[{WS}]+Cited", rf"Suggested[{WS}]+Reading",
               rf"خلاصه[{WS}]+فصل", "خلاصه", "جمع‌بندی", "نتیجه‌گیری", "منابع", "مراجع")
CANNED = rf"بله|آماده[‌{WS}]?ام|ارسال کنید|بفرستید|متن بخش بعدی|در خدمتم|رویکرد|بخش موردنظر|متن را ارسال"
CANNED_BELOW = 320
MARKED = r"\p{L}\p{N}_"


def blocks(x: Column | str, pattern: str) -> Column:
    """All matches of a pattern as an array; of null an empty one."""
    return F.coalesce(F.regexp_extract_all(col(x), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def masked(x: Column | str, pattern: str, name: str) -> Column:
    """Matches replaced by numbered tokens on lines of their own."""
    parts = F.split(col(x), pattern, -1)
    token = lambda p, k: F.when(k == 0, p).otherwise(F.concat(F.lit(f"\n\n[[{name}_"), (k - 1).cast("string"), F.lit("]]\n\n"), p))
    return F.array_join(F.transform(parts, token), "")


def masked_code(x: Column | str) -> Column:
    return masked(x, FENCED, "CODE_BLOCK")


def masked_images(x: Column | str) -> Column:
    return masked(x, IMAGE, "IMAGE_BLOCK")


def unmasked(x: Column | str, found: Column, name: str) -> Column:
    """Exact tokens replaced by their blocks; tokens without a block go, and so do blanks at the ends."""
    numbered = F.transform(found, lambda b, k: F.struct(k.alias("k"), b.alias("b")))
    back = F.aggregate(numbered, col(x), lambda text, s: F.replace(text, F.concat(F.lit(f"[[{name}_"), s["k"].cast("string"), F.lit("]]")), s["b"]))
    return F.when(F.size(found) == 0, col(x)).otherwise(strip(F.regexp_replace(back, rf"\[\[{name}_[0-9۰-۹]+\]\]\n*", "")))


def only_code_or_media(x: Column | str) -> Column:
    """Nothing is left to translate without fences, images, rules, digits and ASCII punctuation."""
    left = F.regexp_replace(F.regexp_replace(col(x), FENCED, ""), r"!\[[^\]]*\]\([^)]+\)", "")
    left = F.regexp_replace(left, r"(?m)^[ \t]*[-*_]{3,}[ \t]*$", "")
    return F.length(F.regexp_replace(left, rf"""[{WS}\p{{Nd}}.,:;!?"'()\[\]{{}}\-_/\\|><+=*&^%$#@~`]+""", "")) == 0


def block_type(x: Column | str) -> Column:
    """Kind of a paragraph: image, h1, h2, h3, bullet, numbered, quote or body; the first that fits."""
    c = strip(x)
    return (
        F.when(c.rlike(r"^!\[[^\]]*\]\([^)]*\)"), "image")
        .when(c.startswith("# "), "h1")
        .when(c.startswith("## "), "h2")
        .when(c.startswith("### "), "h3")
        .when(c.startswith("- ") | c.startswith("* "), "bullet")
        .when(c.rlike(rf"^\p{{Nd}}+\.[{WS}]"), "numbered")
        .when(c.startswith(">"), "quote")
        .otherwise("body")
    )


def is_generic_caption(x: Column | str) -> Column:
    return strip(x).rlike(rf"(?i)^(figure[{WS}/_-]*diagram|image|تصویر|نمودار)[{WS}]*\p{{Nd}}*$")


def image_place(url: Column | str) -> Column:
    """Page and number of an image from its address; null where it has none."""
    pattern = r"/pages/([0-9]+)/images/([0-9]+)"
    c = col(url)
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).cast("int").alias("page"), F.regexp_extract(c, pattern, 2).cast("int").alias("image")))


def is_canned(x: Column | str) -> Column:
    """A short answer that only acknowledges."""
    c = strip(x)
    return F.coalesce((F.length(c) < CANNED_BELOW) & c.rlike(CANNED), F.lit(False))


def without_tail(x: Column | str) -> Column:
    """The text up to its first closing heading (summary, references, …), and without a final run of three or more numbered references."""
    cut = strip(F.regexp_replace(col(x), rf"(?i)(?:\n|^)[{WS}]*#{{1,3}}[{WS}]*(?:{'|'.join(TAIL_TITLES)})(?![{MARKED}])[\s\S]*$", ""))
    return strip(F.regexp_replace(cut, rf"(?:\n[{WS}]*\[\p{{Nd}}+\][^\n]+){{3,}}[{WS}]*$", ""))


def clean_alt(x: Column | str) -> Column:
    """Alternative text on one line without brackets and parentheses, 150 characters at most, a default if nothing is left."""
    plain = strip(F.regexp_replace(F.regexp_replace(col(x), r"[\[\]()\n\r\t]+", " "), rf"[{WS}]{{2,}}", " "))
    return F.coalesce(F.nullif(F.substring(plain, 1, 150), F.lit("")), F.lit(DEFAULT_ALT))


#: Where a srcset is cut, and what one unit of each descriptor is worth; a candidate without one is worth 1 (fixed values).
SOURCE_CUT = r"(?<=[0-9][wx]),\s*|,\s+"
DESCRIPTORS = {"w": 1.0, "x": 1000.0}


def best_source(srcset: Column | str) -> Column:
    """The candidate of a srcset with the largest descriptor: widths as they are, densities as thousands, none as 1; the first wins ties."""
    parts = F.filter(F.transform(F.split(col(srcset), SOURCE_CUT), strip), lambda p: F.length(p) > 0)

    def score(p: Column) -> Column:
        value = lambda unit: F.regexp_extract(p, rf"\s([0-9.]+){unit}$", 1).try_cast("double")
        return F.coalesce(*(value(unit) * worth for unit, worth in DESCRIPTORS.items()), F.lit(1.0))

    scored = F.transform(parts, lambda p, k: F.struct(score(p).alias("score"), (-k).alias("k"), F.regexp_extract(p, r"^(\S+)", 1).alias("url")))
    return F.array_max(scored)["url"]


def safe_name(title: Column | str, most: int = 40) -> Column:
    """A title as part of a file name: characters that file systems refuse, and blanks, as underscores."""
    return F.substring(F.regexp_replace(col(title), r'[\\/*?:"<>| ]', "_"), 1, most)


def is_web_address(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike(r"(?i)^https?://\S+$"), F.lit(False))


def without_wrapper(x: Column | str) -> Column:
    """An answer without the tags that a model copies from its prompt."""
    return strip(F.regexp_replace(col(x), r"(?i)</?(?:source_document|translation)>", ""))


#: Languages of code in the order they are tried, each with a pattern (fixed order).
CODE_LANGUAGES = (
    ("php", r"<\?php|\$[a-zA-Z_]\w*\s*(?:=|->|\[|;|\))|->[a-zA-Z_]|\bnew\s+\\[A-Z]|\bnamespace\s+[A-Z]|^\s*use\s+[A-Z]"),
    ("python", r"^\s*(?:def\s+\w+\s*\(|class\s+\w+.*:|import\s+\w+|from\s+\w[\w.]*\s+import\s|@\w+|if\s+__name__\s*==|elif\s|self\.)"),
    ("json", r"\A\s*(?:\{(?=[\s\S]*\")(?=[\s\S]*:)[\s\S]*\}|\[(?=[\s\S]*\")(?=[\s\S]*:)[\s\S]*\])\s*\z"),
    ("html", r"(?i)<!doctype|<(?:html|div|span|p|table|script)\b|</[a-z]+>"),
    ("sql", r"(?i)\bselect\b.+\bfrom\b|\binsert\s+into\b|\bupdate\b.+\bset\b|\bdelete\s+from\b|\b(?:create|alter)\s+table\b"),
    ("javascript", r"\b(?:const|let|var)\s+\w+\s*=|\bfunction\s*\w*\s*\(|\bconsole\.log|\bexport\s|\bimport\s.*\bfrom\s+['\"]|\w=>|\binterface\s+[A-Z]|\btype\s+[A-Z]\w*\s*="),
    ("bash", r"^\s*(?:\$\s|npm\s|pip\s|docker\s|curl\s|git\s|sudo\s|cd\s|chmod\s)"),
    ("rust", r"\bfn\s+\w+\s*\(|\blet\s+mut\b|\bimpl\b|\bpub\s+fn\b|\bprintln!"),
    ("go", r"\bpackage\s+\w+|\bfunc\s*(?:\(\w+[^)]*\)\s*)?\w+\s*\(|\bfmt\.Print|\btype\s+\w+\s+struct\b"),
    ("java", r"\bpublic\s+class\b|\bpublic\s+static\s+void\b|\bSystem\.out\.print|\bnamespace\s+\w+\s*\{|\busing\s+System;"),
    ("cpp", r"#include\s*<|\bstd::cout|\bint\s+main\s*\("),
)


def code_language(x: Column | str) -> Column:
    """Language of a piece of code by the first pattern that fits; '' if none does."""
    c, found = col(x), None
    for name, pattern in CODE_LANGUAGES:
        found = (F if found is None else found).when(c.rlike(f"(?m){pattern}"), name)
    return found.otherwise("")


def section_title(titles: Column, first: Column, last: Column) -> Column:
    """A heading for a section from those inside it: one, two joined, first two and last, or its pages."""
    clean = F.filter(F.transform(titles, lambda t: strip(F.regexp_replace(t, rf"(?i)^(?:chapter[{WS}]+\p{{Nd}}+\.?[{WS}]*|#+[{WS}]*)", ""))), lambda t: F.length(t) > 0)
    n = F.size(clean)
    return (
        F.when(n == 1, F.get(clean, F.lit(0)))
        .when(n == 2, F.concat_ws(" و ", clean))
        .when(n > 2, F.concat(F.get(clean, F.lit(0)), F.lit("، "), F.get(clean, F.lit(1)), F.lit(" تا "), F.get(clean, n - 1)))
        .otherwise(F.concat(F.lit("سرفصل‌های صفحات "), first.cast("string"), F.lit(" الی "), last.cast("string")))
    )
