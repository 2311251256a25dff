"""Column functions on small literal tables."""

import pytest
from pyspark.sql import functions as F

from folio.functions import markdown as M
from folio.functions import persian as P
from folio.functions import repair as R
from folio.functions import text as T

Z = "‌"


def cleaned(spark, text):
    return R.clean_markdown(spark.createDataFrame([(text,)], "t string"), "t").first().t


def value(spark, column, text, kind="string"):
    return spark.createDataFrame([(text,)], f"t {kind}").select(column(F.col("t")).alias("r")).first()[0]


@pytest.mark.parametrize(
    ("function", "text", "expected"),
    [
        (P.persian_digits, "12 ٣", "۱۲ ۳"),
        (P.latin_digits, "۱۲ ٣", "12 3"),
        (P.persian_letters, "كيأۀ", "کیاهٔ"),
        (P.without_tatweel, "کـتاب", "کتاب"),
        (P.without_diacritics, "مُدیر", "مدیر"),
        (P.joined_verbs, "او می رود و نمی داند", f"او می{Z}رود و نمی{Z}داند"),
        (P.joined_verbs, "قدیمی رود", "قدیمی رود"),
        (P.joined_prefixes, "به طور کلی بی نظیر", f"به{Z}طور کلی بی{Z}نظیر"),
        (P.joined_suffixes, "کتاب ها بزرگ تر", f"کتاب{Z}ها بزرگ{Z}تر"),
        (P.joined_possessives, "خانه ام", f"خانه{Z}ام"),
        (P.persian_punctuation, 'چرا? او گفت "بله" , رفت', "چرا؟ او گفت «بله» ، رفت"),
        (P.persian_punctuation, "سلام, دوست — خوب", "سلام، دوست، خوب"),
        (P.persian_punctuation, 'یک " تنها', 'یک " تنها'),
        (P.punctuation_spacing, "سلام ،خوبی  ؟بله", "سلام، خوبی؟ بله"),
        (T.strip, "   a\n ", "a"),
        (T.unix_lines, " a\r\nb\rc ", "a\nb\nc"),
        (M.clean_alt, " a [b]\n c ", "a b c"),
        (M.clean_alt, "", "Figure/Diagram"),
        (M.best_source, "a.png 320w, b.png 2x, c.png 640w", "b.png"),
        (M.best_source, "a.png, b.png", "a.png"),
        (M.safe_name, "a/b c", "a_b_c"),
        (M.without_wrapper, "<translation>x</translation>", "x"),
        (M.without_tail, "body\n\n## References\n[1] a", "body"),
        (M.without_tail, "body\n[1] a\n[2] b\n[3] c", "body"),
        (M.block_type, "## x", "h2"),
        (M.block_type, "1. x", "numbered"),
        (M.code_language, "def f(x):\n  pass", "python"),
        (M.code_language, "$a = 1;", "php"),
        (M.code_language, '{"a": 1}', "json"),
        (M.code_language, "SELECT a FROM b", "sql"),
        (M.code_language, "hello", ""),
    ],
)
def test_function(spark, function, text, expected):
    assert value(spark, function, text) == expected


@pytest.mark.parametrize("function", [P.clean_prose, P.persian_digits, T.strip, M.masked_code, M.without_tail, R.clean_around_shields, R.emphasis])
def test_null_and_empty(spark, function):
    assert value(spark, function, None) is None
    assert value(spark, function, "") == ""


def test_masks_round_trip(spark):
    text = "a\n\n```python\nx = 1\n```\n\nb ![i](u)\n\n```\ny\n```"
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(M.masked_code("t").alias("m"), M.unmasked(M.masked_code("t"), M.blocks("t", M.FENCED), "CODE_BLOCK").alias("u"), M.only_code_or_media("t").alias("o")).first()
    assert "[[CODE_BLOCK_0]]" in row.m and "[[CODE_BLOCK_1]]" in row.m and "x = 1" not in row.m
    assert row.u.split() == text.split() and not row.o
    assert value(spark, M.only_code_or_media, "```\nx\n```\n![a](b)\n---\n12.")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("**foo: **bar", "**foo:** bar"),
        ("**عنوان :**متن", "**عنوان:** متن"),
        (f"**a**{Z}b", "**a** b"),
        ("**a**-b", "**a** - b"),
        ("-   x", "- x"),
        ("** **", "** **"),
        ("** **bold**", "** **bold**"),
        ("***a***", "***a***"),
        ("**a **- **b **- **c **- d", "**a** - **b** - **c** - d"),
        ("x ** y** z", "x  **y** z"),
        ("**Log : **داده", "**Log:** داده"),
        ("- **A:** b (**C**) d", "- **A:** b (**C**) d"),
        ("**one: **\n**two**", "**one:**\n**two**"),
        ("**one: **", "**one:** "),
        ("__a __b", "__a __b"),
        ("__a __ b", "__a__ b"),
        ("my__name__x", "my__name__x"),
        ("**a", "**a"),
        ("**a** *b* **c**d", "**a** *b* **c**d"),
    ],
)
def test_emphasis(spark, text, expected):
    assert R.emphasis_text(text) == expected
    assert value(spark, R.emphasis, text) == expected


def test_clean_markdown_keeps_code_and_addresses(spark):
    text = "می رود `a,b` [x](http://h/a?b=1;c) $x;y$ &amp; <b>\n\n```py\nx = a ? b;\n```\n1. یک"
    clean = cleaned(spark, text)
    for kept in ("`a,b`", "(http://h/a?b=1;c)", "$x;y$", "&amp;", "<b>", "```py\nx = a ? b;\n```"):
        assert kept in clean
    assert f"می{Z}رود" in clean and "۱. یک" in clean
    # A formula inside inline code is protected once and comes back whole.
    assert cleaned(spark, "`$x$; a` ?") == "`$x$; a`؟"
    # Characters of private use are text like any other.
    assert cleaned(spark, "a \ue0005\ue001 `b` \ue000 ?") == "a \ue0005\ue001 `b` \ue000؟"


def test_clean_markdown_of_a_whole_page(spark):
    page = "# فصل 1 : مقدمه ای بر سیستم ها\nدر این فصل ، ما می دانیم که سیستم ها کار می کنند .\nبه عنوان مثال \"مقیاس\" مهم است .\n\n1. مورد: کتاب ها\n2. مورد: بزرگ تر\n\n```python\nx=1, y=\"test\"?\n```\n\n$E = m, c = 2$ و:\n$$\nx_i = y, z\n$$\n\n[[CODE_BLOCK_0]] [سند](https://example.com/api?id=12,34) ![نمودار](/api/1)"
    clean = cleaned(spark, page)
    for part in (f"سیستم{Z}ها", f"می{Z}دانیم", f"کار می{Z}کنند.", f"به{Z}عنوان مثال", "«مقیاس»", f"۱. مورد: کتاب{Z}ها", f"۲. مورد: بزرگ{Z}تر", 'x=1, y="test"?', "$E = m, c = 2$", "x_i = y, z", "[[CODE_BLOCK_0]]", "https://example.com/api?id=12,34", "![نمودار](/api/1)"):
        assert part in clean, part
    assert "**Embedding مناسب نیست:** این" in cleaned(spark, "**Embedding مناسب نیست: ** این")


def test_restoring():
    source = "![a](u1)\n\ntext\n\n```py\nx\n```"
    assert R.code_back("see [[ CODE\\_BLOCK\\_۰ ]] end", source) == "see ```py\nx\n``` end"
    assert R.code_back("see [CODE BLOCK 0], not [[CODE_BLOCK_7]]\n\nx", source) == "see ```py\nx\n```, not x"
    assert R.code_back("[[کد ۰]]", source) == R.code_back("CODE_BLOCK_0", source) == "```py\nx\n```"
    assert R.code_back("lost", source).endswith("```py\nx\n```")
    assert R.images_back("متن", source).startswith("![a](u1)")
    assert R.images_back("[[IMAGE_BLOCK_0]] x [[IMAGE_BLOCK_7]]", source) == "![a](u1) x"
    assert R.images_back("a\n\nFigure/Diagram\n\nb", source) == "a\n\n![a](u1)\n\nb"
    assert R.images_back("a ![تصویر ۱](x) b", source) == "a ![a](u1) b"
    two = "text ![a](u1)\n\n![b](u2)"
    assert R.images_back("![Image 2] [[IMAGE_BLOCK_۰]]", two) == "![b](u2) ![a](u1)"
    assert R.images_back("x\n\n## شکل 3\n\ny", two) == "x\n\n![a](u1)\n\n![b](u2)\n\n## شکل 3\n\ny"
    assert R.images_back("lost", "long text before it ![a](u)") == "lost\n\n![a](u)"
    assert R.images_back("lost", "no image") == "lost" and R.images_back("", source) == "![a](u1)"
    assert R.answer_images("[[IMAGE_BLOCK_۰]][[IMAGE_BLOCK_9]]", source) == "![a](u1)"
    assert R.tidy_fences("```py\n\nx  \n\n\n\ny\n\n```") == "```py\nx\n\ny\n```"


def test_canned_answers(spark):
    assert value(spark, M.is_canned, "آماده ام") and value(spark, M.is_canned, f"آماده{Z}ام") and value(spark, M.is_canned, "آماده\u00a0ام")
    assert not value(spark, M.is_canned, "یادداشت") and not value(spark, M.is_canned, "بله " * 100)


def test_long_runs_of_white_space(spark):
    for text in ("a" + " " * 200_000 + "b ", "a" + "\n \n" * 60_000 + "b"):
        assert value(spark, T.strip, text) == text.strip()
        assert value(spark, P.punctuation_spacing, text).startswith("a")
        assert value(spark, P.persian_punctuation, text + " — c").endswith("، c")
